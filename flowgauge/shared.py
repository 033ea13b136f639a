"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """spark.checkpoint.dir, set as the place of checkpoints. Where it is unset, a fresh folder if the session is of one
    machine (tests), and an error on a cluster, whose executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowgauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def held(df: DataFrame, by: str = "session_id") -> DataFrame:
    """df written once below the checkpoint folder, for plans that read it several times: in columns, so that each reads only
    its own, and in buckets of `by`, so that windows over it need no exchange. The folder's owner cleans it."""
    spark, name = df.sparkSession, f"held_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    df.write.format("parquet").bucketBy(buckets, by).option("path", f"{checkpoints(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
