"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a fresh one if the session is
    of one machine (tests), and an error on a cluster, whose executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowgauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, held in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/flowgauge-{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Records and bytes of an Arrow batch with whole texts; a session's own settings win where they differ from Spark's.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    """Batches that fit beside a worker's tables, also where texts are very long."""
    for key, (usual, ours) in BATCH.items():
        if spark.conf.get(key, None) == usual:
            spark.conf.set(key, ours)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two columns: the key as long, and the text (null: empty)."""
    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding it."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the long columns a and b (a <> b): node, root (the least node of its component).

    Alternates the two star contractions: each node's larger neighbours, then its smaller ones, are hung on the
    least node next to it. A hub's rows meet in a join, which adaptive execution may split, never in one group.
    The edges are checkpointed each round. Only nodes that have an edge are returned.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before, seen = seen, _state(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


#: A key is hot if it has this part of all rows: there are at most so many of them.
HOT = 1000


def met(rows: DataFrame, facts: DataFrame, key: str, fact: str, spread: str) -> DataFrame:
    """rows with the column fact of facts (the long key, once; n, how many rows have it; fact), null where there is none.

    Keys of 1 in HOT of all rows or more, HOT of them at most, are broadcast, and their rows dealt out by the long column
    spread instead, so that no key's rows meet in one task. facts should be cheap to read twice.
    """
    least = (facts.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = facts.where(F.col("n") >= least).select(F.col(key).alias("_hot"), F.col(fact).alias("_known"))
    known = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_by", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(spread)))
    rest = facts.where(F.col("n") < least).select(F.col(key).alias("_rest"), F.col(fact).alias("_found"))
    both = known.join(rest, F.col("_by") == F.col("_rest"), "left")
    return both.withColumn(fact, F.when(F.col("_hot").isNotNull(), F.col("_known")).otherwise(F.col("_found"))).drop("_hot", "_known", "_by", "_rest", "_found")
