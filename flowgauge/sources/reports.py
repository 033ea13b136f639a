"""Sinks of reports: JSON lines and Markdown tables, sparklines and durations as columns, and a cache of results by content."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "▁▂▃▄▅▆▇█"


def sparkline(values: Column) -> Column:
    """One bar for each number of an array, from its least to its greatest; all alike: the lowest bar. Nulls: a blank."""
    low, high = F.array_min(values), F.array_max(values)
    step = lambda v: F.when(v.isNull(), " ").when(high == low, BARS[0]).otherwise(F.substr(F.lit(BARS), F.floor((v - low) / (high - low) * 7 + 0.5).cast("int") + 1, F.lit(1)))
    return F.array_join(F.transform(values, step), "")


def duration(seconds: Column) -> Column:
    """42s, 3m 5s or 2h 1m."""
    s = F.floor(seconds).cast("long")
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 60, part(s, "s")).when(s < 3600, F.concat_ws(" ", part(F.floor(s / 60), "m"), part(s % 60, "s"))).otherwise(F.concat_ws(" ", part(F.floor(s / 3600), "h"), part(F.floor(s % 3600 / 60), "m")))


def write_json(report: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are kept as nulls."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(report: DataFrame) -> Column:
    """A row as a line of a Markdown table."""
    shown = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"([|\\])", r"\\$1")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.regexp_replace(shown(c), r"\s*\n\s*", " ") for c in report.columns)), F.lit(" |"))


def write_markdown(report: DataFrame, path: str, order: list[str]) -> None:
    """A report of a size to be read as one Markdown file, its rows in order."""
    spark, numbers = report.sparkSession, {"tinyint", "smallint", "int", "bigint", "float", "double"}
    head = [f"| {' | '.join(report.columns)} |", f"|{'|'.join('---:' if t in numbers or t.startswith('decimal') else '---' for _, t in report.dtypes)}|"]
    top = spark.createDataFrame([(k, h) for k, h in enumerate(head)], "place long, value string")
    rows = report.orderBy(*order).select(markdown(report).alias("value")).withColumn("place", F.monotonically_increasing_id() + len(head))
    top.unionByName(rows).repartition(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows and schema, whatever their order and partitions."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    n, mixed, total = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    return f"{abs(hash_of(df.schema.simpleString())):x}-{n}-{(mixed or 0) & (1 << 64) - 1:x}-{int(total or 0) & (1 << 64) - 1:x}"


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def cached(spark: SparkSession, source: DataFrame, name: str, build: Callable[[DataFrame], DataFrame], folder: str, hours: float = 168) -> DataFrame:
    """build(source) from a Parquet table in folder, named by the operator and the source's content, while it is younger than
    `hours`; else built and written anew. A table that was not finished is not taken."""
    path = f"{folder}/{name}-{fingerprint(source)}"
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, done = store.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs.exists(done) or time.time() - fs.getFileStatus(done).getModificationTime() / 1000 > hours * 3600:
        build(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
