"""A store of fragments known by their content, prompts sent as what it lacks, and versions that sessions hold.

A fragment is a text in normal form (NFC, white space as one space each), known by its SHA-256. The store is a folder of
loads. A load writes those of its fragments that no load before it has, the first span's count and origin with each; it
writes its own part alone, so that a load run again after a lost driver gives the same store. Spans are (owner, place, text,
tokens); blank and null texts are no fragments. Equal texts are made one before anything is joined.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORED = "id string, text string, tokens long, owner long, load int"


@F.pandas_udf(T.StringType())
def normal(texts: pd.Series) -> pd.Series:
    """Texts in normal form; null for null."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


def shard(spans: DataFrame) -> DataFrame:
    """owner, place, id, text, tokens: the spans that hold anything, as fragments."""
    known = spans.select("owner", "place", normal("text").alias("text"), F.col("tokens").cast("long").alias("tokens")).where("text <> ''")
    return known.select("owner", "place", F.sha2("text", 256).alias("id"), "text", "tokens")


def stored(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The store's fragments, or those of loads before a number; none where there is no store."""
    try:
        found = spark.read.schema(STORED).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)
    return found if before is None else found.where(F.col("load") < before)


def put(fragments: DataFrame, folder: str, load: int) -> None:
    """Writes a load: of its fragments, by owner and place, the first of each id that loads before it have not."""
    first = fragments.groupBy("id").agg(F.min_by(F.struct("text", "tokens", "owner"), F.struct("owner", "place")).alias("x")).select("id", "x.*")
    old = stored(fragments.sparkSession, folder, load).select("id")
    first.join(old, "id", "left_anti").write.mode("overwrite").parquet(f"{folder}/load={load}")


def delta(required: DataFrame, store: DataFrame, cached: int) -> DataFrame:
    """For each owner of required fragments (owner, place, id): hits (in loads up to `cached`, which the other side has), misses,
    total, sent and saved tokens, compression, and the text resolved from both; an id that is nowhere counts as a miss
    without tokens and stays in its place as {{id}}."""
    have = store.select("id", F.col("text").alias("found"), F.col("tokens").alias("n"), (F.col("load") <= cached).alias("hit"))
    met = required.select("owner", "place", "id").join(have, "id", "left")
    hit, count = F.coalesce("hit", F.lit(False)), F.coalesce("n", F.lit(0))
    lines = F.array_sort(F.collect_list(F.struct("place", F.coalesce("found", F.concat(F.lit("{{"), "id", F.lit("}}"))).alias("line"))))
    sums = met.groupBy("owner").agg(
        F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"), F.sum(count).alias("total_tokens"), F.sum(F.when(~hit, count).otherwise(0)).alias("sent_tokens"),
        F.sum(F.when(hit, count).otherwise(0)).alias("saved_tokens"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"),
    )
    return sums.withColumn("compression", F.when(F.col("total_tokens") > 0, F.round(1 - F.col("sent_tokens") / F.col("total_tokens"), 6)).otherwise(0.0))


def versions(events: DataFrame) -> DataFrame:
    """owner, fragment, version: how many updates of a fragment were made up to an owner's last event on it.

    Events are (owner, fragment, at, event_id, update). Updates are counted in two levels, by day and within it, so that no
    task holds all events of a fragment that everyone uses.
    """
    day = events.where("fragment is not null and owner is not null and at is not null").withColumn("day", F.to_date("at"))
    return events.sparkSession.sql("""
with d as (select fragment, day, count(case when update then 1 end) as made from {e} group by fragment, day),
t as (select fragment, day, coalesce(sum(made) over (partition by fragment order by day rows between unbounded preceding and 1 preceding), 0) as earlier from d),
n as (select owner, fragment, day, at, event_id, count(case when update then 1 end) over (partition by fragment, day order by at, event_id) as within from {e}),
l as (select owner, fragment, max_by(struct(day, within), struct(at, event_id)) as last from n group by owner, fragment)
select l.owner, l.fragment, l.last.within + t.earlier as version from l join t on t.fragment = l.fragment and t.day = l.last.day""", e=day)


def skews(held: DataFrame) -> DataFrame:
    """fragment, owners, gap, severity, latest, stale: fragments of which owners hold several versions. Severity is HIGH for a
    gap over 2 or more than four owners, MEDIUM for three or four, else LOW; stale owners hold less than the latest held."""
    by = held.groupBy("fragment", "version").agg(F.count(F.lit(1)).alias("n"))
    all_ = by.groupBy("fragment").agg(F.sum("n").alias("owners"), (F.max("version") - F.min("version")).alias("gap"), F.max("version").alias("latest"), F.max_by("n", "version").alias("fresh")).where("owners >= 2 and gap > 0")
    severity = F.when((F.col("gap") > 2) | (F.col("owners") > 4), "HIGH").when(F.col("owners") >= 3, "MEDIUM").otherwise("LOW")
    return all_.select("fragment", "owners", "gap", severity.alias("severity"), "latest", (F.col("owners") - F.col("fresh")).alias("stale"))


def resolved(found: DataFrame, strict: bool) -> DataFrame:
    """What is done about skews: each fragment is refreshed, and where strict, its owners wait for that."""
    text = "Blocking until refreshed" if strict else "Warning"
    message = F.concat(F.lit(text + ": "), "stale", F.lit(" of "), "owners", F.lit(" owners hold an old version (severity "), "severity", F.lit(")"))
    return found.select("fragment", F.lit(strict).alias("block"), message.alias("message"))
