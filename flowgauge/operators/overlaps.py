"""Sets of words covered by other sets, by an exact index of prefixes: no pair is made that shares no word of a prefix.

A set of n words that must share at least t with another can't do so without one of its n - t + 1 rarest words; so only
these are looked up. What is found is counted on the whole sets. Words are as rare as in the sets looked up in, within `by`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def covered(asked: DataFrame, others: DataFrame, by: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """by, id, other, shared, score: sets of others (by, id, words) that share at least `least` words, and at least that share
    of its words, with a set of asked (same columns). Words of a set are distinct; sets that are null or smaller are in no pair."""
    found = others.select(by, F.col("id").alias("other"), F.explode("words").alias("word"))
    rare = found.groupBy(by, "word").agg(F.count(F.lit(1)).alias("often"))
    need = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.size("words") - 1e-9))
    words = asked.where(F.size("words") >= least).select(by, "id", need.cast("int").alias("need"), F.size("words").alias("n"), F.explode("words").alias("word"))
    ranked = words.join(rare, [by, "word"], "left").withColumn("place", F.row_number().over(Window.partitionBy(by, "id").orderBy(F.coalesce("often", F.lit(0)), "word")))
    prefix = ranked.where("place <= n - need + 1 and often is not null")
    pairs = prefix.join(found, [by, "word"]).select(by, "id", "other").distinct()
    whole = pairs.join(asked.select(by, "id", F.col("words").alias("mine")), [by, "id"]).join(others.select(by, F.col("id").alias("other"), F.col("words").alias("theirs")), [by, "other"])
    shared = whole.select(by, "id", "other", F.size(F.array_intersect("mine", "theirs")).alias("shared"), F.size("mine").alias("n"))
    return shared.where((F.col("shared") >= least) & (F.col("shared") >= share * F.col("n"))).select(by, "id", "other", "shared", (F.col("shared") / F.col("n")).alias("score"))
