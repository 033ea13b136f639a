"""Turns of a conversation that later turns cover: by the index of prefixes, and in the oracle pair by pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions import scalars
from flowgauge.operators import overlaps
from flowgauge.plans.sample_plans import WORDS
from flowgauge.sources.feeds import feed


def j8_turns_covered_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = feed(spark, sf_dir, "c").select("session_id", F.col("seq").alias("id"), scalars.content_words(F.coalesce("text", F.lit(""))).alias("words"))
    found = overlaps.covered(turns, turns, "session_id").where("other > id")
    return found.select("session_id", F.col("id").alias("turn"), F.col("other").alias("later"), F.col("shared").cast("long").alias("shared"), F.round("score", 6).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"j8_turns_covered_later": j8_turns_covered_later}


def oracle_sql() -> dict[str, str]:
    return {
        "j8_turns_covered_later": f"""with w as (select conv_id, turn, {WORDS.format("coalesce(text, '')")} as words from conversations),
p as (select a.conv_id as session_id, a.turn as turn, b.turn as later, len(list_intersect(a.words, b.words)) as shared, len(a.words) as n from w a join w b on b.conv_id = a.conv_id and b.turn > a.turn)
select session_id, turn, later, shared, round(shared / n, 6) as score from p where shared >= 3 and 2 * shared >= n"""
    }
