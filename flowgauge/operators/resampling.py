"""Bootstrap intervals of binary metrics with the draws of Python's own generator, a group in as many tasks as it has blocks.

A resample's metrics need only how often it drew each of four outcomes. Draws are positions in the group's order; each block
of positions counts those that fall into it, and counts are summed. A block repeats the whole stream of draws, as the
generator has no other way to a later draw: a group of m blocks costs m times the draws, in memory of one block each.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.operators.charts import numbered

BLOCK = 1 << 20
#: Draws made at a time.
DRAWN = 1 << 20
OUTCOMES = ("tp", "fp", "fn", "tn")


def draws(n: int, seed: int) -> Iterator[np.ndarray]:
    """The numbers that random.Random(seed).randrange(n) gives in turn, without end, in arrays. n is at most 2^32 - 1."""
    # both are the same twister; only their seeding differs
    _, (*key, place), _ = random.Random(seed).getstate()
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": place}}
    shift = np.uint64(32 - n.bit_length())
    while True:
        found = source.random_raw(DRAWN) >> shift
        yield found[found < n].astype(np.int64)


def counts(outcome: np.ndarray, start: int, n: int, samples: int, seed: int) -> np.ndarray:
    """How often each resample of n drew each outcome (0 to 3) among the positions from start on; samples x 4."""
    out = np.zeros((samples, 4), np.int64)
    done = 0
    for found in draws(n, seed):
        found = found[: samples * n - done]
        sample = (done + np.arange(len(found))) // n
        mine = (found >= start) & (found < start + len(outcome))
        np.add.at(out, (sample[mine], outcome[found[mine] - start]), 1)
        done += len(found)
        if done == samples * n:
            return out


def intervals(records: DataFrame, by: str, samples: int = 400, seed: int = 17) -> DataFrame:
    """by, n and for precision, recall, f0_5 and accuracy the bounds of the middle 95 % (low, high) over resamples of records
    (by, id, gold, pred; ids differ within by, in whose order records stand). A metric without a denominator is 0."""
    hit = F.when(F.col("gold") & F.col("pred"), 0).when(F.col("pred"), 1).when(F.col("gold"), 2).otherwise(3)
    placed = numbered(records.select(by, "id", hit.cast("byte").alias("outcome")), by, ["id"])
    sizes = placed.groupBy(F.col(by).alias("by_")).agg(F.count(F.lit(1)).alias("n"))
    blocks = placed.join(sizes, F.col(by).eqNullSafe(F.col("by_"))).select(by, "n", "place", "outcome", F.floor(F.col("place") / BLOCK).alias("block"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        n, start = int(p["n"].iloc[0]), int(p["place"].iloc[0])
        out = pd.DataFrame(counts(p["outcome"].to_numpy(np.int64), start, n, samples, seed), columns=list(OUTCOMES))
        out.insert(0, by, p[by].iloc[0])
        return out.assign(n=n, sample=range(samples))[[by, "n", "sample", *OUTCOMES]]

    kind = dict(records.dtypes)[by]
    parts = blocks.groupBy(by, "block").applyInPandas(run, f"`{by}` {kind}, n long, sample int, {', '.join(f'{o} long' for o in OUTCOMES)}")
    drawn = parts.groupBy(by, "n", "sample").agg(*(F.sum(o).cast("double").alias(o) for o in OUTCOMES))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    measured = drawn.select(by, "n", p.alias("precision"), r.alias("recall"), ratio(1.25 * p * r, 0.25 * p + r).alias("f0_5"), ratio(F.col("tp") + F.col("tn"), F.col("n").cast("double")).alias("accuracy"))
    ends = [F.round(F.percentile(m, F.lit(q)), 6).alias(f"{m}_{end}") for m in ("precision", "recall", "f0_5", "accuracy") for end, q in (("low", 0.025), ("high", 0.975))]
    return measured.groupBy(by, "n").agg(*ends)
