"""Bootstrap intervals against a run in plain Python with its own generator."""

import math
import random

import numpy as np
import pytest

from flowgauge.operators import resampling
from flowgauge.plans import fold_queries

SCHEMA = "lang string, id long, gold boolean, pred boolean"


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 70_001])
def test_draws_are_those_of_python(n):
    for seed in (17, 0, 2**32 - 1):
        rng, mine = random.Random(seed), next(resampling.draws(n, seed))
        assert mine[:3000].tolist() == [rng.randrange(n) for _ in range(3000)]


def plain(records, samples, seed):
    rng, series = random.Random(seed), {m: [] for m in ("precision", "recall", "f0_5", "accuracy")}
    for _ in range(samples):
        drawn = [records[rng.randrange(len(records))] for _ in records]
        tp, fp, fn = (sum((g, p) == k for g, p in drawn) for k in ((True, True), (False, True), (True, False)))
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        for m, x in zip(series, (p, r, 1.25 * p * r / (0.25 * p + r) if p + r else 0.0, sum(g == q for g, q in drawn) / len(drawn))):
            series[m].append(x)

    def at(xs, q):
        xs, k = sorted(xs), (len(xs) - 1) * q
        return xs[math.floor(k)] + (xs[math.ceil(k)] - xs[math.floor(k)]) * (k - math.floor(k))

    return [at(series[m], q) for m in series for q in (0.025, 0.975)]


@pytest.mark.parametrize("block", [1 << 20, 37])
def test_intervals_equal_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "DRAWN", 1000)
    rng = np.random.default_rng(5)
    groups = {"en": 150, "de": 38, "one": 1, None: 20}
    table = [(lang, k, bool(rng.random() < 0.6), bool(rng.random() < 0.5)) for lang, n in groups.items() for k in range(n)]
    table += [("never", k, False, False) for k in range(9)]
    got = {r[0]: (r.n, list(r[2:])) for r in resampling.intervals(spark.createDataFrame(table, SCHEMA).repartition(5), "lang", 60, 17).collect()}
    assert set(got) == {*groups, "never"}
    for lang in got:
        mine = [(g, p) for x, _, g, p in table if x == lang]
        assert got[lang][0] == len(mine) and got[lang][1] == pytest.approx(plain(mine, 60, 17), abs=1e-6)
    assert resampling.intervals(spark.createDataFrame([], SCHEMA), "lang").collect() == []


def test_query_runs_over_whole_tables(spark, sf_dir):
    rows = fold_queries.queries()["a36_bootstrap_intervals"](spark, sf_dir).collect()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").count()
    assert sum(r.n for r in rows) == labels and all(0 <= r.accuracy_low <= r.accuracy_high <= 1 for r in rows)
