"""Charts over ranges: equal to one window a measure at any number of ranges and blocks; rules by hand."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from flowgauge.operators import charts
from flowgauge.plans import chart_plans

SCHEMA = "measure string, session_id long, value double, low double, high double"


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def test_query_equals_its_oracle(spark, sf_dir):
    d = duckdb.connect()
    d.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    got = chart_plans.w42_charts_of_sessions(spark, sf_dir)
    want = d.execute(chart_plans.oracle_sql()["w42_charts_of_sessions"])
    names = [c[0] for c in want.description]
    found = Counter(tuple(map(plain, r)) for r in got.collect())
    assert found == Counter(tuple(plain(r[names.index(c)]) for c in got.columns) for r in want.fetchall())


def brute(values, low, high):
    """Signals of one measure's values in order, point by point."""
    centre, mr = float(np.mean(values)), float(np.mean(np.abs(np.diff(values))))
    sigma, out = mr / 1.128, set()
    for side, sign, limit, fits in (("above", 1, centre + 2.66 * mr, high is None or centre + 2.66 * mr <= high), ("below", -1, centre - 2.66 * mr, low is None or centre - 2.66 * mr >= low)):
        for i, x in enumerate(values):
            if fits and sign * (x - limit) > 1e-9:
                out.add((i, "beyond_limits", side))
            for rule, n, k, least in (("two_of_three", 3, 2, 2), ("four_of_five", 5, 1, 4)):
                far = [sign * (y - centre) / sigma > k + 1e-9 for y in values[max(0, i + 1 - n) : i + 1]] if sigma else []
                if fits and len(far) == n and far[-1] and sum(far) >= least:
                    out.add((i, rule, side))
            if fits and i >= 7 and all(sign * (y - centre) > 1e-9 for y in values[i - 7 : i + 1]):
                out.add((i, "run_of_eight", side))
    return out


@pytest.mark.parametrize("parts,block", [(1, 65536), (7, 8), (64, 19)])
def test_ranges_and_blocks_do_not_change_signals(spark, monkeypatch, parts, block):
    rng = np.random.default_rng(11)
    # one measure holds most rows, one has a bound that cuts a limit off, one drifts
    tables = {"big": (rng.normal(size=400).round(2).tolist(), None, None), "share": (np.abs(rng.normal(0.05, 0.1, 90)).clip(0, 1).tolist(), 0.0, 1.0), "drift": ((np.arange(120) / 30 + rng.normal(size=120)).tolist(), 0.0, None)}
    rows = [(m, k, x, low, high) for m, (xs, low, high) in tables.items() for k, x in enumerate(xs)]
    rows += [("big", 1000, None, None, None), ("big", 1001, float("nan"), None, None), (None, 1, 5.0, None, None)] + [("few", k, float(k), None, None) for k in range(7)]
    monkeypatch.setattr(charts, "BLOCK", block)
    got = charts.signals(spark.createDataFrame(rows, SCHEMA), ["session_id"], parts).collect()
    want = {(m, i, rule, side) for m, (xs, low, high) in tables.items() for i, rule, side in brute(xs, low, high)}
    assert {(r.measure, r.place, r.rule, r.side) for r in got} == want and len(got) == len(want) and {w[2] for w in want} == {"beyond_limits", "two_of_three", "four_of_five", "run_of_eight"}


def test_numbers_have_no_gaps(spark):
    frame = spark.range(1000).selectExpr("if(id % 3 = 0, null, cast(id % 2 as string)) as m", "1000 - id as x")
    got = charts.numbered(frame, "m", ["x"], 9).collect()
    for m in (None, "0", "1"):
        mine = sorted((r.place, r.x) for r in got if r.m == m)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)


def test_equal_values_and_no_rows_have_no_signals(spark):
    assert charts.signals(spark.createDataFrame([("m", k, 1.0, None, None) for k in range(20)], SCHEMA), ["session_id"], 3).collect() == []
    assert charts.signals(spark.createDataFrame([], SCHEMA), ["session_id"], 3).collect() == []
