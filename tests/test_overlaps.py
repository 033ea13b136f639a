"""Covered sets by the index of prefixes against all pairs."""

import random

from flowgauge.operators import overlaps

SCHEMA = "s string, id long, words array<string>"


def test_covered_sets_equal_all_pairs(spark):
    rng = random.Random(4)
    table = [(rng.choice("ab"), k, rng.sample([f"w{int(29 * rng.random() ** 2)}x{i}" if i % 3 else f"c{i}" for i in range(30)], rng.randint(0, 14))) for k in range(160)] + [("a", 900, None), ("b", 901, [])]
    table += [("a", 700 + k, ["p", "q", "r", "s"]) for k in range(4)]
    frame = spark.createDataFrame(table, SCHEMA)
    for least, share in ((3, 0.5), (1, 0.9), (4, 0.1)):
        got = [(r.s, r.id, r.other, r.shared) for r in overlaps.covered(frame, frame, "s", least, share).collect()]
        want = {(s, i, j, len({*v} & {*w})) for s, i, v in table for t, j, w in table if s == t and v and w and len({*v} & {*w}) >= max(least, share * len(v))}
        assert set(got) == want and len(got) == len(want) and want
    assert overlaps.covered(frame.limit(0), frame, "s").collect() == []
