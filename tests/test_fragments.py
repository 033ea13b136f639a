"""The fragment store: loads, deltas against it, versions; against oracles and by hand."""

import datetime
import hashlib
from collections import Counter

import duckdb
import pytest

from flowgauge.operators import fragments
from flowgauge.plans import fragment_plans

SPANS = "owner long, place int, text string, tokens long"
EVENTS = "owner long, fragment long, at timestamp, event_id long, update boolean"


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(fragment_plans.queries()))
def test_queries_equal_their_oracles(spark, sf_dir, name):
    d = duckdb.connect()
    for t in ("documents", "events"):
        d.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = fragment_plans.queries()[name](spark, sf_dir), d.execute(fragment_plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    found = Counter(tuple(map(plain, r)) for r in got.collect())
    assert found == Counter(tuple(plain(r[names.index(c)]) for c in got.columns) for r in want.fetchall()) and found


def sharded(spark, rows):
    return fragments.shard(spark.createDataFrame(rows, SPANS))


def test_normal_form(spark):
    rows = [(1, 0, "café   x \ty", 9), (1, 1, "café x y", 4), (1, 2, " \t　", 1), (1, 3, "", 1), (1, 4, None, 1)]
    got = sharded(spark, rows).collect()
    assert {(r.place, r.text, r.id) for r in got} == {(p, "café x y", hashlib.sha256("café x y".encode()).hexdigest()) for p in (0, 1)}


def test_the_first_span_wins_and_a_load_run_again_adds_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    one, two = sharded(spark, [(2, 0, "a  b", 7), (1, 5, "a b", 5), (1, 9, "c", 1)]), sharded(spark, [(0, 0, "a b", 3), (0, 1, "d", 2), (0, 2, "d", 8)])
    fragments.put(one, folder, 0)
    for _ in range(3):
        fragments.put(two, folder, 1)
        found = {(r.text, r.tokens, r.owner, r.load) for r in fragments.stored(spark, folder).collect()}
        assert found == {("a b", 5, 1, 0), ("c", 1, 1, 0), ("d", 2, 0, 1)} and fragments.stored(spark, folder).count() == 3
    # as a driver that died after a later load's files would find it
    fragments.put(one, folder, 0)
    assert fragments.stored(spark, folder).count() == 3


def test_no_store_and_no_spans(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert fragments.stored(spark, folder).collect() == []
    fragments.put(sharded(spark, []), folder, 0)
    assert fragments.stored(spark, folder).collect() == [] and fragments.delta(sharded(spark, []), fragments.stored(spark, folder), 0).collect() == []


def test_delta_sends_what_the_other_side_lacks(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    fragments.put(sharded(spark, [(1, 0, "shared rules", 10), (1, 1, "old", 2)]), folder, 0)
    fragments.put(sharded(spark, [(2, 0, "shared rules", 99), (2, 1, "new task", 5)]), folder, 1)
    asked = sharded(spark, [(7, 3, "shared  rules", 1), (7, 1, "new task", 1), (7, 2, "never stored", 1), (8, 0, "never stored", 1), (9, 0, "old", 1), (9, 1, "old", 1)])
    got = {r.owner: (r.hits, r.misses, r.total_tokens, r.sent_tokens, r.saved_tokens, r.compression, r.text) for r in fragments.delta(asked, fragments.stored(spark, folder), 0).collect()}
    nowhere = "{{" + hashlib.sha256(b"never stored").hexdigest() + "}}"
    assert got == {7: (1, 2, 15, 5, 10, 0.666667, f"new task\n{nowhere}\nshared rules"), 8: (0, 1, 0, 0, 0, 0.0, nowhere), 9: (2, 0, 4, 0, 4, 1.0, "old\nold")}


def at(day, hour):
    return datetime.datetime(2024, 1, day, hour)


def test_versions_across_days_and_skews(spark):
    rows = [(1, 5, at(1, 1), 1, False), (2, 5, at(1, 2), 2, True), (3, 5, at(2, 1), 3, True), (3, 5, at(2, 1), 4, True), (4, 5, at(4, 0), 5, False), (1, 6, at(1, 1), 6, True), (2, 6, at(1, 1), 7, False), (1, 7, at(1, 1), 8, False), (2, 7, at(1, 3), 9, True), (None, 5, at(1, 1), 10, True), (1, None, at(1, 1), 11, True), (1, 5, None, 12, True)]
    held = fragments.versions(spark.createDataFrame(rows, EVENTS))
    assert {(r.owner, r.fragment, r.version) for r in held.collect()} == {(1, 5, 0), (2, 5, 1), (3, 5, 3), (4, 5, 3), (1, 6, 1), (2, 6, 1), (1, 7, 0), (2, 7, 1)}
    skews = fragments.skews(held)
    assert {tuple(r) for r in skews.collect()} == {(5, 4, 3, "HIGH", 3, 2), (7, 2, 1, "LOW", 1, 1)}
    strict = {r.fragment: (r.block, r.message) for r in fragments.resolved(skews, True).collect()}
    assert strict[7] == (True, "Blocking until refreshed: 1 of 2 owners hold an old version (severity LOW)")
    assert not any(r.block for r in fragments.resolved(skews, False).collect())


def test_many_owners_are_severe_whatever_the_gap(spark):
    held = spark.createDataFrame([(k, f, int(k == 0)) for f, n in ((1, 5), (2, 4), (3, 2), (4, 1)) for k in range(n)], "owner long, fragment long, version long")
    assert {(r.fragment, r.severity) for r in fragments.skews(held).collect()} == {(1, "HIGH"), (2, "MEDIUM"), (3, "LOW")}
