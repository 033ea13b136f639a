"""Evidence edges and uses of reads against their oracles, and by cases written by hand."""

from collections import Counter

import duckdb
import pytest

from flowgauge.plans import evidence_plans, sample_plans

PLANS = {p.name: p for p in evidence_plans.PLANS}
SCHEMA = "session_id string, idx long, kind string, tool_kind string, path string, command string, call_key string, intent string, segment long, req long, done long, out string, outcome string, words array<string>, checks boolean, is_edit boolean, is_check boolean"


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    return sample_plans.steps(sample_plans.given_events(spark, sf_dir)).cache()


def table(frame, want, names):
    return Counter(tuple(r) for r in frame.collect()), Counter(tuple(r[names.index(c)] for c in frame.columns) for r in want)


@pytest.mark.parametrize("name", PLANS)
def test_edges_equal_their_oracles(spark, given, sf_dir, name):
    d = duckdb.connect()
    for t in ("events", "conversations"):
        d.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = d.execute(PLANS[name].oracle)
    got, expected = table(PLANS[name].apply(spark, s=given), want.fetchall(), [c[0] for c in want.description])
    assert got == expected and got


@pytest.mark.parametrize("name", PLANS)
def test_edges_of_hand_written_sessions_equal_their_oracles(spark, name):
    want = duckdb.sql(PLANS[name].hand_oracle)
    got, expected = table(PLANS[name].apply(spark, s=sample_plans.sample_steps(spark)), want.fetchall(), want.columns)
    assert got == expected and got


def test_every_rule_has_edges_that_lead_backwards(spark, given):
    for name, kinds in (("g1_edges_of_all_rules", 5), ("g3_edges_of_all_rules", 8)):
        edges = PLANS[name].apply(spark, s=given).collect()
        assert len({r.edge for r in edges}) == kinds and all(r.dst < r.src for r in edges)
        assert max(Counter(edges).values()) == 1


def uses(spark, rows):
    """Steps (idx, kind, tool, path, command, intent, words), one session; a check is one by its intent."""
    full = [("s", i, kind, tool, path, command, None, intent, 1, None, None, None, None, words, intent == "validate", tool in ("fs.edit", "fs.write"), intent == "validate") for i, kind, tool, path, command, intent, words in rows]
    return {(r.idx, r.path, r.use, r.use_idx) for r in PLANS["j10_first_uses"].apply(spark, s=spark.createDataFrame(full, SCHEMA)).collect()}


def test_first_use_of_each_kind(spark):
    read = (1, "request", "fs.read", "src/Row.py", None, None, ["src", "row.py"])
    later = [
        (2, "reasoning", None, None, None, None, ["row.py"]),
        (3, "request", "exec.shell", None, "pytest row.py", "validate", ["pytest", "row.py"]),
        (4, "request", "exec.shell", None, "python row.py", "other", ["python", "row.py"]),
        (5, "request", "fs.edit", "src/b.py", None, None, ["src", "b.py", "row.py"]),
        (6, "request", "fs.edit", "src/Row.py", None, None, ["src", "row.py"]),
        (7, "response", None, None, None, None, ["row.py"]),
        (8, "request", "fs.edit", "src/Row.py", None, None, ["row.py"]),
    ]
    want = {(1, "src/Row.py", u, i) for u, i in (("named_in_decision", 2), ("tested", 3), ("named_in_command", 4), ("named_in_edit", 5), ("edited", 6))}
    assert uses(spark, [read, *later]) == want
    # a read again is used by what follows it alone
    assert uses(spark, [*later[:1], (9, *read[1:])]) == set()


def test_a_name_of_two_files_names_none(spark):
    two = [(1, "request", "fs.read", "a/x.py", None, None, []), (2, "request", "fs.read", "b/x.py", None, None, []), (3, "response", None, None, None, None, ["x.py"]), (4, "request", "fs.edit", "b/x.py", None, None, ["x.py"])]
    assert uses(spark, two) == {(2, "b/x.py", "edited", 4)}


def test_looking_again_is_no_use_but_a_read(spark):
    rows = [(1, "request", "fs.read", "a/x.py", None, None, []), (2, "request", "exec.shell", None, "cat a/x.py 'b/none.py'", "explore", ["cat", "x.py"]), (3, "request", "exec.shell", None, "sed -n 1,5p a/x.py", "other", ["sed", "x.py"]), (4, "response", None, None, None, None, ["x.py"])]
    assert uses(spark, rows) == {(i, "a/x.py", "named_in_decision", 4) for i in (1, 2, 3)}


def test_no_steps_and_nulls(spark):
    assert uses(spark, []) == set()
    assert uses(spark, [(1, "request", "fs.read", None, None, None, None), (2, "request", "exec.shell", None, None, None, None), (3, "response", None, None, None, None, None)]) == set()
    empty = spark.createDataFrame([], SCHEMA)
    assert PLANS["g3_edges_of_all_rules"].apply(spark, s=empty).collect() == []
