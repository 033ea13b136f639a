"""Queries over the hand-written transcripts against their oracles and against cases read off the scripts; like vectors, folds."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators import folds, similar
from flowgauge.plans import fold_queries, ratio_plans, sample_plans
from flowgauge.sources import samples, transcripts


def rows(found, names):
    order = sorted(names)
    return sorted(str([round(r[names.index(n)], 6) if isinstance(r[names.index(n)], float) else r[names.index(n)] for n in order]) for r in found)


@pytest.fixture(scope="module")
def frames(spark):
    events = sample_plans.sample_events(spark).cache()
    return {"e": events, "s": sample_plans.steps(events).cache()}


@pytest.mark.parametrize("plan", sample_plans.PLANS + ratio_plans.PLANS, ids=lambda p: p.name)
def test_sample_queries_equal_their_oracles(spark, frames, plan):
    got = plan.apply(spark, **{k: v for k, v in frames.items() if f"{{{k}}}" in plan.sql})
    want = duckdb.sql(plan.hand_oracle)
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(map(tuple, got.collect()), got.columns)
    assert found == rows(want.fetchall(), want.columns) and found


@pytest.fixture(scope="module")
def given(spark, sf_dir):
    events = sample_plans.given_events(spark, sf_dir).cache()
    return {"e": events, "s": sample_plans.steps(events).cache()}


#: On the smallest tables nothing happens often enough for these.
RARE = {"w13_edits_in_a_row", "w17_denied_retries", "d7_round_trips", "d9_handoff_done_again", "d10_restated_reasoning", "d13_too_much_context", "j8_handoff_overlap", "w19_reads_since_write", "w21_verbose_thinking"}


@pytest.mark.parametrize("plan", sample_plans.PLANS + ratio_plans.PLANS, ids=lambda p: p.name)
def test_queries_over_given_tables_equal_their_oracles(spark, given, sf_dir, plan):
    d = duckdb.connect()
    for t in ("events", "conversations"):
        d.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = plan.apply(spark, **{k: v for k, v in given.items() if f"{{{k}}}" in plan.sql})
    want = d.execute(plan.oracle)
    names = [c[0] for c in want.description]
    found = rows(map(tuple, got.collect()), got.columns)
    assert found == rows(want.fetchall(), names) and (found or plan.name in RARE)


def test_labels_of_every_tier(spark, given):
    from flowgauge.plans.ratio_plans import PLANS

    labels = next(p for p in PLANS if p.name == "w24_label_cascade").apply(spark, e=given["e"]).collect()
    assert {(r.phase, r.label) for r in labels} >= {("reasoning", "redundant_reasoning"), ("reasoning", "aligned_reasoning"), ("tool_use", "unnecessary_tool_call"), ("tool_use", "aligned_tool_call"), ("generation", "over_explanation"), ("generation", "aligned_response")}
    assert {r.reason for r in labels} >= {"repetition", "low_information_reasoning", "low_relevance_generation", "novel_or_below_threshold"}


def intent(spark, prompts):
    from flowgauge.plans.ratio_plans import PLANS

    events = spark.createDataFrame([("x", k, "intent.stated", p) for k, p in enumerate(prompts, 1)], "session_id string, sequence long, kind string, text string")
    (row,) = next(p for p in PLANS if p.name == "b4_latest_topic_intent").apply(spark, e=events).collect()
    return row


def test_the_latest_topic_is_the_intent_in_force(spark):
    first, second = "Fix the parser so that commas are kept in rows.", "Draw a chart of monthly sales by region and customer."
    row = intent(spark, [first, second, "ok", "Draw a chart of monthly sales by region and product."])
    assert (row.topic_start, row.topic_prompts, row.shifts) == (2, 3, 1) and "chart" in row.leading + " chart" and row.confidence == 0.86
    # an acknowledgement is no evidence of a shift, and stays with its topic
    assert intent(spark, [first, "Go ahead.", "thanks"]).shifts == 0
    # a correction is a refinement unless it is very far off
    assert intent(spark, [first, "Actually, fix the parser so that tabs are kept in cells."]).shifts == 0
    assert intent(spark, ["ok"]).confidence == 0.2


def test_simple_commands_equal_their_oracle(spark):
    got, want = sample_plans.commands(sample_plans.sample_steps(spark)), duckdb.sql(sample_plans.P12_ORACLE.replace(sample_plans.GIVEN, sample_plans.HAND))
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def found(spark, frames, name):
    plan = next(p for p in sample_plans.PLANS if p.name == name)
    return plan.apply(spark, **{k: v for k, v in frames.items() if f"{{{k}}}" in plan.sql}).collect()


def test_interleaved_results_go_to_their_calls(spark, frames):
    odd = {r.name: (r.request_idx, r.completion_idx) for r in found(spark, frames, "j1_request_completion") if r.session_id == "odd"}
    assert odd["Read"][1] > odd["Bash"][1] > odd["Bash"][0] > odd["Read"][0]
    assert [r.call_id for r in found(spark, frames, "j2_orphan_results")] == ["i9"]


def test_two_are_too_few(spark, frames):
    assert not [r for r in found(spark, frames, "w12_reads_of_three") if r.path == "docs/shot.png"]
    assert not [r for r in found(spark, frames, "w16_commands_of_three") if r.command == "make test"]
    assert not [r for r in found(spark, frames, "d7_round_trips") if r.path == "src/other.py"]


def test_findings_read_off_the_scripts(spark, frames):
    all_ = {(r.session_id, r.detector) for r in found(spark, frames, "u1_all_findings")}
    assert ("rework", "rework_cycle") in all_ and ("handoff", "unnecessary_handoff") in all_ and ("rewrite", "regeneration") in all_
    assert ("planning", "repeated_reasoning") in all_ and ("context", "excessive_context") in all_ and ("context", "insufficient_context") in all_
    assert ("rereads", "unvalidated_implementation") not in all_ and ("rework", "unvalidated_implementation") not in all_


def test_repeats_after_a_revert_or_a_prompt_are_none(spark, frames):
    again = {(r.session_id, r.idx) for r in found(spark, frames, "d1_same_call_again")}
    steps = {(r.session_id, r.idx): r.command for r in frames["s"].where("kind = 'request'").collect()}
    assert [steps[k] for k in sorted(again) if k[0] == "repeats"] == ["systemctl list-units", "systemctl list-units", "make test", "uptime"]


def test_planning_is_judged_by_what_it_adds(spark, frames):
    out = folds.excessive_planning(frames["s"])
    want = duckdb.sql(fold_queries.oracle_sql()["d6_excessive_planning"].replace(sample_plans.GIVEN, sample_plans.HAND))
    assert rows(map(tuple, out.collect()), out.columns) == rows(want.fetchall(), want.columns)
    assert folds.excessive_planning(frames["s"], least=20).collect() == []


def test_sample_lines_are_valid_and_numbered(spark):
    assert transcripts.records(samples.raw(spark)).where("type is null").count() == 0
    assert len({(f, n) for f, n, _ in samples.rows()}) == len(samples.rows())


def test_like_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    table = [(k % 2, k, (base[k % 40] + rng.normal(size=6) * 0.1 * (k >= 40)).tolist()) for k in range(120)] + [(0, 500, [0.0] * 6), (1, 501, None), (2, 502, [1.0] * 6)]
    frame = spark.createDataFrame(table, "session_id int, seq long, vec array<float>")
    vectors = [(s, q, np.array(v, np.float32).astype(float)) for s, q, v in table if v and any(v)]
    cosine = lambda a, b: math.floor(a @ b / math.sqrt((a @ a) * (b @ b)) * 1e4 + 0.5) / 1e4
    want = {(s, r, q) for s, q, v in vectors for t, r, w in vectors if s == t and q < r and cosine(v, w) >= 0.9}
    for block in (7, 1024):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = similar.pairs(frame, 0.9).collect()
        assert {(r.session_id, r.seq, r.earlier) for r in got} == want and len(got) == len(want)
        firsts = {(r.session_id, r.seq): r.earlier for r in similar.pairs(frame, 0.9, first=True).collect()}
        assert firsts == {(s, r): min(q for t, x, q in want if (t, x) == (s, r)) for s, r, _ in want}
    shares = {r.session_id: (r.total, r.redundant) for r in similar.redundancy(frame, 0.9).collect()}
    assert shares == {s: (sum(x[0] == s for x in table), len({q for t, r, e in want if t == s for q in (r, e)})) for s in (0, 1, 2)}


def test_folds_take_sessions_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        table = spark.createDataFrame([(k % 5 if k % 5 else None, k) for k in range(200)], "session_id long, seq long").repartition(3)
        sums = lambda p: p.iloc[:1].assign(n=len(p), sorted=p["seq"].is_monotonic_increasing)[["session_id", "n", "sorted"]]
        got = folds.fold(table, "session_id", ["seq"], sums, "session_id long, n long, sorted boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.session_id or 0, r.n, r.sorted) for r in got) == [(k, 40, True) for k in range(5)]
    assert folds.fold(table.limit(0), "session_id", ["seq"], sums, "session_id long, n long, sorted boolean").collect() == [] and F is not None
