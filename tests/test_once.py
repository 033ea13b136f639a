"""What grows with the input is read and judged once; the ring of spans and reachable steps against plain rules."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from flowgauge.plans import evidence_plans, ratio_plans, sample_plans
from flowgauge.sources import derived

PLANS = {p.name: p for p in sample_plans.PLANS + ratio_plans.PLANS + evidence_plans.PLANS}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_events_are_read_once_for_all_lines(spark, sf_dir):
    found = derived.lines(spark, sf_dir)
    assert len(re.findall(r"Relation \[event_id", plan_of(found))) == 1
    d = duckdb.connect()
    for t in ("events", "conversations"):
        d.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = d.execute(f"select file, line, value from ({derived.ORACLE})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_a_key_that_is_missing_leaves_out_what_needs_it(spark, tmp_path):
    rows = [(n, "2024-01-01 00:00:00", 1, kind, cents / 100, props) for n, (kind, cents, props) in enumerate([("view", 0, '{"k": 3}'), ("view", 9, "{}"), ("view", 0, "{}"), ("signup", 0, "{}"), ("click", 10, "{}"), ("other", 3, '{"k": 1}')])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = re.sub(r"\{(?!events\}|conversations\})", "{{", re.sub(r"(?<!\{events)(?<!\{conversations)\}", "}}", derived.LINES))
    want = spark.sql(text, **{t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("events", "conversations")})
    assert sorted(map(str, derived.lines(spark, str(tmp_path)).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["u1_all_findings", "d8_unused_reads", "d5_edits_unseen", "d10_restated_reasoning", "g3_edges_of_all_rules", "j10_first_uses"])
def test_steps_that_are_read_often_are_derived_once(spark, sf_dir, name):
    text = plan_of(PLANS[name].run(spark, sf_dir))
    assert "Relation [event_id" not in text and "Relation spark_catalog.default.held_" in text


@pytest.mark.parametrize("name", ["j4_use_result", "w17_denied_retries"])
def test_completions_are_met_without_a_join(spark, sf_dir, name):
    text = plan_of(PLANS[name].run(spark, sf_dir))
    assert len(re.findall(r"Relation \[event_id", text)) == 1


def test_rings_go_across_batches_and_pairs_are_not_columns(spark, sf_dir):
    plan, events = PLANS["w23_repetition_top_match"], sample_plans.given_events(spark, sf_dir).cache()
    assert "MapInArrow" in plan_of(plan.apply(spark, e=events)) and "collect_list" not in plan_of(plan.apply(spark, e=events))
    whole = sorted(map(tuple, plan.apply(spark, e=events).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, plan.apply(spark, e=events).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_walks_stay_where_their_edges_are(spark, sf_dir, monkeypatch):
    import random

    from flowgauge.operators import graphs
    from flowgauge.plans import registry

    draw = random.Random(5)
    rows = [(g, draw.randrange(9), draw.randrange(9)) for g in (None, 1, 2, 3) for _ in range(14)] + [(4, None, 1), (5, 1, 1)]
    edges = spark.createDataFrame(rows, "session_id long, src long, dst long")
    want = {}
    for g, s in {(g, s) for g, s, d in rows if s is not None}:
        rim, depth = {s}, 0
        while rim := {d for k, a, d in rows if k == g and a in rim} - {d for k, a, d in want if (k, a) == (g, s)}:
            depth += 1
            want |= {(g, s, d): depth for d in rim}
    monkeypatch.setattr(graphs, "ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [tuple(r) for r in graphs.closure(edges).collect()]
        sums = {(r.session_id, r.start): (r.parts, r.depth, r.checksum) for r in graphs.reconstruction(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    ends = {k: [(d, n) for (g, s, d), n in want.items() if (g, s) == k and d != s] for k in {k[:2] for k in want}}
    assert sums == {k: (len(x) + 1, max(n for _, n in x), sum(d for d, _ in x) + k[1]) for k, x in ends.items() if x}
    # no join of walks, and no pair of nodes written on the way
    assert "Join" not in plan_of(registry.PLANS["g4_reconstruct"].run(spark, sf_dir))


def test_pairs_of_blocks_are_dealt_to_many_tasks(spark, monkeypatch):
    import numpy as np

    from flowgauge.operators import similar

    monkeypatch.setattr(similar, "BLOCK", 4)
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(1, k, (rng.normal(size=3) + 3).tolist()) for k in range(80)], "session_id long, seq long, vec array<float>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = similar.pairs(vectors, -1.0).select(F.spark_partition_id().alias("p"), "seq", "earlier").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len({r.p for r in found}) > 4 and len({(r.seq, r.earlier) for r in found}) == len(found) == 80 * 79 // 2


def test_prompts_of_the_latest_topic_are_derived_once(spark, sf_dir):
    text = plan_of(PLANS["b4_latest_topic_intent"].run(spark, sf_dir))
    assert "Relation [event_id" not in text and "Relation spark_catalog.default.held_" in text


def test_lines_are_numbered_before_they_are_made(spark, sf_dir):
    # what is moved and sorted is events, not their lines
    text = plan_of(derived.lines(spark, sf_dir))
    assert text.rindex("sessionId") < text.index("Window [row_number") < text.index("RepartitionByExpression [user_id")
