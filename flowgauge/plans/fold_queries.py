"""Queries over sequential and vectorised operators, for which SQL has no equal: they have no oracle, and are tested by
hand-written cases and laws instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.functions import scalars, vectorised
from flowgauge.operators import folds, intents, resampling, similar
from flowgauge.operators.steps import steps
from flowgauge.plans import lean_plans, sample_plans
from flowgauge.plans.catalog import Plan
from flowgauge.sources import derived, transcripts
from flowgauge.sources.feeds import feed
from flowgauge.sources.redaction import redact_table
from flowgauge.streaming import engine


def t5_ema_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.ema(feed(spark, sf_dir, "v").select(F.col("session_id").cast("long").alias("session_id"), "seq", "vec"))


def w29_sliding_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.sliding_intents(feed(spark, sf_dir, "v"), )


def k4_knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = feed(spark, sf_dir, "t")
    return folds.knapsack(turns.select("session_id", F.col("turn_id").alias("item"), "tokens", ((F.col("tokens") % 97) / 97.0).alias("relevance")), 8000)


def t9_policy_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = Plan("", lean_plans.ALL + " select * from u").run(spark, sf_dir)
    return folds.interventions(findings.select("session_id", F.col("seq").alias("position"), F.concat_ws(":", "detector", "seq").alias("signal_id"), "detector", "confidence", F.lit(1).alias("n_evidence")))


def d6_excessive_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.excessive_planning(steps(sample_plans.given_events(spark, sf_dir)))


def w11_context_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.pairs(feed(spark, sf_dir, "v"), 0.85, first=True).select("session_id", "seq", F.col("earlier").alias("first_earlier"))


def j14_similar_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.pairs(feed(spark, sf_dir, "v"), 0.75).select("session_id", F.col("earlier").alias("first_seq"), F.col("seq").alias("second_seq"), "similarity")


def a10_prompt_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.redundancy(feed(spark, sf_dir, "v"), 0.75)


def a36_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.bootstrap(feed(spark, sf_dir, "j").select("lang", F.col("doc_id").alias("id"), (F.col("gold") == F.col("pred")).cast("double").alias("score")), "lang")


def a36_bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = feed(spark, sf_dir, "j").where("gold is not null")
    return resampling.intervals(judged.select("lang", F.col("doc_id").alias("id"), (F.col("gold") == 1).alias("gold"), (F.col("pred") == 1).alias("pred")), "lang")


def s21_redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact_table(feed(spark, sf_dir, "d"), ["text"])
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.to_json("redacted").alias("redacted"))


def p5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    count = vectorised.bpe_count(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return feed(spark, sf_dir, "c").select("session_id", "seq", count("text").alias("tokens"))


def p43_hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = feed(spark, sf_dir, "c").where("role = 'user'").select("session_id", "seq", vectorised.embedding("text").alias("vec"))
    return Plan("", "select session_id, seq, round(cosine(vec, prev), 4) as similarity from (select *, lag(vec) over (partition by session_id order by seq) as prev from {v}) x where prev is not null").apply(spark, v=turns)


def p28_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = feed(spark, sf_dir, "c").select("session_id", "seq", F.posexplode(vectorised.segments("text")).alias("place", "span"), "text")
    return turns.select("session_id", "seq", "place", "span.start", "span.end")


def p25_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir, "c").select("session_id", "seq", F.array_join(scalars.key_terms(F.col("text")), " ").alias("terms"))


def _timeline(turns: DataFrame) -> DataFrame:
    return intents.intent_timeline(intents.read_prompts(turns.where("role = 'user'"), F.col("text")).select("session_id", "seq", "terms", "given_up", "turns"))


def w34_intent_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _timeline(feed(spark, sf_dir, "c"))
    return out.select("session_id", "seq", "relation", F.round("similarity", 4).alias("similarity"), F.array_join("intent", " ").alias("intent"))


def d12_intent_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = feed(spark, sf_dir, "c")
    return intents.intent_drift(turns.where("role <> 'user'").select("session_id", "seq", scalars.key_terms(F.col("text")).alias("terms")), _timeline(turns))


def k3_redundancy_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = feed(spark, sf_dir, "c").select("session_id", "seq", vectorised.embedding("text").alias("vec"))
    return intents.prune_redundant(turns)


def p29_tool_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = feed(spark, sf_dir, "e").where("kind <> 'prompt'")
    return calls.select("session_id", "seq", vectorised.tool_fingerprint("kind", F.to_json(F.struct("path"))).alias("fingerprint"))


def t1_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental engine over all events, shuffled and in part delivered twice; equal to the batch report."""
    return engine.replayed(spark, transcripts.records(derived.lines(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (t5_ema_intent, w29_sliding_intents, k4_knapsack, t9_policy_cooldown, d6_excessive_planning, w11_context_restatement, j14_similar_prompts, a10_prompt_redundancy, a36_bootstrap, a36_bootstrap_intervals, s21_redacted_documents, p5_bpe_tokens, p43_hashed_embeddings, p28_segments, p25_key_terms, w34_intent_timeline, d12_intent_drift, k3_redundancy_prune, p29_tool_fingerprints, t1_event_fold)
    return {f.__name__: f for f in found}


COSINE = "list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))"
#: Every pair of a label's vectors, for the oracles of like pairs.
LIKE = f"with p as (select a.label as session_id, a.vec_id as first_seq, b.vec_id as second_seq, round({COSINE}, 4) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)"
#: Runs of planning steps, each step's words against those of the prompt and the run before it.
PLANNED = f"""with recursive {sample_plans.SAID},
p as (select session_id, idx, kind, call_key, words, (select arg_max(x.words, x.idx) from sw x where x.session_id = q.session_id and x.kind = 'prompt' and x.idx < q.idx) as prompt,
  (select count(*) from sw x where x.session_id = q.session_id and x.idx <= q.idx and not (x.kind = 'reasoning' or coalesce(x.tool_kind = 'plan', false))) as run from (select s.*, a.call_key from sw s left join asked a on a.session_id = s.session_id and a.idx = s.idx) q where kind = 'reasoning' or (kind = 'request' and tool_kind = 'plan')),
n as (select *, row_number() over (partition by session_id, run order by idx) as place, count(*) over (partition by session_id, run) as steps, min(idx) over (partition by session_id, run) as first_idx from p),
k as (select n.*, coalesce((select flatten(list(b.words)) from n b where b.session_id = n.session_id and b.run = n.run and b.idx < n.idx), []) || coalesce(prompt, []) as known, exists (select 1 from n b where b.session_id = n.session_id and b.run = n.run and b.idx < n.idx and b.call_key = n.call_key) as same from n),
e as (select *, case kind when 'reasoning' then len(list_filter(words, lambda w: not list_contains(known, w))) <= 0.25 * len(words) else same end as again from k)
select session_id, first_idx as run, idx, round(least(0.9, 0.55 + 0.05 * steps), 4)::double as confidence from e where steps >= 4 and place > 2 and again"""


#: The batch report that the incremental engine must equal: each event, request and call once.
FOLDED = rf"""with {sample_plans.EVENTS},
x as (select *, tool_kind in ('fs.edit', 'fs.write') as edit, coalesce(regexp_matches(raw_command, '^\s*(pytest|ruff|mypy|tox|make\s+(test|check|lint|ci))(\s|$)'), false) as chk from ev),
r as (select session_id, request_id, max(coalesce(cast(json_extract(v, '$.message.usage.input_tokens') as bigint), 0) + coalesce(cast(json_extract(v, '$.message.usage.output_tokens') as bigint), 0)) as used from ev where request_id is not null group by all),
k as (select session_id, count(*) - count(distinct tool_name || ' ' || cast(input as varchar)) as again from ev where kind = 'request' group by all),
m as (select session_id, idx, edit, count(*) filter (where chk) over (partition by session_id order by idx) as island from x where edit or chk),
p as (select session_id, max(n) as peak from (select session_id, island, count(*) filter (where edit) as n from m group by all) y group by all)
select e.session_id, count(*) as n_events, (select count(*) from r where r.session_id = e.session_id) as requests, cast((select sum(used) from r where r.session_id = e.session_id) as bigint) as tokens_used, (select any_value(again) from k where k.session_id = e.session_id) as duplicate_calls, coalesce((select any_value(peak) from p where p.session_id = e.session_id), 0) as peak_unvalidated_edits from ev e group by e.session_id"""
#: One step a row of a session: a new segment where the row is unlike the one before it, or five are in the segment.
SLID = """with recursive v as (select label as session_id, vec_id as seq, cast(embedding as double[]) as e, row_number() over (partition by label order by vec_id) as n from embeddings),
near as (select a.session_id, a.seq, a.n, list_cosine_similarity(a.e, b.e) as near from v a left join v b on b.session_id = a.session_id and b.n = a.n - 1),
walk as (select session_id, seq, n, 0 as segment, 1 as size from near where n = 1 union all
  select x.session_id, x.seq, x.n, w.segment + case when x.near < 0.45 or w.size >= 5 then 1 else 0 end, case when x.near < 0.45 or w.size >= 5 then 1 else w.size + 1 end from walk w join near x on x.session_id = w.session_id and x.n = w.n + 1)
select session_id, seq, segment from walk"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can state."""
    return {
        "w29_sliding_intents": SLID,
        "w11_context_restatement": f"{LIKE} select session_id, second_seq as seq, min(first_seq) as first_earlier from p where similarity >= 0.85 group by all",
        "j14_similar_prompts": f"{LIKE} select * from p where similarity >= 0.75",
        "a10_prompt_redundancy": f"{LIKE}, u as (select session_id, first_seq as seq from p where similarity >= 0.75 union select session_id, second_seq from p where similarity >= 0.75) select e.label as session_id, count(*) as total, count(u.seq) as redundant, round(count(u.seq) / count(*), 4) as score from embeddings e left join u on u.session_id = e.label and u.seq = e.vec_id group by e.label",
        "d6_excessive_planning": PLANNED,
        "t1_event_fold": FOLDED,
    }
