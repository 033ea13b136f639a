"""Plans that find waste and risk in session events, and charge it: detectors, their union, allocation and scorecard."""

from __future__ import annotations

from flowgauge.plans.catalog import Plan

#: Each detector's branch: session_id, seq (where it is seen), detector, waste, kind, confidence and charged tokens.
BASE = """
f as (select *, cast(sum(case when kind = 'prompt' then 1 else 0 end) over (partition by session_id order by seq) as bigint) as segment,
  cast(sum(case when kind = 'edit' then 1 else 0 end) over (partition by session_id order by seq) as bigint) as edits,
  cast(sum(case when kind = 'edit' then 1 else 0 end) over (partition by session_id, path order by seq) as bigint) as path_edits,
  count(case when kind in ('read', 'prompt') then 1 end) over (partition by session_id, path order by seq rows between unbounded preceding and 1 preceding) as path_known,
  count(case when kind = 'read' then 1 end) over (partition by session_id order by seq) as reads from {e})"""
D1 = """d1 as (select session_id, seq, 'repeated_tool_call' as detector, 'over_processing' as waste, 'waste' as kind, case when edits = prev_edits then 0.9 when outcome is not null then 0.85 else 0.75 end as confidence, tokens
  from (select *, lag(seq) over (partition by session_id, segment, path order by seq) as prev, lag(edits) over (partition by session_id, segment, path order by seq) as prev_edits from f where kind = 'check') x where prev is not null)"""
D2 = """d2 as (select session_id, seq, 'repeated_exploration' as detector, 'motion' as waste, 'waste' as kind, case when path_edits = prev_edits then 0.85 else 0.55 end as confidence, tokens
  from (select *, lag(path_edits) over (partition by session_id, path order by seq) as prev_edits from f where kind = 'read') x where prev_edits is not null and path_edits = prev_edits)"""
D3 = """d3 as (select session_id, next_seq as seq, 'rework_cycle' as detector, 'rework' as waste, 'waste' as kind, case when prev_failed then 0.9 else 0.8 end as confidence, next_tokens as tokens
  from (select *, lead(seq) over w as next_seq, lead(outcome) over w as next_outcome, lead(edits) over w as next_edits, lead(tokens) over w as next_tokens, coalesce(lag(outcome) over w = 'failed', false) as prev_failed from f where kind = 'check' window w as (partition by session_id order by seq)) x
  where outcome = 'failed' and next_outcome = 'failed' and next_edits > edits)"""
D4 = """d4 as (select session_id, max(seq) as seq, 'unvalidated_implementation' as detector, 'defects' as waste, 'risk' as kind, case when max(case when kind = 'check' then seq end) is null then 0.75 else 0.85 end as confidence, cast(0 as bigint) as tokens
  from f group by session_id, segment having max(case when kind = 'edit' then seq end) > coalesce(max(case when kind = 'check' then seq end), 0))"""
D5 = """d5 as (select session_id, min(seq) as seq, 'premature_implementation' as detector, 'defects' as waste, 'risk' as kind, case when min(reads) = 0 then 0.45 else 0.75 end as confidence, cast(0 as bigint) as tokens
  from f where kind = 'edit' and path_known = 0 and path_edits = 1 group by session_id, path)"""
D7 = """d7 as (select session_id, max(seq) as seq, 'fragmented_edits' as detector, 'motion' as waste, 'waste' as kind, least(0.85, 0.7 + 0.05 * (count(*) - 3)) as confidence, cast(sum(tokens) - min_by(tokens, seq) as bigint) as tokens
  from (select *, row_number() over (partition by session_id order by seq) - row_number() over (partition by session_id, path order by seq) as island from f where kind = 'edit') x group by session_id, path, island having count(*) >= 3)"""
D8 = """d8 as (select session_id, seq, 'unused_context' as detector, 'inventory' as waste, 'waste' as kind, 0.55 as confidence, tokens
  from (select *, max(seq) over (partition by session_id, path) as last_touch, row_number() over (partition by session_id, path order by seq) as nth from f where kind in ('read', 'edit')) x where kind = 'read' and nth = 1 and last_touch = seq)"""
D13 = """d13 as (select session_id, min(seq) as seq, 'excessive_context' as detector, 'inventory' as waste, 'waste' as kind, least(0.65, 0.55 + 0.02 * (count(distinct case when kind = 'read' and edits = 0 then path end) - 3 * count(distinct case when kind = 'edit' then path end) - 3)) as confidence, cast(0 as bigint) as tokens
  from f group by session_id having max(edits) > 0 and count(distinct case when kind = 'read' and edits = 0 then path end) >= 3 * count(distinct case when kind = 'edit' then path end) + 5)"""
D14 = """d14 as (select session_id, seq, 'insufficient_context' as detector, 'defects' as waste, 'risk' as kind, 0.7 as confidence, cast(0 as bigint) as tokens
  from (select *, row_number() over (partition by session_id order by seq) as nth from f where kind = 'edit' and path_edits = 1) x where nth > reads)"""
BRANCHES = {"d1": D1, "d2": D2, "d3": D3, "d4": D4, "d5": D5, "d7": D7, "d8": D8, "d13": D13, "d14": D14}
NAMES = {"d1": "repeated_tool_call", "d2": "repeated_exploration", "d3": "rework_cycle", "d4": "unvalidated_implementation", "d5": "premature_implementation", "d7": "fragmented_edits", "d8": "unused_context", "d13": "excessive_context", "d14": "insufficient_context"}
COLUMNS = "session_id, seq, detector, waste, kind, round(cast(confidence as double), 4) as confidence, cast(tokens as bigint) as tokens"
ALL = f"with {BASE.strip()}, {', '.join(BRANCHES.values())}, u as ({' union all '.join(f'select {COLUMNS} from {d}' for d in BRANCHES)})"
#: An event is charged once to its best confident finding of waste, and its rest to its best uncertain one.
CHARGED = ALL + """, r as (select *, row_number() over (partition by session_id, seq, confidence >= 0.7 order by confidence desc, detector) as place from u where kind = 'waste'),
a as (select session_id, seq, max(case when confidence >= 0.7 then 0.8 end) as avoidable, max(case when confidence < 0.7 then 0.5 end) as unsure, max(case when confidence >= 0.7 then detector end) as sure_detector, max(case when confidence < 0.7 then detector end) as unsure_detector from r where place = 1 group by session_id, seq),
s as (select e.session_id, e.seq, e.kind, e.tokens, coalesce(a.avoidable, 0.0) as avoidable, least(coalesce(a.unsure, 0.0), 1.0 - coalesce(a.avoidable, 0.0)) as unsure, a.sure_detector, a.unsure_detector from {e} e left join a on a.session_id = e.session_id and a.seq = e.seq)"""

#: Largest remainders, in another engine's words; Spark's sums are decimal, as a session's total may be a half exactly, and sums of doubles then
#: fall to either side of it by the order in which partitions come.
APPORTIONED_ORACLE = CHARGED + """, g as (select session_id, kind, sum(tokens * (1.0 - avoidable - unsure)) as amount from s group by session_id, kind),
 n as (select *, cast(floor(amount + 1e-9) as bigint) as whole, round(amount - floor(amount + 1e-9), 6) as frac, cast(round(sum(amount) over (partition by session_id)) as bigint) as total from g),
 k as (select *, row_number() over (partition by session_id order by frac desc, kind) as place, total - sum(whole) over (partition by session_id) as missing from n)
 select session_id, kind, whole + case when place <= missing then 1 else 0 end as tokens from k"""

PLANS = [
    *(Plan(f"{d}_{NAMES[d]}", f"with {BASE.strip()}, {BRANCHES[d]} select {COLUMNS} from {d}") for d in BRANCHES),
    Plan("u1_findings_union", ALL + " select *, row_number() over (partition by session_id order by case kind when 'waste' then 0 else 1 end, tokens desc, seq, detector) as rank from u"),
    Plan("o3_top_causes", ALL + " select detector, n, tokens, rank from (select detector, count(*) as n, cast(sum(tokens) as bigint) as tokens, row_number() over (order by sum(tokens) desc, detector) as rank from u group by detector) x where rank <= 6"),
    Plan("a16_allocation_once", CHARGED + " select session_id, seq, round(avoidable, 4) as avoidable, round(unsure, 4) as unsure, sure_detector, unsure_detector from s where avoidable + unsure > 0"),
    Plan("a17_scorecard", CHARGED + """ select session_id, cast(sum(tokens) as bigint) as tokens, round(sum(tokens * avoidable), 4) as avoidable_tokens, round(sum(tokens * unsure), 4) as uncertain_tokens,
 round(1.0 - sum(tokens * (avoidable + unsure)) / nullif(sum(tokens), 0), 4) as flow_efficiency, count(*) filter (where avoidable > 0) as wasteful_steps from s group by session_id"""),
    Plan("a18_apportion", CHARGED + """, g as (select session_id, kind, sum(cast(round(tokens * (1.0 - avoidable - unsure), 4) as decimal(24, 4))) as amount from s group by session_id, kind),
 n as (select *, cast(floor(amount) as bigint) as whole, amount - floor(amount) as frac, cast(round(sum(amount) over (partition by session_id)) as bigint) as total from g),
 k as (select *, row_number() over (partition by session_id order by frac desc, kind) as place, total - sum(whole) over (partition by session_id) as missing from n)
 select session_id, kind, whole + case when place <= missing then 1 else 0 end as tokens from k""", duck=APPORTIONED_ORACLE),
    Plan("a19_value_stream", CHARGED + " select case kind when 'prompt' then 'intent' when 'read' then 'explore' when 'edit' then 'implement' else 'validate' end as stage, count(*) as steps, cast(sum(tokens) as bigint) as tokens, round(sum(tokens * avoidable), 4) as avoidable_tokens from s group by kind"),
    Plan("a20_waste_by_detector", CHARGED + " select sure_detector as detector, count(*) as n, round(sum(tokens * avoidable), 4) as tokens from s where sure_detector is not null group by sure_detector"),
    Plan("a21_pareto", ALL + """, g as (select waste, cast(sum(tokens) as bigint) as tokens from u where kind = 'waste' group by waste)
 select waste, tokens, round(sum(tokens) over (order by tokens desc, waste rows between unbounded preceding and current row) * 1.0 / nullif(sum(tokens) over (), 0), 4) as running_share from g"""),
    Plan("a7_positional_thirds", """
with n as (select session_id, tokens, outcome, row_number() over (partition by session_id order by seq) - 1 as i, greatest(1, cast(floor(count(*) over (partition by session_id) / 3) as bigint)) as third from {e}),
t as (select session_id, tokens, outcome, case when i < third then 'early' when i < 2 * third then 'middle' else 'late' end as part from n)
select session_id, part, count(*) as n, round(sum(case when outcome = 'failed' then tokens else 0 end) * 1.0 / nullif(sum(tokens), 0), 4) as waste_share from t group by session_id, part"""),
    Plan("t5_live_ratio", "select session_id, seq, round(sum(case when outcome = 'failed' or tokens < 5 then 0 else tokens end) over w * 1.0 / nullif(sum(tokens) over w, 0), 4) as ratio from {e} where kind <> 'prompt' window w as (partition by session_id order by seq)"),
    Plan("a26_inventory_reread", """
with r as (select session_id, path, seq, tokens, row_number() over (partition by session_id, path order by seq) as nth from {e} where kind = 'read'),
k as (select session_id, seq, count(case when kind <> 'prompt' then 1 end) over (partition by session_id order by seq rows between 1 following and unbounded following) as carried from {e})
select r.session_id, count(*) as rereads, cast(sum(r.tokens * k.carried) as bigint) as carried_tokens from r join k on k.session_id = r.session_id and k.seq = r.seq where nth > 1 group by r.session_id"""),
    Plan("a28_outcome_verdict", """
with c as (select session_id, path, min(case outcome when 'failed' then 1 else 2 end) as worst from {e} where kind = 'check' group by session_id, path)
select session_id, case when min(worst) = 1 then 'rejected' else 'accepted' end as verdict, count(*) as checks, count(*) filter (where worst = 1) as failed from c group by session_id"""),
    Plan("a29_per_verified_outcome", "select session_id, round(sum(tokens) * 1.0 / nullif(count(case when outcome = 'passed' then 1 end), 0), 4) as tokens_per_outcome, count(case when outcome = 'passed' then 1 end) as outcomes from {e} group by session_id"),
    Plan("k9_task_classification", """
with f as (select *, sum(case when kind = 'prompt' then 1 else 0 end) over (partition by session_id order by seq) as segment from {e}),
t as (select session_id, segment, count(distinct case when kind = 'edit' then path end) as files, count(*) filter (where kind = 'check') as checks, count(distinct case when outcome = 'failed' then path end) as failures from f group by session_id, segment)
select session_id, cast(segment as bigint) as segment, case when files > 0 then 'change' when checks > 0 then 'validate' else 'read_only' end as task, least(3, case when files <= 1 then 1 when files <= 3 then 2 else 3 end + case when failures >= 2 then 1 else 0 end) as complexity from t"""),
]
