"""Plans over session events, turns and vectors: stream reports, windows, pairings and sequence patterns."""

from __future__ import annotations

from flowgauge.functions.fixed import STOPWORDS
from flowgauge.plans.catalog import Plan

STOP = "('" + "', '".join(STOPWORDS) + "')"
TOKENS = "'[A-Za-z]+|[0-9]+|[^ A-Za-z0-9]'"

PLANS = [
    Plan("a15_stream_report", """
with k as (select *, case when kind in ('read', 'edit') then row_number() over (partition by session_id, kind, path order by seq) else 1 end as nth,
    sum(case when kind = 'check' then 1 else 0 end) over (partition by session_id order by seq) as island from {e}),
p as (select *, sum(case when kind = 'edit' then 1 else 0 end) over (partition by session_id, island order by seq) as pending from k)
select session_id, count(*) as n_events, count(*) filter (where kind = 'prompt') as n_prompts, count(*) filter (where kind = 'read') as n_reads,
  count(*) filter (where kind = 'edit') as n_edits, count(*) filter (where kind = 'check') as n_checks,
  cast(sum(tokens) as bigint) as tokens, cast(coalesce(sum(case when kind = 'prompt' then tokens end), 0) as bigint) as user_tokens,
  count(*) filter (where nth > 1) as duplicate_calls, count(distinct case when kind = 'read' and nth = 2 then path end) as repeated_paths,
  cast(max(pending) as bigint) as peak_unvalidated_edits, round((unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) / 1000000.0, 3) as seconds
from p group by session_id"""),
    Plan("a15_counts_grouping_sets", "select kind, outcome, count(*) as n, cast(sum(tokens) as bigint) as tokens, cast(grouping(kind) as bigint) as all_kinds from {e} group by grouping sets ((kind), (kind, outcome), ())"),
    Plan("a9_token_breakdown", f"select session_id, role, cast(sum(case when length(text) = 0 then 0 else greatest(1, regexp_count(text, {TOKENS})) end) as bigint) as tokens, count(*) as turns from {{c}} group by session_id, role"),
    Plan("w1_duplicate_tool_calls", "select session_id, seq, kind, path, nth from (select *, row_number() over (partition by session_id, kind, path order by seq) as nth from {e} where kind in ('read', 'edit')) x where nth > 1"),
    Plan("w2_repeated_reads", "select session_id, path, count(*) as n_reads, cast(sum(tokens) as bigint) as tokens from {e} where kind = 'read' group by session_id, path having count(*) > 1"),
    Plan("w3_unvalidated_edits", """
with k as (select *, sum(case when kind = 'check' then 1 else 0 end) over (partition by session_id order by seq) as island from {e})
select session_id, cast(max(pending) as bigint) as peak, cast(max_by(pending, seq) as bigint) as at_end from
 (select session_id, seq, sum(case when kind = 'edit' then 1 else 0 end) over (partition by session_id, island order by seq) as pending from k) x group by session_id"""),
    Plan("w4_step_wall_time", "select session_id, seq, kind, round(greatest(0, coalesce((unix_micros(cast(ts as timestamp)) - unix_micros(cast(lag(ts) over (partition by session_id order by seq) as timestamp))) / 1000000.0, 0)), 3) as seconds from {e} where ts is not null"),
    Plan("w6_prompt_segments", "select session_id, segment, count(*) as n_events, min(seq) as first_seq, max(seq) as last_seq from (select *, cast(sum(case when kind = 'prompt' then 1 else 0 end) over (partition by session_id order by seq) as bigint) as segment from {e}) x group by session_id, segment"),
    Plan("w7_final_responses", "select session_id, segment, max(seq) as final_seq from (select *, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by seq) as bigint) as segment from {c}) x where role = 'assistant' group by session_id, segment"),
    Plan("w8_carried_turns", "select session_id, seq, role, count(case when role = 'assistant' then 1 end) over (partition by session_id order by seq rows between 1 following and unbounded following) as carried from {c}"),
    Plan("j5_latest_previous", "select session_id, seq, path, lag(seq) over (partition by session_id, path order by seq) as previous_seq, seq - lag(seq) over (partition by session_id, path order by seq) as distance from {e} where kind in ('read', 'edit')"),
    Plan("j6_next_check", "select session_id, seq, outcome, lead(seq) over (partition by session_id order by seq) as next_seq, lead(outcome) over (partition by session_id order by seq) as next_outcome from {e} where kind = 'check'"),
    Plan("j7_edits_between_checks", "select session_id, seq, outcome, edits - coalesce(lag(edits) over (partition by session_id order by seq), 0) as edits_between from (select *, cast(sum(case when kind = 'edit' then 1 else 0 end) over (partition by session_id order by seq) as bigint) as edits from {e}) x where kind = 'check'"),
    Plan("j9_used_later", "select r.session_id, r.seq, r.path, count(u.seq) as later_edits from {e} r left join {e} u on u.session_id = r.session_id and u.path = r.path and u.kind = 'edit' and u.seq > r.seq where r.kind = 'read' group by r.session_id, r.seq, r.path"),
    Plan("j10_first_use", "select r.session_id, r.seq, r.path, min(u.seq) as first_use from {e} r join {e} u on u.session_id = r.session_id and u.path = r.path and u.seq > r.seq where r.kind = 'read' group by r.session_id, r.seq, r.path"),
    Plan("j15_prompt_response_pairs", """
with s as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by seq) as segment from {c})
select session_id, cast(segment as bigint) as segment, max(case when role = 'user' then text end) as prompt, count(*) filter (where role = 'assistant') as n_responses,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as response_chars from s where segment > 0 group by session_id, segment"""),
    Plan("w9_reasoning_loops", """
with r as (select *, seq - row_number() over (partition by session_id, kind order by seq) as island from {e})
select session_id, kind, min(seq) as start_seq, max(seq) as end_seq, count(*) as n, cast(sum(tokens) as bigint) as tokens from r group by session_id, kind, island having count(*) >= 3"""),
    Plan("w10_duplicate_window5", """
with t as (select *, row_number() over (partition by session_id order by seq) as n from {e} where kind in ('read', 'edit')),
m as (select a.session_id, a.kind, a.path, a.seq, a.tokens, row_number() over (partition by a.session_id, a.kind, a.path order by a.seq) as first_hit
  from (select distinct a.session_id, a.kind, a.path, a.seq, a.tokens from t a join t b on b.session_id = a.session_id and b.kind = a.kind and b.path = a.path and b.n between a.n - 5 and a.n - 1) a)
select session_id, kind, path, seq, tokens from m where first_hit = 1"""),
    Plan("w12_repetitive_reads", "select session_id, path, count(*) as n_reads, cast(sum(tokens) - min_by(tokens, seq) as bigint) as wasted from {e} where kind = 'read' group by session_id, path having count(*) >= 3",
         "with r as (select *, row_number() over (partition by session_id, path order by seq) as nth from {e} where kind = 'read') select session_id, path, max(nth) as n_reads, cast(sum(tokens) filter (where nth > 1) as bigint) as wasted from r group by all having max(nth) >= 3"),
    Plan("w13_edit_fragmentation", """
with d as (select *, row_number() over (partition by session_id order by seq) - row_number() over (partition by session_id, path order by seq) as island from {e} where kind = 'edit')
select session_id, path, min(seq) as start_seq, max(seq) as end_seq, count(*) as n, cast(sum(tokens) as bigint) as tokens from d group by session_id, path, island having count(*) >= 3""",
         "with d as (select *, lag(path) over (partition by session_id order by seq) is distinct from path as fresh from {e} where kind = 'edit'), i as (select *, count(*) filter (where fresh) over (partition by session_id order by seq) as run from d) select session_id, any_value(path) as path, min(seq) as start_seq, max(seq) as end_seq, count(*) as n, cast(sum(tokens) as bigint) as tokens from i group by session_id, run having count(*) >= 3"),
    Plan("w15_failed_retries", "select session_id, count(*) as n_failed, cast(sum(tokens) as bigint) as tokens from {e} where outcome = 'failed' group by session_id"),
    Plan("w16_repeated_commands", "select session_id, path, count(*) as n, cast(sum(tokens) as bigint) as tokens from {e} where kind = 'check' group by session_id, path having count(*) >= 3",
         "select distinct session_id, path, count(*) over k as n, cast(sum(tokens) over k as bigint) as tokens from {e} where kind = 'check' window k as (partition by session_id, path) qualify count(*) over k >= 3"),
    Plan("w19_over_reading", """
with l as (select session_id, path, seq, kind, max(case when kind = 'edit' then seq end) over (partition by session_id, path) as last_edit from {e} where kind in ('read', 'edit'))
select session_id, path, count(*) as n_reads from l where kind = 'read' and (last_edit is null or seq > last_edit) group by session_id, path having count(*) >= 3""",
         "select r.session_id, r.path, count(*) as n_reads from {e} r where r.kind = 'read' and not exists (select 1 from {e} w where w.kind = 'edit' and w.session_id = r.session_id and w.path = r.path and w.seq > r.seq) group by all having count(*) >= 3"),
    Plan("w20_abandoned_approach", """
with p as (select session_id, path, max_by(kind, seq) as last_kind, max(seq) as last_seq, count(*) filter (where kind = 'edit') as n_edits from {e} where kind in ('read', 'edit') group by session_id, path),
o as (select *, max(last_seq) over (partition by session_id) as session_last from p)
select session_id, path, last_seq, n_edits from o where last_kind = 'edit' and last_seq < session_last""",
         "with t as (select * from {e} where kind in ('read', 'edit')) select a.session_id, a.path, a.seq as last_seq, (select count(*) from t b where b.session_id = a.session_id and b.path = a.path and b.kind = 'edit') as n_edits from t a where a.kind = 'edit' and not exists (select 1 from t b where b.session_id = a.session_id and b.path = a.path and b.seq > a.seq) and exists (select 1 from t b where b.session_id = a.session_id and b.path <> a.path and b.seq > a.seq)"),
    Plan("w21_verbose_reading", """
with n as (select *, last_value(case when kind <> 'read' then tokens end) ignore nulls over (partition by session_id order by seq desc rows between unbounded preceding and 1 preceding) as next_other from {e})
select session_id, seq, tokens, next_other, tokens - next_other as excess from n where kind = 'read' and tokens >= 500 and next_other is not null and tokens > 10 * next_other""",
         """
with n as (select *, last_value(case when kind <> 'read' then tokens end ignore nulls) over (partition by session_id order by seq desc rows between unbounded preceding and 1 preceding) as next_other from {e})
select session_id, seq, tokens, next_other, tokens - next_other as excess from n where kind = 'read' and tokens >= 500 and next_other is not null and tokens > 10 * next_other"""),
    Plan("w26_intent_drift", """
with l as (select session_id, seq, vec, lag(vec) over (partition by session_id order by seq) as prev from {v}),
s as (select session_id, seq, round(cosine(vec, prev), 4) as similarity from l where prev is not null)
select session_id, seq, similarity, case when similarity >= 0.6 then 'convergent' when similarity <= 0.4 then 'divergent' else 'stable' end as step from s"""),
    Plan("w33_wip", """
with r as (select session_id, seq, sum(case when kind = 'check' then 1 else 0 end) over (partition by session_id order by seq) as island, kind, outcome from {e}),
s as (select session_id, seq, cast(sum(case when kind = 'edit' then 1 else 0 end) over (partition by session_id, island order by seq) as bigint) as open_edits,
  cast(case when max(case when kind = 'check' then seq end) over (partition by session_id order by seq) = max(case when outcome = 'failed' then seq end) over (partition by session_id order by seq) then 1 else 0 end as bigint) as open_failures from r)
select session_id, seq, open_edits, open_failures, open_edits + open_failures as wip from s"""),
    Plan("w43_drift_slope", """
with n as (select session_id, seq, tokens, count(*) over (partition by session_id order by seq rows between 4 preceding and current row) as n, regr_slope(cast(tokens as double), cast(seq as double)) over (partition by session_id order by seq rows between 4 preceding and current row) as slope from {e})
select session_id, seq, round(slope * n, 6) + 0.0 as drift from n where n >= 2"""),
    Plan("w36_validation_cycles", """
with c as (select session_id, seq, outcome, edits, lead(seq) over (partition by session_id order by seq) as next_seq, lead(edits) over (partition by session_id order by seq) as next_edits, lead(outcome) over (partition by session_id order by seq) as next_outcome
  from (select *, cast(sum(case when kind = 'edit' then 1 else 0 end) over (partition by session_id order by seq) as bigint) as edits from {e}) x where kind = 'check')
select session_id, seq, next_seq, next_edits - edits as edits_between, case when next_outcome = 'failed' then 'rework' else 'iteration' end as verdict from c where outcome = 'failed' and next_edits > edits"""),
    Plan("t7_hook_alerts", """
with k as (select session_id, seq, kind, path, row_number() over (partition by session_id, kind, path order by seq) as nth from {e} where kind <> 'prompt')
select kind, case when kind = 'read' then 'repetitive_read' when kind = 'edit' then 'repeated_edit' else 'repeated_command' end as alert, count(*) as n from k where nth >= 3 group by kind"""),
    Plan("s12_record_coverage", "select session_id, count(*) as n, count(*) filter (where kind = 'prompt') as lifecycle, round(count(*) filter (where kind <> 'prompt') * 1.0 / count(*), 4) as coverage, count(distinct event_id) as distinct_ids from {e} group by session_id"),
    Plan("s22_session_validation", """
with l as (select *, lag(ts) over (partition by session_id order by seq) as prev from {e})
select session_id, bool_or(kind = 'prompt') as has_prompt, bool_or(kind <> 'prompt') as has_work, count(*) filter (where ts < prev) as backward_steps, count(*) filter (where tokens < 0) as negative_tokens, count(*) - count(distinct event_id) as repeated_ids from l group by session_id"""),
    Plan("g1_evidence_edges", """
with p as (select session_id, seq, kind, path, max(case when kind = 'prompt' then seq end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as prompt_seq,
   max(case when kind = 'read' then seq end) over (partition by session_id, path order by seq rows between unbounded preceding and 1 preceding) as read_seq,
   max(case when kind = 'edit' then seq end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as edit_seq from {e})
select session_id, seq as src, prompt_seq as dst, 'motivated_by' as edge from p where prompt_seq is not null and kind = 'edit'
union all select session_id, seq as src, read_seq as dst, 'repeats' as edge from p where read_seq is not null and kind = 'read'
union all select session_id, seq as src, edit_seq as dst, 'validates' as edge from p where edit_seq is not null and kind = 'check'"""),
    Plan("p1_token_count", f"select session_id, seq, case when length(text) = 0 then 0 else cast(greatest(1, regexp_count(text, {TOKENS})) as bigint) end as tokens, cast(greatest(1, floor(length(text) / 4)) as bigint) as quarter_tokens from {{c}}"),
    Plan("p40_complexity", """
with s as (select session_id, seq, regexp_count(lower(text), 'fix|rename|typo') as simple, regexp_count(lower(text), 'add|implement|update') as standard, regexp_count(lower(text), 'architecture|refactor|migrate') as complex, length(text) as n from {c} where role = 'user')
select session_id, seq, case when simple >= standard + case when n > 300 then 1 else 0 end and simple >= complex then 'simple' when standard + case when n > 300 then 1 else 0 end >= complex then 'standard' else 'complex' end as tier from s"""),
    Plan("p19_content_words", f"select session_id, seq, size(array_distinct(filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*(?:[.-][a-z0-9_]+)*', 0), w -> length(w) > 2 and w not in {STOP}))) as n_words from {{c}}",
         f"select c.session_id, c.seq, (select count(distinct w) from unnest(regexp_extract_all(lower(c.text), '[a-z_][a-z0-9_]*([.-][a-z0-9_]+)*')) as t(w) where length(w) > 2 and w not in {STOP}) as n_words from {{c}} c"),
    # the first thirty are found first; only these are ranked in one task
    Plan("o5_top_keywords", f"select keyword, n, row_number() over (order by n desc, keyword) as rank from (select w as keyword, count(*) as n from (select explode(regexp_extract_all(lower(text), '[a-z]{{3,}}', 0)) as w from {{c}}) x where w not in {STOP} group by w order by n desc, keyword limit 30) y"),
]
