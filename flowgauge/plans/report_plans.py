"""Plans behind reports: labels, alignments, combined patterns, contracts, fragments, routing and follow-ups."""

from __future__ import annotations

from flowgauge.plans.catalog import Plan

SEGMENTS = "s as (select *, cast(sum(case when kind = 'prompt' then 1 else 0 end) over (partition by session_id order by seq) as bigint) as segment from {e})"
WORDS = "w as (select session_id, role, seq, length(text) as chars, array_distinct(regexp_extract_all(lower(text), '[a-z]{3,}', 0)) as words from {c})"
#: What stands for a shell habit that a tool of its own would do better, in order.
HABITS = (("Read", "^ *(cat|head|tail) "), ("Grep", "^ *(grep|rg) "), ("Glob", "^ *find "), ("Edit", "^ *sed +-i"), ("Write", "^ *echo .*>"), ("LS", "^ *ls( |$)"))
HABIT = "case " + " ".join(f"when regexp_like(text, '{p}') then '{t}'" for t, p in HABITS) + " else 'none' end"

PLANS = [
    Plan("w18_error_retry_spiral", """
with b as (select *, case when outcome = 'failed' and lag(outcome) over (partition by session_id, path order by seq) = 'failed' then 0 else 1 end as fresh from {e} where kind = 'check'),
i as (select *, sum(fresh) over (partition by session_id, path order by seq) as spiral from b)
select session_id, path, min(seq) as start_seq, count(*) as n, cast(sum(tokens) as bigint) as tokens from i where outcome = 'failed' group by session_id, path, spiral having count(*) >= 3"""),
    Plan("w22_combined_patterns", """
with r as (select session_id, 'repetitive_read' as pattern, min(seq) as start_seq, count(*) as n from {e} where kind = 'read' group by session_id, path having count(*) >= 2),
c as (select session_id, 'repeated_command' as pattern, min(seq) as start_seq, count(*) as n from {e} where kind = 'check' group by session_id, path having count(*) >= 2),
d as (select session_id, 'edit_fragmentation' as pattern, min(seq) as start_seq, count(*) as n from (select *, row_number() over (partition by session_id order by seq) - row_number() over (partition by session_id, path order by seq) as island from {e} where kind = 'edit') x group by session_id, path, island having count(*) >= 2),
u as (select * from r union all select * from c union all select * from d)
select session_id, pattern, start_seq, n, row_number() over (partition by session_id order by start_seq, pattern) as place from u"""),
    Plan("w31_overthinking_novelty", f"""
with {WORDS}, n as (select session_id, role, seq, words, row_number() over (partition by session_id, role order by seq) as i from w),
x as (select session_id, role, seq, i, explode(words) as word from n),
h as (select a.session_id, a.role, a.seq, a.word, max(case when b.word is null then 0 else 1 end) as seen from x a left join x b on b.session_id = a.session_id and b.role = a.role and b.word = a.word and b.i between a.i - 5 and a.i - 1 group by a.session_id, a.role, a.seq, a.word)
select session_id, role, seq, count(*) as n_words, round(avg(1.0 - seen), 4) as novelty from h group by session_id, role, seq"""),
    Plan("w32_merged_spans", "select session_id, kind, min(seq) as start_seq, count(*) as n, cast(sum(tokens) as bigint) as tokens from (select *, row_number() over (partition by session_id order by seq) - row_number() over (partition by session_id, kind order by seq) as island from {e}) x group by session_id, kind, island having sum(tokens) >= 10"),
    Plan("w30_hierarchical_score", """
with f as (select session_id, seq, vec, first_value(vec) over (partition by session_id order by seq) as root, lag(vec) over (partition by session_id order by seq) as sub from {v})
select session_id, seq, round(0.7 * greatest(cosine(vec, sub), 0.0) + 0.3 * cosine(vec, root), 4) as score from f where sub is not null"""),
    Plan("w35_low_alignment_periods", """
with f as (select session_id, seq, vec, first_value(vec) over (partition by session_id order by seq) as root from {v}),
b as (select session_id, seq, case when round(cosine(vec, root), 4) < 0.1 then 1 else 0 end as low from f),
i as (select *, row_number() over (partition by session_id order by seq) - row_number() over (partition by session_id, low order by seq) as island from b)
select session_id, min(seq) as start_seq, max(seq) as end_seq, count(*) as n from i where low = 1 group by session_id, island having count(*) >= 3"""),
    Plan("w37_exploration_labels", f"""
with {SEGMENTS}, p as (select *, max(case when kind = 'prompt' then path end) over (partition by session_id, segment) as asked, count(case when kind = 'edit' then 1 end) over (partition by session_id, segment, path) as edited from s)
select session_id, seq, case when path = asked then 'uncertainty_driven' when edited > 0 then 'intent_directed' else 'aimless' end as label from p where kind = 'read'"""),
    Plan("w44_follow_up_windows", """
with k as (select *, case when row_number() over (partition by session_id, kind, path order by seq) > 1 then 1 else 0 end as again from {e} where kind <> 'prompt'),
w as (select session_id, seq, outcome, sum(again) over (partition by session_id order by seq rows between 10 preceding and 1 preceding) as before, sum(again) over (partition by session_id order by seq rows between 1 following and 10 following) as after from k)
select session_id, seq, cast(coalesce(before, 0) as bigint) as repeats_before, cast(coalesce(after, 0) as bigint) as repeats_after from w where outcome = 'failed'"""),
    Plan("w45_signal_position", "select session_id, seq, count(case when kind in ('read', 'edit', 'check') then 1 end) over (partition by session_id order by seq) as tool_events from {e}"),
    Plan("w29_segment_starts", "select session_id, count(*) as n, count(*) filter (where near < 0.1) as breaks from (select session_id, seq, round(cosine(vec, prev), 4) as near from (select *, lag(vec) over (partition by session_id order by seq) as prev from {v}) x where prev is not null) y group by session_id"),
    Plan("a11_response_alignment", "select session_id, count(*) as n, round(avg(near), 4) as mean, count(*) filter (where near < 0.3) as low from (select session_id, round(cosine(vec, prev), 4) as near from (select *, lag(vec) over (partition by session_id order by seq) as prev from {v}) x where prev is not null) y group by session_id"),
    Plan("a12_cost_weighted_ratio", "select session_id, round(sum(case when outcome = 'failed' then 0 else tokens * 15.0 end) / nullif(sum(tokens * 15.0), 0), 4) as ratio, round(sum(tokens * 15.0) / 1000000.0, 6) as dollars from {e} group by session_id"),
    Plan("a22_dimension_scorecard", """
with m as (select session_id, count(*) filter (where kind = 'read') * 1.0 / count(*) as explore, count(*) filter (where kind = 'edit') * 1.0 / count(*) as change, count(*) filter (where outcome = 'passed') * 1.0 / nullif(count(*) filter (where kind = 'check'), 0) as quality from {e} group by session_id)
select session_id, 'exploration' as dimension, round(explore, 4) as value from m union all select session_id, 'change' as dimension, round(change, 4) as value from m union all select session_id, 'quality' as dimension, round(quality, 4) as value from m"""),
    Plan("a23_value_efficiency", "select session_id, case when count(*) filter (where kind = 'check') = 0 then null when count(*) filter (where outcome = 'passed') = 0 then 0.0 else round(count(*) filter (where outcome = 'passed') * 1.0 / count(*) filter (where kind = 'check'), 4) end as efficiency from {e} group by session_id"),
    Plan("a31_session_rates", "select session_id, round(sum(case when outcome = 'failed' then tokens else 0 end) * 1.0 / nullif(sum(tokens), 0), 6) as failed_rate, round(sum(case when kind = 'read' then tokens else 0 end) * 1.0 / nullif(sum(tokens), 0), 6) as read_rate from {e} group by session_id"),
    Plan("a39_policy_effectiveness", """
with k as (select *, case when row_number() over (partition by session_id, kind, path order by seq) > 1 then 1 else 0 end as again from {e} where kind <> 'prompt'),
w as (select outcome, coalesce(sum(again) over (partition by session_id order by seq rows between 10 preceding and 1 preceding), 0) as before, coalesce(sum(again) over (partition by session_id order by seq rows between 1 following and 10 following), 0) as after from k)
select outcome, count(*) as n, round(avg(case when after = 0 then 1.0 else 0.0 end), 4) as accepted, round(avg(cast(before as double)), 4) as mean_before, round(avg(cast(after as double)), 4) as mean_after from w where outcome is not null group by outcome having count(*) >= 5"""),
    Plan("a40_context_precision_recall", """
with p as (select session_id, path, min(case when kind = 'read' then seq end) as first_read, max(case when kind = 'edit' then seq end) as last_edit, min(case when kind = 'edit' then seq end) as first_edit from {e} where kind in ('read', 'edit') group by session_id, path)
select session_id, round(count(*) filter (where last_edit > first_read) * 1.0 / nullif(count(first_read), 0), 4) as precision_, round(count(*) filter (where first_read < first_edit) * 1.0 / nullif(count(first_edit), 0), 4) as recall_ from p group by session_id"""),
    Plan("a41_value_counts", "select session_id, count(*) filter (where outcome = 'passed') as passed, count(*) filter (where outcome = 'failed') as failed, count(*) filter (where kind = 'read') as explored, count(*) filter (where kind = 'edit') as changed from {e} group by session_id"),
    Plan("b2_waste_breakdown", """
with k as (select kind, outcome, tokens, row_number() over (partition by session_id, kind, path order by seq) as nth from {e} where kind <> 'prompt')
select category, count(*) as n, cast(sum(tokens) as bigint) as tokens, round(sum(tokens * rate) / 1000000.0, 6) as dollars from (select case when outcome = 'failed' then 'failed_check' when nth > 1 and kind = 'read' then 'repeated_read' when nth > 1 then 'repeated_call' else 'none' end as category, tokens, case when kind = 'read' then 3.0 else 15.0 end as rate from k) x where category <> 'none' group by category"""),
    Plan("b3_waste_by_type", "select outcome, kind, cast(sum(tokens) as bigint) as tokens, count(*) as n, row_number() over (order by sum(tokens) desc, kind, outcome nulls first) as place from {e} group by outcome, kind"),
    Plan("b7_prompt_hints", "select session_id, hint, priority from (select session_id, 'run the check before the next edit' as hint, 1 as priority, count(*) filter (where outcome = 'failed') * 1.0 / nullif(count(*) filter (where kind = 'check'), 0) as x from {e} group by session_id union all select session_id, 'name the files to read' as hint, 2 as priority, count(*) filter (where kind = 'read') * 1.0 / count(*) as x from {e} group by session_id) y where x >= 0.5 or priority = 2 and x >= 0.25"),
    Plan("b8_threshold_gate", "select session_id, round(passed, 4) as score, passed >= 0.5 and reads >= 0.1 as met from (select session_id, count(*) filter (where outcome = 'passed') * 1.0 / nullif(count(*) filter (where kind = 'check'), 0) as passed, count(*) filter (where kind = 'read') * 1.0 / count(*) as reads from {e} group by session_id) x where passed is not null"),
    Plan("j13_check_contract", """
with k as (select explode(sequence(0, 19)) as path), v as (select path, count(*) as runs, min(case outcome when 'failed' then 0 else 1 end) as ok from {e} where kind = 'check' group by path)
select cast(k.path as bigint) as path, coalesce(v.runs, 0) as runs, case when v.path is null then 'missing' when v.ok = 0 then 'failed' else 'passed' end as status from k left join v on v.path = k.path""",
         """
with k as (select unnest(range(0, 20)) as path), v as (select path, count(*) as runs, min(case outcome when 'failed' then 0 else 1 end) as ok from {e} where kind = 'check' group by path)
select cast(k.path as bigint) as path, coalesce(v.runs, 0) as runs, case when v.path is null then 'missing' when v.ok = 0 then 'failed' else 'passed' end as status from k left join v on v.path = k.path"""),
    Plan("j16_versions_across_sources", "select fragment, count(distinct source) as sources, count(distinct version) as versions from (select lower(regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+ [^ ]+)', 1)) as fragment, source, sha2(text, 256) as version from {d} where text is not null) x where fragment <> '' group by fragment having count(distinct version) > 1",
         "with x as (select lower(array_to_string(string_split(text, ' ')[1:4], ' ')) as fragment, source, md5(text) as version from {d} where text is not null and len(string_split(text, ' ')) >= 4 and not list_contains(string_split(text, ' ')[1:4], '')) select fragment, count(distinct source) as sources, count(distinct version) as versions from x group by fragment having count(distinct version) > 1"),
    Plan("j17_baseline_delta", """
with h as (select session_id, case when seq <= 10 then 'baseline' else 'candidate' end as half, tokens from {e}), b as (select half, avg(cast(tokens as double)) as mean, count(*) as n from h group by half)
select round(x.mean, 6) as baseline, round(y.mean, 6) as candidate, round(y.mean - x.mean, 6) as delta, x.n as n_baseline, y.n as n_candidate from b x join b y on x.half = 'baseline' and y.half = 'candidate'"""),
    Plan("u4_distinct_events", "select session_id, count(distinct event_id) as events, min(event_id) as first_event, max(event_id) as last_event from {e} group by session_id"),
    Plan("u5_unlisted_evidence", "select distinct path from {e} where kind = 'check' except select distinct path from {e} where kind = 'edit' and outcome is null and path < 50"),
    Plan("g3_role_edges", """
with p as (select session_id, seq, kind, outcome, lag(outcome) over (partition by session_id, kind order by seq) as prev_outcome, lag(seq) over (partition by session_id, kind order by seq) as prev_seq from {e})
select session_id, seq as src, prev_seq as dst, case when outcome = 'passed' and prev_outcome = 'failed' then 'corrects' else 'confirms' end as edge from p where kind = 'check' and prev_seq is not null"""),
    Plan("g5_cooccurrence", f"""
with {SEGMENTS}, d as (select distinct session_id, segment, path from s where kind in ('read', 'edit')), n as (select session_id, segment, count(*) as size from d group by session_id, segment)
select a.path as src, b.path as dst, round(sum(1.0 / n.size), 4) as weight from d a join d b on a.session_id = b.session_id and a.segment = b.segment and a.path < b.path join n on n.session_id = a.session_id and n.segment = a.segment group by a.path, b.path"""),
    # every node is a root; each step's pairs are made distinct, so that paths to one node are walked on once
    Plan("g6_reach_depth3", """
with edges as (select distinct path as src, next_path as dst from (select path, lead(path) over (partition by session_id order by seq) as next_path from {e} where kind = 'edit') x where next_path is not null and next_path <> path),
one as (select src as start, dst as node from edges),
two as (select distinct w.start, g.dst as node from one w join edges g on g.src = w.node),
three as (select distinct w.start, g.dst as node from two w join edges g on g.src = w.node),
walk as (select src as start, src as node, 0 as depth from edges union all select dst as start, dst as node, 0 as depth from edges
  union all select start, node, 1 as depth from one union all select start, node, 2 as depth from two union all select start, node, 3 as depth from three)
select start, node, min(depth) as depth from walk group by start, node"""),
    Plan("g8_stale_fragments", "select session_id, path, max(ts) as last_seen from {e} group by session_id, path having max(ts) < timestamp '2024-01-02 00:00:00'"),
    Plan("k2_fragment_scoring", "select session_id, seq, round(cosine(vec, root) * case when seq % 3 = 0 then 0.4 else 0.3 end, 4) as relevance from (select *, first_value(vec) over (partition by session_id order by seq) as root from {v}) x"),
    Plan("k8_supply_windows", f"with {SEGMENTS} select session_id, segment, min(case when kind = 'read' then seq end) as first_supply, max(seq) as window_end, count(distinct case when kind = 'read' then path end) as supplied from s group by session_id, segment having count(case when kind = 'read' then 1 end) > 0"),
    Plan("k10_routing", f"""
with {SEGMENTS}, t as (select session_id, segment, min(case when outcome = 'failed' then seq end) as signal, count(distinct case when kind = 'edit' then path end) as files from s group by session_id, segment)
select session_id, segment, case when files >= 3 then 'large' else 'small' end as tier, signal is not null as escalates, signal from t"""),
    Plan("k11_countermeasures", """
with k as (select session_id, case when outcome = 'failed' then 'fix the failing check first' when kind = 'read' then 'keep what was read' else 'edit once' end as measure, tokens, row_number() over (partition by session_id, kind, path order by seq) as nth from {e} where kind <> 'prompt')
select measure, cast(sum(tokens) as bigint) as cost, count(*) as n, row_number() over (order by sum(tokens) desc, measure) as place from k where nth > 1 group by measure"""),
    Plan("k13_quick_ratio", f"""
with {WORDS}, p as (select session_id, words as asked from (select *, row_number() over (partition by session_id order by seq) as n from w where role = 'user') x where n = 1)
select w.session_id, count(*) as responses, round(avg(case when size(array_intersect(w.words, p.asked)) >= 0.1 * size(p.asked) then 1.0 else 0.0 end), 4) as ratio from w join p on p.session_id = w.session_id where w.role = 'assistant' group by w.session_id"""),
    Plan("s8_occurrences", "select doc_id, source, cast(dense_rank() over (partition by source order by sha2(text, 256)) - 1 as bigint) as occurrence, row_number() over (partition by source, sha2(text, 256) order by doc_id) as copy from {d}"),
    Plan("s10_stop_merge", """
with m as (select session_id, max(seq) as seq, 1 as late, 'task.completed' as kind from {e} group by session_id), u as (select session_id, seq, 0 as late, kind from {e} union all select * from m)
select session_id, row_number() over (partition by session_id order by seq, late) as sequence, kind, lag(kind) over (partition by session_id order by seq, late) as parent_kind from u"""),
    Plan("s11_marker_placement", """
with m as (select session_id, percentile(cast(seq as double), 0.5) as at from {e} group by session_id)
select e.session_id, floor(m.at) as marker_after, count(*) filter (where e.seq <= m.at) as before_marker, count(*) filter (where e.seq > m.at) as after_marker from {e} e join m on m.session_id = e.session_id group by e.session_id, m.at"""),
    Plan("t6_usage_once", "select session_id, cast(sum(case when nth = 1 then tokens else 0 end) as bigint) as tokens_once, cast(sum(tokens) as bigint) as tokens_all from (select session_id, tokens, row_number() over (partition by session_id, path order by seq) as nth from {e}) x group by session_id"),
    Plan("t11_ledger_records", "select sha2(concat_ws(':', session_id, kind, path), 256) as record_id, count(*) as observations, min(seq) as first_seq from {e} where kind <> 'prompt' group by session_id, kind, path"),
    Plan("p22_overlap_coefficient", f"with {WORDS} select a.session_id, a.seq, b.seq as next_seq, round(size(array_intersect(a.words, b.words)) * 1.0 / greatest(1, least(size(a.words), size(b.words))), 4) as overlap from w a join w b on a.session_id = b.session_id and b.seq = a.seq + 1"),
]
