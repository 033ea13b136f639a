"""Plans of detectors on handoffs, rewrites, routing and change surfaces, and of reports, graphs and bundles over events."""

from __future__ import annotations

from flowgauge.operators import graphs
from flowgauge.plans import lean_plans
from flowgauge.plans.catalog import Plan

SEGMENTED = "f as (select *, sum(case when kind = 'prompt' then 1 else 0 end) over (partition by session_id order by seq) as segment from {e})"
ALL = lean_plans.ALL
#: From each edited path to the one that its session edits next.
EDIT_EDGES = "select distinct path as src, next_path as dst from (select path, lead(path) over (partition by session_id order by seq) as next_path from {e} where kind = 'edit') x where next_path is not null and next_path <> path"

#: A fragment rests on the one edited just before it in a session, where that is of a lower ten.
DEPENDS = "select distinct src, dst from (select lag(path) over (partition by session_id order by seq) as src, path as dst from {e} where kind = 'edit') x where floor(src / 10) < floor(dst / 10)"
#: An edit rests on the last prompt, a check on the last edit and the last check before it, a read on the last read of its path.
EVIDENCE = """select session_id, seq as src, p as dst from (select session_id, seq, kind, max(case when kind = 'prompt' then seq end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as p from {e}) x where kind = 'edit' and p is not null
union select session_id, seq, e from (select session_id, seq, kind, max(case when kind = 'edit' then seq end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as e from {e}) x where kind = 'check' and e is not null
union select session_id, seq, c from (select session_id, seq, kind, max(case when kind = 'check' then seq end) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as c from {e}) x where kind = 'check' and c is not null
union select session_id, seq, r from (select session_id, seq, kind, max(case when kind = 'read' then seq end) over (partition by session_id, path order by seq rows between unbounded preceding and 1 preceding) as r from {e}) x where kind = 'read' and r is not null"""
PLANS = [
    Plan("d15_unused_traversal", f"""
with {SEGMENTED}, r as (select session_id, segment, path, min(seq) as seq, max(tokens) as tokens from f where kind = 'read' group by session_id, segment, path),
u as (select session_id, segment, path, max(seq) as used from f where kind in ('edit', 'check') group by session_id, segment, path)
select r.session_id, r.segment, min(r.seq) as seq, 'unused_traversal' as detector, count(*) as files, cast(sum(r.tokens) as bigint) as tokens, 0.55 as confidence from r left join u on u.session_id = r.session_id and u.segment = r.segment and u.path = r.path where u.used is null or u.used < r.seq group by r.session_id, r.segment having count(*) >= 2"""),
    Plan("w5_opens_attempt", "select session_id, seq, kind from (select session_id, seq, kind, lag(kind) over (partition by session_id order by seq) as prev from {e}) x where kind <> 'prompt' and prev = 'prompt'"),
    Plan("w42_session_control", """
with s as (select session_id, cast(session_id as bigint) as place, sum(case when outcome = 'failed' then tokens else 0 end) * 1.0 / sum(tokens) as x from {e} group by session_id),
m as (select *, abs(x - lag(x) over (order by place)) as moved from s), l as (select avg(x) as centre, avg(moved) as mr from m),
z as (select m.session_id, m.place, m.x, l.centre, l.mr, case when x > centre then 1 else -1 end as side from m join l on l.mr > 0),
g as (select *, sum(side) over (order by place rows between 7 preceding and current row) as run from z)
select session_id, round(x, 4) as x, 'beyond_limits' as signal from g where abs(x - centre) > 2.66 * mr + 1e-9 union all select session_id, round(x, 4) as x, 'run_of_eight' as signal from g where abs(run) = 8"""),
    Plan("a4_waste_summary", ALL + """, g as (select waste, detector, kind, count(*) as n, cast(sum(tokens) as bigint) as tokens from u group by waste, detector, kind)
select *, rank <= 5 as top from (select *, row_number() over (order by tokens desc, detector) as rank from g) x"""),
    Plan("a42_detector_fingerprint", ALL + " select sha2(array_join(array_sort(collect_list(distinct concat(detector, ':', waste, ':', kind))), chr(10)), 256) as fingerprint, count(distinct detector) as detectors from u"),
    Plan("o2_findings_order", ALL + " select session_id, seq, detector, row_number() over (partition by session_id order by case kind when 'waste' then 0 else 1 end, confidence desc, tokens desc, seq, detector) as place from u"),
    Plan("o4_latest_history", "select session_id, place, seq, tokens from (select session_id, seq, tokens, row_number() over (partition by session_id order by seq desc) as place from {t}) x where place <= 5"),
    Plan("o6_comparison", "select lang, round(accuracy, 4) as accuracy, n, row_number() over (order by accuracy desc, lang) as place from (select lang, avg(case when gold = pred then 1.0 else 0.0 end) as accuracy, count(*) as n from {j} group by lang) x"),
    Plan("o7_countermeasures", ALL + """, g as (select waste, count(*) filter (where confidence < 0.7) * 1.0 / count(*) as unsure, cast(sum(tokens) as bigint) as cost, count(distinct session_id) as sessions from u group by waste)
select waste, round(unsure, 4) as unsure, cost, sessions, row_number() over (order by case when unsure >= 0.5 then 1 else 0 end, cost desc, waste) as place from g"""),
    Plan("g2_evidence_ancestors", EVIDENCE, then=graphs.closure, duck=f"""
with recursive x as ({EVIDENCE}), walk as (select session_id, src, dst, 1 as depth from x union select w.session_id, w.src, x.dst, w.depth + 1 from walk w join x on x.session_id = w.session_id and x.src = w.dst)
select session_id, src, dst, min(depth) as depth from walk group by all"""),
    Plan("o8_topological_levels", DEPENDS, then=graphs.levels, duck=f"""
with recursive x as ({DEPENDS}), nodes as (select src as node from x union select dst from x),
walk as (select node, 0 as level from nodes where node not in (select dst from x) union select x.dst, w.level + 1 from walk w join x on x.src = w.node)
select n.node, max(w.level) as level from nodes n left join walk w on w.node = n.node group by n.node"""),
    Plan("g4_reconstruct", EVIDENCE, then=graphs.reconstruction, duck=f"""
with recursive x as ({EVIDENCE}), walk as (select session_id, src, dst, 1 as depth from x union select w.session_id, w.src, x.dst, w.depth + 1 from walk w join x on x.session_id = w.session_id and x.src = w.dst),
near as (select session_id, src, dst, min(depth) as depth from walk group by all)
select session_id, src as start, count(*) + 1 as parts, max(depth) as depth, cast(sum(dst) as bigint) + src as checksum from near group by session_id, src"""),
    Plan("g7_cycles", EDIT_EDGES, then=graphs.shortest_cycles, duck=f"""
with recursive edges as ({EDIT_EDGES}), most as (select count(distinct src) as n from edges),
walk as (select src as start, dst as node, 1 as length from edges union select w.start, g.dst as node, w.length + 1 as length from walk w join edges g on g.src = w.node cross join most where w.node <> w.start and w.length < most.n)
select start as node, min(length) as shortest from walk where node = start group by start"""),
    Plan("k7_context_bundle", """
with i as (select session_id, turn_id, tokens, row_number() over (partition by session_id order by (tokens % 97) desc, turn_id) as nth from {t}),
b as (select session_id, aggregate(array_sort(collect_list(struct(nth, tokens))), struct(cast(8000 as bigint) as room, cast(0 as bigint) as taken, cast(0 as bigint) as used),
  (s, x) -> case when x.tokens <= s.room then struct(s.room - x.tokens as room, s.taken + 1 as taken, s.used + x.tokens as used) else s end) as s from i group by session_id)
select session_id, s.taken, s.used from b""", duck="""
with recursive i as (select session_id, turn_id, tokens, row_number() over (partition by session_id order by (tokens % 97) desc, turn_id) as nth from {t}),
walk as (select session_id, cast(0 as bigint) as nth, cast(8000 as bigint) as room, cast(0 as bigint) as taken, cast(0 as bigint) as used from (select distinct session_id from i) x
 union all select w.session_id, i.nth, case when i.tokens <= w.room then w.room - i.tokens else w.room end, case when i.tokens <= w.room then w.taken + 1 else w.taken end, case when i.tokens <= w.room then w.used + i.tokens else w.used end from walk w join i on i.session_id = w.session_id and i.nth = w.nth + 1)
select session_id, arg_max(taken, nth) as taken, arg_max(used, nth) as used from walk group by session_id"""),
    Plan("k12_prompt_hints", "select session_id, round(x, 4) as share, case when x >= 0.5 then 'strong' when x >= 0.25 then 'mild' else 'none' end as hint from (select session_id, sum(case when kind = 'read' then tokens else 0 end) * 1.0 / nullif(sum(tokens), 0) as x from {e} group by session_id) y"),
    Plan("t2_redelivery", "select session_id, count(*) as events, cast(sum(tokens) as bigint) as tokens from (select session_id, event_id, max(tokens) as tokens from (select session_id, event_id, tokens from {e} union all select session_id, event_id, tokens from {e} where path % 2 = 0) x group by session_id, event_id) y group by session_id"),
    Plan("t3_prefix_snapshots", "select session_id, seq, n, failed, tokens from (select session_id, seq, count(*) over w as n, count(case when outcome = 'failed' then 1 end) over w as failed, cast(sum(tokens) over w as bigint) as tokens from {e} window w as (partition by session_id order by seq)) x"),
]
