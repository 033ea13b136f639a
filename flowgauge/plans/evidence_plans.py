"""Evidence edges by all their rules: what each step of a session answers, rests on, checks, corrects, repeats or uses.

A session is passed over once: what is in force at a step (prompt, observation, decision, last read of its path, open
failure) are running maxima, and what comes next (check, decision) running minima in falling order, so that a rule costs no
self-join and a frame never starts anew. Several edges of one step are one array; edges only lead backwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowgauge import shared
from flowgauge.operators.steps import steps
from flowgauge.plans.sample_plans import PLANS as SAMPLES
from flowgauge.plans.sample_plans import SAID, Sample, given_events

_found = {p.name: p for p in SAMPLES}
BEFORE = "order by idx rows between unbounded preceding and 1 preceding"
#: In falling order what was before comes next.
AFTER = "order by idx desc rows between unbounded preceding and 1 preceding"
FAILURE = f"last_value(case when kind = 'completion' and outcome in ('failed', 'passed') then struct(outcome, idx) end) ignore nulls over (partition by session_id {BEFORE}) as judged"


def _repeats(of: str) -> str:
    """Edges from a repeated call or thought to the one that it repeats."""
    parts = (("d1_same_call_again", "was"), ("d2_same_look_again", "was"), ("d10_restated_reasoning", "earlier"))
    return " union all ".join(f"select session_id, idx as src, {other} as dst, 'repeats' as edge from ({getattr(_found[name], of)}) r_{name[:3].strip('_')}" for name, other in parts)


#: Reads of files and the first later step that uses each in one of five ways. A file is named by its base name where the
#: session knows one file of that name only; an edit's own path is no naming.
USES = rf"""with f as (select session_id, idx, coalesce(done, idx) as target, tool_kind, path, lower(regexp_extract(path, '([^/]+)$', 1)) as word from {{s}} where kind = 'request' and tool_kind in ('fs.read', 'fs.edit', 'fs.write') and path is not null),
known as (select session_id, path, min(word) as word from f group by session_id, path), named as (select session_id, word, min(path) as path from known group by session_id, word having count(*) = 1),
sh as (select session_id, idx, coalesce(done, idx) as target, coalesce(intent = 'explore', false) or (coalesce(intent = 'other', false) and command rlike '^\\s*sed\\s+-n\\b(?![^;&|]*\\s-i)') as looks, checks, command, words from {{s}} where kind = 'request' and tool_kind = 'exec.shell' and command is not null),
reads as (select session_id, idx, target, path from f where tool_kind = 'fs.read' union all
  select t.session_id, t.idx, t.target, t.path from (select session_id, idx, target, explode(array_distinct(split(command, '[\\s\'";|&<>()=]+'))) as path from sh where looks) t join known k on k.session_id = t.session_id and k.path = t.path),
says as (select session_id, idx, 'named_in_decision' as use, words from {{s}} where kind in ('reasoning', 'response') union all select session_id, idx, 'tested' as use, words from sh where checks union all select session_id, idx, 'named_in_command' as use, words from sh where not looks and not checks
  union all select session_id, idx, 'named_in_edit' as use, filter(words, w -> not contains(concat('/', lower(path), '/'), concat('/', w, '/'))) as words from {{s}} where is_edit and path is not null),
hits as (select h.session_id, n.path, h.idx, h.use from (select session_id, idx, use, explode(words) as word from says) h join named n on n.session_id = h.session_id and n.word = h.word union all select session_id, path, idx, 'edited' as use from f where tool_kind <> 'fs.read'),
rows_ as (select session_id, path, idx, target, 'read' as use from reads union all select session_id, path, idx, cast(null as bigint) as target, use from hits),
nexts as (select session_id, path, idx, target, use, {", ".join(f"min(case when use = '{u}' then idx end) over w as {u}" for u in ("edited", "named_in_edit", "named_in_command", "tested", "named_in_decision"))} from rows_ window w as (partition by session_id, path {AFTER})),
uses as (select session_id, path, idx, target, stack(5, 'edited', edited, 'named_in_edit', named_in_edit, 'named_in_command', named_in_command, 'tested', tested, 'named_in_decision', named_in_decision) as (use, use_idx) from nexts where use = 'read')"""
#: The same in another engine's words: every later step is tried for every read.
USES_ORACLE = r"""with f as (select session_id, idx, coalesce(done, idx) as target, tool_kind, path, lower(split_part(path, '/', -1)) as word from st where kind = 'request' and tool_kind in ('fs.read', 'fs.edit', 'fs.write') and path is not null),
looks as (select * from st where kind = 'request' and tool_kind = 'exec.shell' and (intent = 'explore' or (intent = 'other' and regexp_matches(command, '^sed -n ') and not contains(command, ' -i')))),
reads as (select session_id, idx, target, path, word from f where tool_kind = 'fs.read' union all select l.session_id, l.idx, coalesce(l.done, l.idx), k.path, k.word from looks l join (select distinct session_id, path, word from f) k on k.session_id = l.session_id and list_contains(string_split_regex(l.command, '[\s''";|&<>()=]+'), k.path)),
later as (select r.*, s.idx as use_idx, s.path as own, case when s.is_edit then 'edit' when s.kind in ('reasoning', 'response') then 'named_in_decision' when s.checks then 'tested' else 'named_in_command' end as way, list_contains(w.words, r.word) and not exists (select 1 from f o where o.session_id = r.session_id and o.word = r.word and o.path <> r.path) as says
  from reads r join st s on s.session_id = r.session_id and s.idx > r.idx join sw w on w.session_id = s.session_id and w.idx = s.idx where s.is_edit or s.kind in ('reasoning', 'response') or (s.kind = 'request' and s.tool_kind = 'exec.shell' and s.command is not null and (s.checks or not exists (select 1 from looks l where l.session_id = s.session_id and l.idx = s.idx)))),
ways as (select * exclude (way), way from later where way <> 'edit' and says union all select * exclude (way), 'edited' from later where way = 'edit' and own = path union all select * exclude (way), 'named_in_edit' from later where way = 'edit' and says and own is not null and not list_contains(string_split(lower(own), '/'), word)),
uses as (select session_id, idx, path, target, way as use, min(use_idx) as use_idx from ways group by all)"""

ROLES = """case when kind = 'prompt' then 'intent' when kind = 'completion' then 'observation' when kind = 'reasoning' or (kind = 'request' and coalesce(tool_kind, '') = 'plan') then 'decision' when is_edit then 'change' when kind = 'request' and checks then 'validation' when kind = 'request' then 'action' else 'response' end"""
JUDGED = "judged as (select c.session_id, c.idx, r.outcome from st c join rq r on r.session_id = c.session_id and r.idx = c.req where c.kind = 'completion' and r.outcome in ('failed', 'passed'))"
CORRECTS = "select e.session_id, e.idx as src, (select arg_max(j.idx, j.idx) from judged j where j.session_id = e.session_id and j.idx < e.idx) as dst, 'corrects' as edge from st e where e.is_edit and (select arg_max(j.outcome, j.idx) from judged j where j.session_id = e.session_id and j.idx < e.idx) = 'failed'"

@dataclass(frozen=True)
class Graph(Sample):
    """A query that reads its steps several times: they are written once, so that no grammar is run twice."""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.apply(spark, s=shared.held(steps(given_events(spark, sf_dir))))


PLANS = [
    Graph("j10_first_uses", USES + " select session_id, idx, path, use, use_idx from uses where use_idx is not null", SAID, USES_ORACLE + " select session_id, idx, path, use, use_idx from uses"),
    Graph("g1_edges_of_all_rules", f"""with x as (select *, max(case when kind in ('prompt', 'completion') then idx end) over (partition by session_id {BEFORE}) as observation, max(case when kind = 'prompt' then idx end) over (partition by session_id {BEFORE}) as prompt, {FAILURE},
  max(case when kind = 'completion' and tool_kind = 'fs.read' and path is not null then idx end) over (partition by session_id, path {BEFORE}) as seen, min(case when is_check then idx end) over (partition by session_id {AFTER}) as checked from {{s}}),
e as (select session_id, inline(array_distinct(array(struct(idx as src, case when kind = 'completion' then req end as dst, 'completes' as edge), struct(idx as src, case when kind not in ('prompt', 'completion') then observation end as dst, 'motivated_by' as edge),
  struct(idx as src, case when is_edit then prompt end as dst, 'motivated_by' as edge), struct(idx as src, case when is_edit then seen end as dst, 'motivated_by' as edge), struct(idx as src, case when is_edit and judged.outcome = 'failed' then judged.idx end as dst, 'corrects' as edge),
  struct(case when is_edit then checked end as src, idx as dst, 'validates' as edge)))) from x)
select session_id, src, dst, edge from (select * from e union all {_repeats("sql")}) u where src is not null and dst < src""", SAID, f"""with {JUDGED}, made as (select * from st where kind not in ('prompt', 'completion')),
m as (select g.session_id, g.idx as src, (select max(o.idx) from st o where o.session_id = g.session_id and o.idx < g.idx and o.kind in ('prompt', 'completion')) as dst from made g
  union select g.session_id, g.idx, (select max(o.idx) from st o where o.session_id = g.session_id and o.idx < g.idx and o.kind = 'prompt') from made g where is_edit
  union select g.session_id, g.idx, (select max(o.idx) from st o where o.session_id = g.session_id and o.idx < g.idx and o.kind = 'completion' and o.tool_kind = 'fs.read' and o.path = g.path) from made g where is_edit),
e as (select session_id, src, dst, 'motivated_by' as edge from m where dst is not null union all select session_id, idx, req, 'completes' from st where kind = 'completion' and req is not null union all {CORRECTS}
  union all select c.session_id, c.idx, e.idx, 'validates' from st c join st e on e.session_id = c.session_id and e.idx < c.idx where c.is_check and e.is_edit and not exists (select 1 from st b where b.session_id = c.session_id and b.is_check and b.idx > e.idx and b.idx < c.idx) union all {_repeats("duck")})
select session_id, src, dst, edge from e"""),
    Graph("g3_edges_of_all_rules", USES + f""", r as (select *, {ROLES} as role from {{s}}),
x as (select *, max(case when role = 'intent' then idx end) over (partition by session_id {BEFORE}) as prompt, max(case when role = 'observation' then idx end) over (partition by session_id, segment {BEFORE}) as observation, max(case when role = 'decision' then idx end) over (partition by session_id, segment {BEFORE}) as decision,
  {FAILURE}, min(case when role = 'decision' then idx end) over (partition by session_id, segment {AFTER}) as decided, min(case when role = 'validation' then idx end) over (partition by session_id {AFTER}) as checked from r),
e as (select session_id, inline(array(struct(idx as src, case when role = 'observation' then req end as dst, 'observes' as edge), struct(idx as src, case when role not in ('intent', 'observation') then prompt end as dst, 'pursues' as edge), struct(case when role = 'observation' then decided end as src, idx as dst, 'based_on' as edge),
  struct(idx as src, case when role in ('action', 'change', 'validation') then decision end as dst, 'decided_by' as edge), struct(idx as src, case when role in ('action', 'change', 'validation', 'response') then observation end as dst, 'motivated_by' as edge),
  struct(case when role = 'change' then checked end as src, idx as dst, 'validates' as edge), struct(idx as src, case when role = 'change' and judged.outcome = 'failed' then judged.idx end as dst, 'corrects' as edge))) from x)
select session_id, src, dst, edge from (select * from e union all select distinct session_id, use_idx as src, target as dst, 'uses' as edge from uses) u where src is not null and dst < src""", SAID, USES_ORACLE + f""", {JUDGED}, r as (select *, {ROLES} as role from st), made as (select * from r where role not in ('intent', 'observation')),
e as (select session_id, idx as src, req as dst, 'observes' as edge from r where role = 'observation' and req is not null union all select session_id, idx, (select max(o.idx) from r o where o.session_id = g.session_id and o.idx < g.idx and o.role = 'intent'), 'pursues' from made g
  union all select d.session_id, d.idx, o.idx, 'based_on' from r d join r o on o.session_id = d.session_id and o.segment = d.segment and o.idx < d.idx where d.role = 'decision' and o.role = 'observation' and not exists (select 1 from r b where b.session_id = d.session_id and b.role = 'decision' and b.idx > o.idx and b.idx < d.idx)
  union all select session_id, idx, (select max(o.idx) from r o where o.session_id = g.session_id and o.segment = g.segment and o.idx < g.idx and o.role = 'decision'), 'decided_by' from made g where role not in ('decision', 'response')
  union all select session_id, idx, (select max(o.idx) from r o where o.session_id = g.session_id and o.segment = g.segment and o.idx < g.idx and o.role = 'observation'), 'motivated_by' from made g where role <> 'decision'
  union all select c.session_id, c.idx, e.idx, 'validates' from r c join r e on e.session_id = c.session_id and e.idx < c.idx where c.role = 'validation' and e.role = 'change' and not exists (select 1 from r b where b.session_id = c.session_id and b.role = 'validation' and b.idx > e.idx and b.idx < c.idx)
  union all {CORRECTS} union all select distinct session_id, use_idx, target, 'uses' from uses where target < use_idx)
select session_id, src, dst, edge from e where dst is not null"""),
]
