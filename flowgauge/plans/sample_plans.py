"""Queries over transcripts that Spark derives from events and conversations: sources, pairings of requests and results,
windows and detectors, each with its full rule and thresholds. An oracle derives the same lines, reads them with another
engine's JSON functions and states the rule again, in other words than the plan's. Tests run the same plans over the
hand-written transcripts of flowgauge.sources.samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import shared
from flowgauge.functions import scalars, shell
from flowgauge.operators.steps import steps
from flowgauge.sources import derived, samples, transcripts


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The lines that the names below stand on: those derived from the given tables, or in tests the hand-written ones.
GIVEN = f"lines as ({derived.ORACLE})"
HAND = "lines(file, line, value) as (values " + ", ".join(f"({_quoted(f)}, {n}, {_quoted(v)})" for f, n, v in samples.rows()) + ")"
STOP = "('" + "', '".join(scalars.fixed.STOPWORDS) + "')"
#: Records, blocks and events, in another engine's words. A block that repeats one of its request is left out.
EVENTS = f"""{GIVEN},
rec as (select file, line, json(value) as v, json_extract_string(value, '$.type') as type, coalesce(json_extract_string(value, '$.uuid'), 'line-' || line) as uuid, json_extract_string(value, '$.sessionId') as session_id,
  json_extract_string(value, '$.requestId') as request_id, json_extract_string(value, '$.timestamp') as ts, coalesce(json_extract_string(value, '$.message.role'), json_extract_string(value, '$.type')) as role, json_extract(value, '$.message.content') as content from lines where trim(value) <> ''),
one as (select *, unnest(case when json_type(content) = 'ARRAY' then from_json(content, '["json"]') else [json_object('type', 'text', 'text', content)] end) as b,
  unnest(case when json_type(content) = 'ARRAY' then range(cast(json_array_length(content) as bigint)) else [0] end) as place from rec where role in ('user', 'assistant') and content is not null),
blk as (select *, json_extract_string(b, '$.type') as block_type, json_extract_string(b, '$.name') as tool_name, coalesce(json_extract_string(b, '$.id'), json_extract_string(b, '$.tool_use_id')) as call_id, json_extract(b, '$.input') as input,
  coalesce(json_extract_string(b, '$.text'), json_extract_string(b, '$.thinking'), case when json_type(b, '$.content') = 'ARRAY' then array_to_string(json_extract_string(b, '$.content[*].text'), ' ') else json_extract_string(b, '$.content') end, '') as text from one),
kept as (select * from (select *, row_number() over (partition by file, session_id, coalesce(request_id, uuid), role, block_type, trim(regexp_replace(text, '\\s+', ' ', 'g')), tool_name, call_id, cast(input as varchar) order by line, place) as copy from blk) where copy = 1),
ev as (select *, cast(row_number() over (partition by session_id order by file, line, place) as bigint) as idx,
  case block_type when 'tool_result' then 'completion' when 'tool_use' then 'request' when 'thinking' then 'reasoning' else case role when 'user' then 'prompt' else 'response' end end as kind,
  case when block_type = 'tool_use' then case when tool_name in ('Read', 'NotebookRead') then 'fs.read' when tool_name in ('Grep', 'Glob', 'LS') then 'fs.search' when tool_name in ('Edit', 'MultiEdit', 'NotebookEdit') then 'fs.edit' when tool_name = 'Write' then 'fs.write'
    when tool_name in ('Bash', 'BashOutput', 'KillShell') then 'exec.shell' when tool_name in ('WebFetch', 'WebSearch') then 'net.fetch' when tool_name in ('Task', 'Agent') then 'agent.handoff' when tool_name in ('TodoWrite', 'ExitPlanMode') then 'plan' else 'other' end end as tool_kind,
  coalesce(json_extract_string(input, '$.file_path'), json_extract_string(input, '$.notebook_path'), json_extract_string(input, '$.path')) as path, json_extract_string(input, '$.command') as raw_command from kept)"""
CHANGE = r"^((pip3?|npm|apt) (install|remove)|git (add|commit|checkout|reset|restore|stash)|mkdir|rm|mv|cp|touch|sed -i|tee)(\s|$)"
CHECK = r"^(pytest|ruff|mypy|tox|make (test|check|lint|ci))(\s|$)"
LOOK = r"^(ls|cat|head|tail|find|grep|rg|tree|pwd|wc|stat|du|echo|git (status|log|diff))(\s|$)"
BAD = r"(\b[1-9][0-9]*\s+(failed|failures?|errors?)\b|(^|\n)(FAILED|FAIL)\b|(^|\n)ERROR[:\s]|Traceback \(most recent call last\)|(^|\n)\w*Error: |command not found)"
GOOD = r"(?i)(\b\d+\s+passed\b|\ball checks passed\b|\bsuccess(fully)?\b|(^|\n)ok\s)"
VARIES = r"(?i)(\bin\s+\d+(\.\d+)?\s*m?s\b|\d+(\.\d+)?s\b|0x[0-9a-f]+)"
WORDS = rf"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z_][a-z0-9_]*([.-][a-z0-9_]+)*'), lambda w: length(w) > 2 and w not in {STOP}))"
#: Requests with their last completions, and all steps.
STEPS = rf"""{EVENTS},
norm as (select *, trim(regexp_replace(raw_command, '\s+', ' ', 'g')) as command, list_transform(string_split_regex(raw_command, '\s*(\|\||&&|[|;&\n(])\s*'), lambda c: regexp_replace(c, '\s+', ' ', 'g')) as heads,
  (select tool_kind || chr(0) || '{{' || string_agg('"' || k || '":' || cast(json_extract(input, '$."' || k || '"') as varchar), ',' order by k) || '}}' from unnest(json_keys(input)) as t(k)) as call_text,
  cast((select count(*) from ev p where p.session_id = ev.session_id and p.kind = 'prompt' and p.idx <= ev.idx) as bigint) as segment from ev),
asked as (select *, substr(sha256(call_text), 1, 16) as call_key, case when raw_command is null then null when len(list_filter(heads, lambda c: regexp_matches(c, '{CHANGE}'))) > 0 then 'change' when len(list_filter(heads, lambda c: regexp_matches(c, '{CHECK}'))) > 0 then 'validate' when regexp_matches(heads[1], '{LOOK}') then 'explore' else 'other' end as intent,
  coalesce(len(list_filter(heads, lambda c: regexp_matches(c, '{CHECK}'))) > 0, false) as checks from norm where kind = 'request'),
met as (select c.session_id, c.idx, c.text, (select max(r.idx) from asked r where r.session_id = c.session_id and r.call_id = c.call_id and r.idx < c.idx) as req from norm c where c.kind = 'completion'),
st as (select n.session_id, n.idx, n.kind, n.text, n.segment, coalesce(a.tool_kind, o.tool_kind) as tool_kind, coalesce(a.tool_name, o.tool_name) as name, coalesce(a.path, o.path) as path, coalesce(a.command, o.command) as command, a.call_key, a.intent, coalesce(a.checks, false) as checks, m.req,
  (select max(d.idx) from met d where d.session_id = n.session_id and d.req = n.idx) as done, coalesce(a.tool_kind in ('fs.edit', 'fs.write'), false) as is_edit, coalesce(a.intent = 'validate', false) as is_check, a.input,
  coalesce(case when a.tool_kind = 'exec.shell' then a.intent = 'explore' else a.tool_kind not in ('fs.edit', 'fs.write', 'plan') end, false) as explores
  from norm n left join asked a on a.session_id = n.session_id and a.idx = n.idx left join met m on m.session_id = n.session_id and m.idx = n.idx left join asked o on o.session_id = n.session_id and o.idx = m.req),
res as (select s.session_id, s.idx, regexp_replace(trim(c.text), '{VARIES}', '#', 'g') as out, case when s.checks then case when regexp_matches(c.text, '{BAD}') then 'failed' when regexp_matches(c.text, '{GOOD}') then 'passed' else 'unknown' end end as outcome,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(c.text, chr(10)), lambda x: regexp_matches(trim(x), '{BAD}')), lambda x: regexp_replace(trim(x), '{VARIES}', '#', 'g')))), chr(10)) as signature from st s join st c on c.session_id = s.session_id and c.idx = s.done),
rq as (select s.*, r.out, r.outcome, r.signature from st s left join res r on r.session_id = s.session_id and r.idx = s.idx where s.kind = 'request')"""
#: Steps with their words, for rules on what was said.
SAID = rf"""{STEPS},
sw as (select *, case when kind = 'completion' and coalesce(tool_kind, '') in ('fs.read', 'fs.edit', 'fs.write') then [] when kind = 'request' then {WORDS.format("(select coalesce(string_agg(json_extract_string(input, '$.\"' || k || '\"'), ' '), '') from unnest(json_keys(input)) as t(k))")} else {WORDS.format("text")} end as words from st)"""


def given_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events of the transcripts derived from the given tables."""
    return transcripts.events_of(transcripts.records(derived.lines(spark, sf_dir)))


def sample_events(spark: SparkSession) -> DataFrame:
    """Those of the hand-written ones, for tests."""
    return transcripts.events_of(transcripts.records(samples.raw(spark)))


def sample_steps(spark: SparkSession) -> DataFrame:
    return steps(sample_events(spark))


@dataclass(frozen=True)
class Sample:
    """A query over the steps {s} or events {e} of transcripts, and the oracle's SELECT over the names above."""

    name: str
    sql: str
    base: str
    duck: str

    def apply(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        return spark.sql(self.sql, **frames)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        events = given_events(spark, sf_dir)
        # what is read more than once is derived once
        once = lambda name, frame: shared.held(frame) if self.sql.count(f"{{{name}}}") > 1 else frame
        return self.apply(spark, **({"s": once("s", steps(events))} if "{s}" in self.sql else {}) | ({"e": once("e", events)} if "{e}" in self.sql else {}))

    @property
    def oracle(self) -> str:
        body = self.duck.strip()
        word = "with recursive " if body.startswith("with recursive ") else "with "
        return word + self.base + (", " + body.removeprefix(word) if body.startswith(word) else " " + body)

    @property
    def hand_oracle(self) -> str:
        """The oracle over the hand-written lines."""
        return self.oracle.replace(GIVEN, HAND)


REQUESTS = """with f as (select *, coalesce(sum(case when is_edit then 1 else 0 end) over w, 0) as edits_before, coalesce(sum(case when kind = 'request' and command rlike '(?:^|[;&|(] *)git +(?:stash|checkout|restore|reset)(?: |$)' then 1 else 0 end) over w, 0) as reverts_before,
  coalesce(sum(case when is_edit then 1 else 0 end) over (partition by session_id, path order by idx rows between unbounded preceding and 1 preceding), 0) as path_edits_before
  from {s} window w as (partition by session_id order by idx rows between unbounded preceding and 1 preceding))"""

PLANS = [
    Sample("j1_request_completion", "select session_id, idx as request_idx, name, done as completion_idx, outcome from {s} where kind = 'request' and done is not null", STEPS,
           "select session_id, idx as request_idx, name, done as completion_idx, outcome from rq where done is not null"),
    Sample("j2_orphan_results", "select session_id, idx, call_id from {s} where kind = 'completion' and req is null", EVENTS,
           "select c.session_id, c.idx, c.call_id from ev c where c.kind = 'completion' and not exists (select 1 from ev r where r.kind = 'request' and r.session_id = c.session_id and r.call_id = c.call_id and r.idx < c.idx)"),
    Sample("j3_open_requests", "select session_id, idx, name from {s} where kind = 'request' and done is null", EVENTS,
           "select r.session_id, r.idx, r.tool_name as name from ev r where r.kind = 'request' and not exists (select 1 from ev c where c.kind = 'completion' and c.session_id = r.session_id and c.call_id = r.call_id and c.idx > r.idx)"),
    Sample("s7_event_stream", "select session_id, sequence, kind, tool_kind, path, sha2(text, 256) as text_sha256, parent_id is null as first_of_session from {e}", EVENTS,
           "select session_id, idx as sequence, case kind when 'prompt' then 'intent.stated' when 'request' then 'tool.requested' when 'completion' then 'tool.completed' else kind end as kind, tool_kind, path, sha256(text) as text_sha256, idx = 1 as first_of_session from ev"),
    Sample("s9_tool_kinds", "select tool_kind, tool_name, count(*) as n from {e} where kind = 'tool.requested' group by tool_kind, tool_name", EVENTS,
           "select tool_kind, tool_name, count(*) as n from ev where kind = 'request' group by all"),
    Sample("p9_call_keys", "select call_key, count(*) as calls, min(idx) as first_idx from {s} where kind = 'request' group by call_key", STEPS, "select call_key, count(*) as calls, min(idx) as first_idx from asked group by call_key"),
    Sample("p10_read_paths", "select session_id, sequence, path from {e} where tool_kind = 'fs.read'", EVENTS, "select session_id, idx as sequence, json_extract_string(input, '$.file_path') as path from ev where tool_kind = 'fs.read'"),
    Sample("p11_tool_stages", "select session_id, idx, case when explores then 'explore' when tool_kind = 'plan' then 'plan' when intent = 'validate' then 'validate' else 'implement' end as stage from {s} where kind = 'request'", STEPS,
           "select session_id, idx, case when tool_kind in ('fs.read', 'fs.search', 'net.fetch', 'agent.handoff', 'other') or intent = 'explore' then 'explore' when tool_kind = 'plan' then 'plan' when intent = 'validate' then 'validate' else 'implement' end as stage from asked"),
    Sample("p13_line_intents", "select session_id, idx, intent, checks from {s} where kind = 'request' and command is not null", STEPS, "select session_id, idx, intent, checks from asked where raw_command is not null"),
    Sample("p15_check_outcomes", "select session_id, idx, outcome from {s} where kind = 'request' and outcome is not null", STEPS, "select session_id, idx, outcome from rq where outcome is not null"),
    Sample("p18_failed_calls", "select session_id, idx, ltrim(text) like '<tool_use_error>%' as failed, case when ltrim(text) like 'File created successfully%' then true when ltrim(text) like 'The file %' and text like '%has been updated%' then false end as created from {s} where kind = 'completion'", EVENTS,
           "select session_id, idx, starts_with(ltrim(text), '<tool_use_error>') as failed, case when starts_with(text, 'File created successfully') then true when regexp_matches(text, '^The file .* has been updated') then false end as created from ev where kind = 'completion'"),
    Sample("w5_segments", "select session_id, segment, count(*) as steps, min(idx) as first_idx, max(case when kind = 'response' then idx end) as final_response from {s} group by session_id, segment", STEPS,
           "select session_id, segment, count(*) as steps, min(idx) as first_idx, max(idx) filter (where kind = 'response') as final_response from st group by all"),
    Sample("w4_wall_time", """with t as (select session_id, idx, coalesce(req, idx) as owner, (unix_micros(ts) - unix_micros(last_value(ts) ignore nulls over (partition by session_id order by idx rows between unbounded preceding and 1 preceding))) / 1000000.0D as gap from {s})
select session_id, owner as idx, round(sum(greatest(0.0D, gap)), 3) as seconds from t where gap is not null group by session_id, owner""", STEPS,
           "with t as (select s.session_id, coalesce(s.req, s.idx) as owner, (select epoch(cast(e.ts as timestamptz)) from ev e where e.session_id = s.session_id and e.idx = s.idx) - (select epoch(cast(arg_max(e.ts, e.idx) as timestamptz)) from ev e where e.session_id = s.session_id and e.idx < s.idx and e.ts is not null) as gap from st s) select session_id, owner as idx, round(sum(greatest(gap, 0)), 3) as seconds from t where gap is not null group by all"),
    Sample("w10_repeats_in_five", """with t as (select *, row_number() over (partition by session_id order by idx) as n from {s} where kind = 'request'),
p as (select *, lag(n) over (partition by session_id, call_key order by n) as before from t), h as (select *, row_number() over (partition by session_id, call_key order by n) as hit from p where n - before <= 5)
select session_id, idx, call_key from h where hit = 1""", STEPS,
           "with t as (select *, row_number() over (partition by session_id order by idx) as n from asked), h as (select a.session_id, a.call_key, min(a.idx) as idx from t a where exists (select 1 from t b where b.session_id = a.session_id and b.call_key = a.call_key and b.n between a.n - 5 and a.n - 1) group by all) select session_id, idx, call_key from h"),
    Sample("w12_reads_of_three", "select r.session_id, r.path, count(*) as reads, cast(sum(floor(length(c.text) / 4)) - min_by(floor(length(c.text) / 4), c.idx) as bigint) as wasted from {s} r join {s} c on c.session_id = r.session_id and c.idx = r.done where r.kind = 'request' and r.tool_kind = 'fs.read' group by r.session_id, r.path having count(*) >= 3", STEPS,
           "with c as (select session_id, path, length(text) // 4 as size, row_number() over (partition by session_id, path order by idx) as nth from st where kind = 'completion' and tool_kind = 'fs.read') select session_id, path, count(*) as reads, cast(sum(size) filter (where nth > 1) as bigint) as wasted from c group by all having count(*) >= 3"),
    Sample("w13_edits_in_a_row", """with d as (select *, row_number() over (partition by session_id order by idx) - row_number() over (partition by session_id, path order by idx) as island from {s} where is_edit)
select session_id, path, min(idx) as start_idx, count(*) as n from d group by session_id, path, island having count(*) >= 3""", STEPS,
           "with d as (select *, lag(path) over (partition by session_id order by idx) is distinct from path as fresh from asked where tool_kind in ('fs.edit', 'fs.write')), i as (select *, sum(cast(fresh as int)) over (partition by session_id order by idx) as island from d) select session_id, any_value(path) as path, min(idx) as start_idx, count(*) as n from i group by session_id, island having count(*) >= 3"),
    Sample("w14_shell_habits", r"""select session_id, habit, count(*) as n from (select session_id, case when command rlike '^\\s*(?:cat|head|tail)\\s' then 'Read' when command rlike '^\\s*(?:grep|rg)\\s' then 'Grep' when command rlike '^\\s*find\\s' then 'Glob' when command rlike '^\\s*sed\\s+-i' then 'Edit' when command rlike '^\\s*echo\\s.*>' then 'Write' when command rlike '^\\s*ls(?:\\s|$)' then 'LS' end as habit from {s} where kind = 'request') x where habit is not null group by session_id, habit""", EVENTS,
           "with h(habit, first_word) as (values ('Read', 'cat'), ('Read', 'head'), ('Read', 'tail'), ('Grep', 'grep'), ('Grep', 'rg'), ('Glob', 'find'), ('LS', 'ls')), w as (select session_id, string_split(trim(raw_command), ' ') as w, raw_command as c from ev where raw_command is not null) select session_id, coalesce(h.habit, case when w[1] = 'sed' and w[2] = '-i' then 'Edit' when w[1] = 'echo' and contains(c, '>') then 'Write' end) as habit, count(*) as n from w left join h on h.first_word = w[1] where h.habit is not null or (w[1] = 'sed' and w[2] = '-i') or (w[1] = 'echo' and contains(c, '>')) group by all"),
    Sample("w16_commands_of_three", r"select session_id, regexp_replace(command, '\\s*\\|\\s*(?:tail|head)\\s+-n?\\s*\\d+\\s*$', '') as command, count(*) as n from {s} where kind = 'request' and command is not null group by session_id, regexp_replace(command, '\\s*\\|\\s*(?:tail|head)\\s+-n?\\s*\\d+\\s*$', '') having count(*) >= 3", STEPS,
           r"select session_id, trim(regexp_replace(regexp_replace(raw_command, '\s+', ' ', 'g'), ' ?\| ?(tail|head) -n? ?[0-9]+ ?$', '')) as command, count(*) as n from asked where raw_command is not null group by all having count(*) >= 3"),
    Sample("w17_denied_retries", r"""with c as (select session_id, idx, kind, name, max_by(case when kind = 'completion' then lower(text) rlike 'permission denied|not permitted|access denied|requires approval' end, case when kind = 'completion' then idx end) over (partition by session_id, coalesce(req, idx)) as denied from {s} where kind = 'request' or req is not null),
r as (select session_id, idx, name, lag(name) over w as was, lag(denied) over w as refused from c where kind = 'request' window w as (partition by session_id order by idx)),
k as (select *, case when was = name and refused then 0 else 1 end as fresh from r), i as (select *, sum(fresh) over (partition by session_id order by idx) as chain from k)
select session_id, min(idx) as start_idx, count(*) - 1 as retries from i group by session_id, chain having count(*) - 1 >= 2""", STEPS,
           "with recursive q as (select s.session_id, s.idx, s.name, row_number() over (partition by s.session_id order by s.idx) as n, (select lower(c.text) from st c where c.session_id = s.session_id and c.idx = s.done) as said from st s where s.kind = 'request'), walk as (select a.session_id, a.n, a.idx as start_idx, 0 as retries from q a where not exists (select 1 from q b where b.session_id = a.session_id and b.n = a.n - 1 and b.name = a.name and regexp_matches(b.said, 'permission denied|not permitted|access denied|requires approval')) union all select w.session_id, b.n, w.start_idx, w.retries + 1 from walk w join q a on a.session_id = w.session_id and a.n = w.n join q b on b.session_id = a.session_id and b.n = a.n + 1 and b.name = a.name and regexp_matches(a.said, 'permission denied|not permitted|access denied|requires approval')) select session_id, start_idx, cast(max(retries) as bigint) as retries from walk group by all having max(retries) >= 2"),
    Sample("w19_reads_since_write", """with l as (select *, max(case when is_edit then idx end) over (partition by session_id, path) as last_edit from {s} where kind = 'request' and path is not null)
select session_id, path, count(*) as n_reads from l where tool_kind = 'fs.read' and idx > coalesce(last_edit, 0) group by session_id, path having count(*) >= 3""", STEPS,
           "select r.session_id, r.path, count(*) as n_reads from asked r where r.tool_kind = 'fs.read' and not exists (select 1 from asked w where w.session_id = r.session_id and w.path = r.path and w.tool_kind in ('fs.edit', 'fs.write') and w.idx > r.idx) group by all having count(*) >= 3"),
    Sample("w20_abandoned_files", """with p as (select session_id, path, max_by(is_edit, idx) as ends_in_edit, max(idx) as last_idx from {s} where kind = 'request' and tool_kind in ('fs.read', 'fs.edit', 'fs.write') group by session_id, path)
select session_id, path, last_idx from (select *, max(last_idx) over (partition by session_id) as session_last from p) x where ends_in_edit and last_idx < session_last""", STEPS,
           "with t as (select * from asked where tool_kind in ('fs.read', 'fs.edit', 'fs.write')) select a.session_id, a.path, a.idx as last_idx from t a where a.tool_kind <> 'fs.read' and not exists (select 1 from t b where b.session_id = a.session_id and b.path = a.path and b.idx > a.idx) and exists (select 1 from t b where b.session_id = a.session_id and b.path <> a.path and b.idx > a.idx)"),
    Sample("w21_verbose_thinking", """with n as (select session_id, idx, kind, tokens, first_value(case when kind not in ('reasoning', 'completion', 'prompt') then tokens end) ignore nulls over (partition by session_id order by idx rows between 1 following and unbounded following) as following from {s})
select session_id, idx, tokens, following, tokens - coalesce(following, 0) as excess from n where kind = 'reasoning' and tokens >= 500 and (following is null or tokens > 10 * following)""", STEPS,
           "with z as (select session_id, idx, kind, len(regexp_extract_all(case when kind = 'request' then name || ' ' || cast(input as varchar) else text end, '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]')) as tokens from st), n as (select z.*, (select arg_min(o.tokens, o.idx) from z o where o.session_id = z.session_id and o.idx > z.idx and o.kind in ('response', 'request')) as following from z) select session_id, idx, cast(tokens as bigint) as tokens, cast(following as bigint) as following, cast(tokens - coalesce(following, 0) as bigint) as excess from n where kind = 'reasoning' and tokens >= 500 and (following is null or tokens > 10 * following)"),
    Sample("w36_cycles_of_checks", REQUESTS + """, c as (select *, lead(idx) over w as next_idx, lead(outcome) over w as next_outcome, lead(signature) over w as next_signature, lead(edits_before) over w as next_edits from f where is_check window w as (partition by session_id, command order by idx))
select session_id, idx, next_idx, cast(next_edits - edits_before as bigint) as fixes, case when next_outcome = 'failed' and next_signature = signature then 'rework' else 'iteration' end as verdict from c where outcome = 'failed' and next_edits > edits_before and next_outcome in ('failed', 'passed')""", STEPS,
           "with c as (select a.*, (select min(b.idx) from rq b where b.session_id = a.session_id and b.is_check and b.command = a.command and b.idx > a.idx) as next_idx from rq a where a.is_check and a.outcome = 'failed'), d as (select c.*, n.outcome as o, n.signature as g, (select count(*) from rq e where e.session_id = c.session_id and e.is_edit and e.idx between c.idx and c.next_idx) as fixes from c join rq n on n.session_id = c.session_id and n.idx = c.next_idx) select session_id, idx, next_idx, fixes, if(o = 'failed' and g = signature, 'rework', 'iteration') as verdict from d where fixes > 0 and o <> 'unknown'"),
    Sample("d1_same_call_again", REQUESTS + r""", p as (select *, lag(idx) over k as was, lag(done) over k as was_done, lag(out) over k as was_out, lag(segment) over k as was_segment, edits_before - lag(edits_before + cast(is_edit as int)) over k as edited,
  reverts_before - lag(reverts_before + cast(coalesce(command rlike '(?:^|[;&|(] *)git +(?:stash|checkout|restore|reset)(?: |$)', false) as int)) over k as reverted from f where kind = 'request' and coalesce(tool_kind, '') not in ('fs.read', 'fs.search') and not coalesce(lower(command) rlike '^(?:sleep|timeout\\s+/t)\\s+\\S+\\s*$', false) window k as (partition by session_id, call_key order by idx))
select session_id, idx, was, case when done is null or was_done is null then 0.5D when is_check then 0.85D when edited > 0 then 0.75D else 0.9D end as confidence from p
where was is not null and segment = was_segment and reverted = 0 and not (is_check and edited > 0) and (done is null or was_done is null or out = was_out)""", STEPS,
           r"with a as (select * from rq where tool_kind not in ('fs.read', 'fs.search') and not coalesce(regexp_matches(command, '^sleep \S+$'), false)), p as (select b.*, (select max(x.idx) from a x where x.session_id = b.session_id and x.call_key = b.call_key and x.idx < b.idx) as was from a b), q as (select p.*, o.done as was_done, o.out as was_out, o.segment as was_segment, exists (select 1 from rq e where e.session_id = p.session_id and e.is_edit and e.idx > p.was and e.idx < p.idx) as edited, exists (select 1 from rq e where e.session_id = p.session_id and regexp_matches(e.command, '(^|[;&|(] *)git (stash|checkout|restore|reset)( |$)') and e.idx > p.was and e.idx < p.idx) as reverted from p join a o on o.session_id = p.session_id and o.idx = p.was) select session_id, idx, was, case when out is null or was_out is null then 0.5::double when is_check then 0.85::double when edited then 0.75::double else 0.9::double end as confidence from q where segment = was_segment and not reverted and not (is_check and edited) and coalesce(out = was_out, true)"),
    Sample("d2_same_look_again", REQUESTS + """, p as (select *, lag(idx) over k as was, lag(done) over k as was_done, lag(out) over k as was_out, case tool_kind when 'fs.read' then path_edits_before - lag(path_edits_before) over k else edits_before - lag(edits_before) over k end as edited
  from f where kind = 'request' and tool_kind in ('fs.read', 'fs.search') window k as (partition by session_id, call_key order by idx))
select session_id, idx, was, case when done is null or was_done is null or (tool_kind = 'fs.read' and out = substr(sha2('', 256), 1, 16)) then 0.55D else 0.85D end as confidence from p where was is not null and edited = 0 and (done is null or was_done is null or out = was_out)""", STEPS,
           "with p as (select b.*, (select max(x.idx) from rq x where x.session_id = b.session_id and x.call_key = b.call_key and x.idx < b.idx) as was from rq b where b.tool_kind in ('fs.read', 'fs.search')), q as (select p.*, o.out as was_out from p join rq o on o.session_id = p.session_id and o.idx = p.was where not exists (select 1 from rq e where e.session_id = p.session_id and e.is_edit and e.idx > p.was and e.idx < p.idx and (p.tool_kind = 'fs.search' or e.path = p.path))) select session_id, idx, was, if(out is null or was_out is null or (tool_kind = 'fs.read' and out = ''), 0.55::double, 0.85::double) as confidence from q where coalesce(out = was_out, true)"),
    Sample("d3_rework", REQUESTS + """, c as (select *, lead(idx) over w as next_idx, lead(outcome) over w as next_outcome, lead(signature) over w as next_signature, lead(edits_before) over w as next_edits from f where is_check window w as (partition by session_id, command order by idx)),
v as (select *, next_outcome = 'failed' and next_signature = signature as same from c where outcome = 'failed' and next_edits > edits_before and next_outcome in ('failed', 'passed')),
i as (select *, sum(case when same then 0 else 1 end) over (partition by session_id, command order by idx) as streak from v), n as (select *, row_number() over (partition by session_id, command, streak, same order by idx) as nth from i)
select session_id, next_idx as idx, command, case nth when 1 then 0.8D else 0.9D end as confidence from n where same""", STEPS,
           "with c as (select a.session_id, a.command, a.idx, a.signature, (select min(b.idx) from rq b where b.session_id = a.session_id and b.is_check and b.command = a.command and b.idx > a.idx) as next_idx from rq a where a.is_check and a.outcome = 'failed'), v as (select c.*, n.outcome = 'failed' and n.signature = c.signature as same from c join rq n on n.session_id = c.session_id and n.idx = c.next_idx where n.outcome <> 'unknown' and exists (select 1 from rq e where e.session_id = c.session_id and e.is_edit and e.idx between c.idx and c.next_idx)) select v.session_id, v.next_idx as idx, v.command, if((select arg_max(o.same, o.idx) from v o where o.session_id = v.session_id and o.command = v.command and o.idx < v.idx), 0.9::double, 0.8::double) as confidence from v where v.same"),
    Sample("d4_unchecked_edits", r"""with x as (select *, max(case when checks then 1 else 0 end) over (partition by session_id) as any_check, max(case when checks then idx end) over (partition by session_id, segment) as last_check, max(case when kind = 'response' then idx end) over (partition by session_id, segment) as final from {s}),
g as (select session_id, segment, max(any_check) as any_check, max(last_check) as last_check, max(final) as final, count(case when is_edit and idx > coalesce(last_check, 0) then 1 end) as pending, max(case when is_edit and idx > coalesce(last_check, 0) then idx end) as last_edit,
  min(case when is_edit and idx > coalesce(last_check, 0) then case when lower(path) rlike '\\.(md|rst|txt|adoc)$' then 1 else 0 end end) as docs, max(case when idx = last_check then outcome end) as outcome from x group by session_id, segment)
select session_id, segment, pending, case when docs = 1 then 0.5D when any_check = 1 then 0.75D else 0.85D end as confidence from g where pending > 0 and final > last_edit and (docs = 0 or pending >= 3)
union all select session_id, segment, pending, 0.85D as confidence from g where final > last_check and outcome = 'failed' and pending = 0""", STEPS,
           r"with seg as (select distinct session_id, segment from st), g as (select seg.*, (select max(idx) from st r where r.session_id = seg.session_id and r.segment = seg.segment and r.kind = 'response') as final, (select max(idx) from rq r where r.session_id = seg.session_id and r.segment = seg.segment and r.checks) as chk, exists (select 1 from rq r where r.session_id = seg.session_id and r.checks) as ever from seg), p as (select g.*, (select list(e.path order by e.idx) from rq e where e.session_id = g.session_id and e.segment = g.segment and e.is_edit and e.idx > coalesce(g.chk, 0)) as files, (select max(e.idx) from rq e where e.session_id = g.session_id and e.segment = g.segment and e.is_edit) as last_edit from g), d as (select p.*, len(list_filter(files, lambda f: not regexp_matches(f, '[.](md|rst|txt|adoc)$'))) = 0 as docs from p) select session_id, segment, len(files) as pending, (case when docs then 0.5 when ever then 0.75 else 0.85 end)::double as confidence from d where len(files) > 0 and final > last_edit and (not docs or len(files) >= 3) union all select d.session_id, d.segment, 0 as pending, 0.85::double as confidence from d join rq c on c.session_id = d.session_id and c.idx = d.chk where d.files is null and d.final > d.chk and c.outcome = 'failed'"),
    Sample("d5_edits_unseen", """with t as (select *, row_number() over (partition by session_id, path order by idx) as nth, max(case when explores then 1 else 0 end) over (partition by session_id order by idx rows between unbounded preceding and 1 preceding) as explored from {s} where kind = 'request'),
w as (select session_id, word, min(idx) as first_idx from (select session_id, idx, explode(words) as word from {s} where (kind = 'completion' and coalesce(tool_kind, '') <> 'fs.read') or (kind = 'request' and tool_kind = 'exec.shell')) y group by session_id, word)
select t.session_id, t.idx, t.path, case t.tool_kind when 'fs.edit' then 0.75D else 0.45D end as confidence from (select *, lower(element_at(split(path, '/'), -1)) as base from t where is_edit) t left join w on w.session_id = t.session_id and w.word = t.base
where not exists (select 1 from {s} k where k.session_id = t.session_id and k.path = t.path and k.idx < t.idx and k.kind = 'request' and k.tool_kind in ('fs.read', 'fs.edit', 'fs.write')) and coalesce(w.first_idx, t.idx) >= t.idx and (t.tool_kind = 'fs.edit' or coalesce(t.explored, 0) = 0)""", SAID,
           "select e.session_id, e.idx, e.path, if(e.tool_kind = 'fs.edit', 0.75::double, 0.45::double) as confidence from sw e where e.is_edit and not exists (select 1 from sw k where k.session_id = e.session_id and k.kind = 'request' and k.path = e.path and k.idx < e.idx and k.tool_kind like 'fs.%' and k.tool_kind <> 'fs.search') and not exists (select 1 from sw k where k.session_id = e.session_id and k.idx < e.idx and list_contains(k.words, lower(regexp_extract(e.path, '[^/]+$'))) and ((k.kind = 'completion' and coalesce(k.tool_kind, '') <> 'fs.read') or (k.kind = 'request' and k.tool_kind = 'exec.shell'))) and (e.tool_kind = 'fs.edit' or not exists (select 1 from sw k where k.session_id = e.session_id and k.idx < e.idx and k.explores))"),
    Sample("d7_round_trips", """with b as (select *, count(case when kind in ('prompt', 'response') or (kind = 'request' and not coalesce(tool_kind = 'fs.edit', false)) or (kind = 'completion' and not coalesce(tool_kind = 'fs.edit', false)) then 1 end) over w as breaks, count(case when kind = 'completion' then 1 end) over w as results from {s} window w as (partition by session_id order by idx)),
e as (select *, case when path = lag(path) over o and breaks = lag(breaks) over o then 0 else 1 end as fresh, case when results > lag(results) over o then 1 else 0 end as waited from b where kind = 'request' and tool_kind = 'fs.edit' window o as (partition by session_id order by idx)),
i as (select *, sum(fresh) over (partition by session_id order by idx) as island from e), t as (select session_id, island, min(path) as path, min(idx) as start_idx, count(*) as n, cast(1 + sum(case when fresh = 0 then waited else 0 end) as bigint) as trips from i group by session_id, island)
select session_id, path, start_idx, n, trips, round(least(0.85D, 0.7D + 0.05D * (trips - 3)), 4) as confidence from t where trips >= 3""", STEPS,
           "with e as (select *, row_number() over (partition by session_id order by idx) as n, lag(idx) over (partition by session_id order by idx) as before, lag(path) over (partition by session_id order by idx) as was from rq where tool_kind = 'fs.edit'), f as (select e.*, before is null or was <> path or exists (select 1 from st x where x.session_id = e.session_id and x.idx > e.before and x.idx < e.idx and x.kind <> 'reasoning' and not (x.kind = 'completion' and coalesce(x.tool_kind = 'fs.edit', false))) as fresh, exists (select 1 from st x where x.session_id = e.session_id and x.idx > e.before and x.idx < e.idx and x.kind = 'completion') as waited from e), g as (select f.*, (select max(o.n) from f o where o.session_id = f.session_id and o.fresh and o.n <= f.n) as run from f) select session_id, any_value(path) as path, min(idx) as start_idx, count(*) as n, 1 + count(*) filter (where waited and not fresh) as trips, round(least(0.85, 0.7 + 0.05 * (1 + count(*) filter (where waited and not fresh) - 3)), 4)::double as confidence from g group by session_id, run having 1 + count(*) filter (where waited and not fresh) >= 3"),
    Sample("d8_unused_reads", r"""with l as (select *, max(case when kind = 'response' then idx end) over (partition by session_id) as last_response, row_number() over (partition by session_id, path, kind, tool_kind order by idx) as nth, lower(element_at(split(path, '/'), -1)) as base from {s}),
r as (select * from l where kind = 'completion' and tool_kind = 'fs.read' and nth = 1 and idx <= last_response and not base rlike '\\.(png|jpg|jpeg|gif|webp|pdf)$'),
n as (select session_id, idx, explode(array_distinct(concat(array(base), case when length(regexp_replace(base, '\\.[^.]*$', '')) >= 4 then array(regexp_replace(base, '\\.[^.]*$', '')) else array() end, transform(idents, x -> lower(x))))) as name from r),
w as (select session_id, word, max(idx) as last_idx from (select session_id, idx, explode(words) as word from {s} where kind in ('reasoning', 'response') or (kind = 'request' and coalesce(tool_kind, '') <> 'fs.read')) y group by session_id, word),
named as (select distinct n.session_id, n.idx from n join w on w.session_id = n.session_id and w.word = n.name and w.last_idx > n.idx),
touched as (select session_id, path, max(idx) as last_idx from {s} where kind = 'request' and tool_kind <> 'fs.read' and path is not null group by session_id, path)
select r.session_id, r.idx, r.path, 0.55D as confidence from r left anti join named on named.session_id = r.session_id and named.idx = r.idx left join touched t on t.session_id = r.session_id and t.path = r.path where coalesce(t.last_idx, 0) < r.idx""", SAID,
           r"with r as (select c.*, lower(regexp_extract(c.path, '[^/]+$')) as base from sw c where c.kind = 'completion' and c.tool_kind = 'fs.read' and not exists (select 1 from sw o where o.session_id = c.session_id and o.kind = 'completion' and o.tool_kind = 'fs.read' and o.path = c.path and o.idx < c.idx) and exists (select 1 from sw o where o.session_id = c.session_id and o.kind = 'response' and o.idx >= c.idx) and not regexp_matches(c.path, '[.](png|jpe?g|gif|webp|pdf)$')), m as (select r.*, [base] || if(length(regexp_replace(base, '[.][^.]*$', '')) >= 4, [regexp_replace(base, '[.][^.]*$', '')], []) || list_transform(regexp_extract_all(text, '\b(def|class)\s+([A-Za-z_][A-Za-z0-9_]{2,})', 2), lambda x: lower(x)) as names from r) select m.session_id, m.idx, m.path, 0.55::double as confidence from m where not exists (select 1 from sw o where o.session_id = m.session_id and o.idx > m.idx and ((o.kind = 'request' and o.tool_kind <> 'fs.read' and (o.path = m.path or list_has_any(o.words, m.names))) or (o.kind in ('reasoning', 'response') and list_has_any(o.words, m.names))))"),
    Sample("d9_handoff_done_again", """with h as (select session_id, segment, idx, size(words) as n, explode(words) as word from {s} where kind = 'request' and tool_kind = 'agent.handoff'),
o as (select session_id, segment, idx, explode(words) as word from {s} where kind = 'request' and tool_kind in ('fs.read', 'fs.search', 'net.fetch', 'exec.shell')),
p as (select h.session_id, h.idx, o.idx as own_idx, count(*) as shared, count(*) * 1.0D / max(h.n) as score from h join o on o.session_id = h.session_id and o.segment = h.segment and o.word = h.word and o.idx > h.idx group by h.session_id, h.idx, o.idx)
select session_id, idx, own_idx, round(least(0.65D, 0.45D + 0.4D * score), 4) as confidence from (select *, row_number() over (partition by session_id, idx order by score desc, own_idx) as r from p where shared >= 3 and score >= 0.5) x where r = 1""", SAID,
           "with p as (select h.session_id, h.idx, o.idx as own_idx, len(list_intersect(h.words, o.words)) as shared, len(h.words) as n from sw h join sw o on o.session_id = h.session_id and o.segment = h.segment and o.idx > h.idx where h.tool_kind = 'agent.handoff' and h.kind = 'request' and o.kind = 'request' and o.tool_kind in ('fs.read', 'fs.search', 'net.fetch', 'exec.shell')), b as (select session_id, idx, arg_max(own_idx, shared * 1000000 - own_idx) as own_idx, max(shared / n) as score from p where shared >= 3 and 2 * shared >= n group by all) select session_id, idx, own_idx, round(least(0.65, 0.45 + 0.4 * score), 4)::double as confidence from b"),
    Sample("d10_restated_reasoning", """with x as (select *, sum(case when is_edit or kind = 'prompt' then 1 else 0 end) over (partition by session_id order by idx) as stretch, last_value(case when kind = 'prompt' then words end) ignore nulls over (partition by session_id order by idx) as prompt from {s}),
t as (select session_id, stretch, idx, words, array_distinct(concat(words, coalesce(prompt, array()))) as known, size(words) as n from x where kind = 'reasoning' and size(words) >= 4),
w as (select session_id, stretch, idx, explode(words) as word from t),
p as (select a.session_id, a.stretch, a.idx, b.idx as earlier, count(*) as shared from w a join w b on b.session_id = a.session_id and b.stretch = a.stretch and b.word = a.word and b.idx < a.idx group by a.session_id, a.stretch, a.idx, b.idx having count(*) >= 3),
q as (select p.*, a.n, array_except(a.words, b.known) as fresh, size(array_except(a.words, b.known)) * 1.0D / a.n as novelty from p join t a on a.session_id = p.session_id and a.idx = p.idx join t b on b.session_id = p.session_id and b.idx = p.earlier),
o as (select session_id, idx, explode(words) as word from {s} where kind = 'completion' and coalesce(tool_kind, '') <> 'plan'),
seen as (select distinct q.session_id, q.idx, q.earlier from (select *, explode(fresh) as word from q) q join o on o.session_id = q.session_id and o.word = q.word and o.idx > q.earlier and o.idx < q.idx),
g as (select q.*, row_number() over (partition by q.session_id, q.idx order by q.novelty, q.earlier) as r from q left anti join seen on seen.session_id = q.session_id and seen.idx = q.idx and seen.earlier = q.earlier where q.novelty <= 0.2)
select session_id, idx, earlier, round(0.85D - novelty - case when n < 6 then 0.1D else 0.0D end, 4) as confidence from g where r = 1""", SAID,
           "with t as (select s.*, (select arg_max(p.words, p.idx) from sw p where p.session_id = s.session_id and p.kind = 'prompt' and p.idx < s.idx) as prompt from sw s where s.kind = 'reasoning' and len(s.words) >= 4), p as (select b.session_id, b.idx, a.idx as earlier, len(b.words) as n, list_filter(b.words, lambda w: not list_contains(a.words, w) and not list_contains(coalesce(b.prompt, []), w)) as fresh from t b join t a on a.session_id = b.session_id and a.segment = b.segment and a.idx < b.idx where len(list_intersect(a.words, b.words)) >= 3 and not exists (select 1 from sw e where e.session_id = a.session_id and e.is_edit and e.idx between a.idx and b.idx)), q as (select p.*, len(fresh) / n as novelty from p where len(fresh) * 5 <= n and not exists (select 1 from sw c where c.session_id = p.session_id and c.kind = 'completion' and coalesce(c.tool_kind, '') <> 'plan' and c.idx > p.earlier and c.idx < p.idx and list_has_any(c.words, p.fresh))) select session_id, idx, arg_min(earlier, novelty * 1000000 + earlier) as earlier, round(0.85 - min(novelty) - if(any_value(n) < 6, 0.1, 0), 4)::double as confidence from q group by session_id, idx"),
    Sample("d11_rewrites", """with w as (select *, case when kind = 'request' then lag(lines) over (partition by session_id, path, kind = 'request' and tool_kind = 'fs.write' order by idx) end as old, last_value(case when kind = 'completion' and tool_kind = 'fs.read' then lines end) ignore nulls over (partition by session_id, path order by idx) as seen from {s} where path is not null and (tool_kind = 'fs.write' or tool_kind = 'fs.read')),
x as (select *, size(array_intersect(old, lines)) * 1.0D / size(old) as kept_own, size(array_intersect(old, lines)) * 1.0D / size(lines) as share_own, size(array_intersect(seen, lines)) * 1.0D / size(seen) as kept_seen, size(array_intersect(seen, lines)) * 1.0D / size(lines) as share_seen from w where kind = 'request' and tool_kind = 'fs.write' and size(lines) > 0)
select session_id, idx, path, case when old is not null and size(old) > 0 then case when share_own >= 0.7 then 0.8D else 0.6D end else 0.6D end as confidence, round(case when old is not null and size(old) > 0 then share_own else share_seen end, 4) as share from x
where case when old is not null and size(old) > 0 then share_own >= 0.3 and kept_own >= 0.8 else size(seen) >= 3 and kept_seen >= 0.6 and share_seen >= 0.3 end""", STEPS,
           r"with l as (select *, list_distinct(list_filter(list_transform(string_split(coalesce(json_extract_string(input, '$.content'), text), chr(10)), lambda x: trim(regexp_replace(x, '^\s*\d+\t', ''))), lambda x: x <> '')) as lines from st where path is not null and ((kind = 'request' and tool_kind = 'fs.write') or (kind = 'completion' and tool_kind = 'fs.read'))), p as (select w.*, (select arg_max(o.lines, o.idx) from l o where o.session_id = w.session_id and o.path = w.path and o.kind = 'request' and o.idx < w.idx) as old, (select arg_max(o.lines, o.idx) from l o where o.session_id = w.session_id and o.path = w.path and o.kind = 'completion' and o.idx < w.idx) as seen from l w where w.kind = 'request' and len(w.lines) > 0), q as (select *, coalesce(old, seen) as prior, len(list_intersect(coalesce(old, seen), lines)) as same from p) select session_id, idx, path, if(old is not null and same / len(lines) >= 0.7, 0.8::double, 0.6::double) as confidence, round(same / len(lines), 4) as share from q where same / len(lines) >= 0.3 and if(old is not null, same / len(prior) >= 0.8, len(prior) >= 3 and same / len(prior) >= 0.6)"),
    Sample("d13_too_much_context", """with i as (select *, row_number() over (partition by session_id, segment, case when tool_kind = 'fs.read' then path else call_key end order by idx) as nth, min(case when is_edit then idx end) over (partition by session_id, segment) as first_edit from {s}),
g as (select session_id, segment, min(first_edit) as first_edit, count(distinct case when is_edit then path end) as files, count(case when explores and nth = 1 and idx < first_edit then 1 end) as items from i where kind = 'request' group by session_id, segment)
select session_id, segment, items, files, round(least(0.65D, 0.55D + 0.02D * (items - 3 * files - 3)), 4) as confidence from g where first_edit is not null and items - 3 * files - 3 >= 2""", STEPS,
           "with c as (select session_id, segment, min(idx) as first_edit, count(distinct path) as files from rq where is_edit group by all), g as (select c.*, (select count(distinct if(r.tool_kind = 'fs.read', r.path, r.call_key)) from rq r where r.session_id = c.session_id and r.segment = c.segment and r.explores and r.idx < c.first_edit) as items from c) select session_id, segment, items, files, round(least(0.65, 0.55 + 0.02 * (items - 3 * files - 3)), 4)::double as confidence from g where items >= 3 * files + 5"),
    Sample("d14_too_little_context", r"""with i as (select *, row_number() over (partition by session_id, segment, explores, case when tool_kind = 'fs.read' then path else call_key end order by idx) as nth, row_number() over (partition by session_id, segment, tool_kind, path order by idx) as nth_of_path from {s} where kind = 'request'),
c as (select *, sum(case when explores and nth = 1 then 1 else 0 end) over w as items, sum(case when tool_kind = 'fs.edit' and nth_of_path = 1 and not lower(path) rlike '\\.(md|rst|adoc)$' then 1 else 0 end) over w as files from i window w as (partition by session_id, segment order by idx)),
b as (select *, row_number() over (partition by session_id, segment order by idx) as r from c where tool_kind = 'fs.edit' and nth_of_path = 1 and not lower(path) rlike '\\.(md|rst|adoc)$' and items < files)
select b.session_id, b.idx, b.path, case when exists (select 1 from {s} k where k.session_id = b.session_id and k.kind = 'request' and k.path = b.path and k.tool_kind in ('fs.read', 'fs.edit', 'fs.write') and k.idx < b.idx) then 0.55D else 0.7D end as confidence from b where r = 1""", STEPS,
           r"with e as (select session_id, segment, path, min(idx) as idx from rq where tool_kind = 'fs.edit' and not regexp_matches(path, '[.](md|rst|adoc)$') group by all), n as (select e.*, (select count(*) from e o where o.session_id = e.session_id and o.segment = e.segment and o.idx <= e.idx) as files, (select count(distinct if(r.tool_kind = 'fs.read', r.path, r.call_key)) from rq r where r.session_id = e.session_id and r.segment = e.segment and r.explores and r.idx < e.idx) as items from e), f as (select session_id, segment, min(idx) as idx, arg_min(path, idx) as path from n where items < files group by all) select f.session_id, f.idx, f.path, if(exists (select 1 from rq k where k.session_id = f.session_id and k.path = f.path and k.idx < f.idx and k.tool_kind in ('fs.read', 'fs.edit', 'fs.write')), 0.55::double, 0.7::double) as confidence from f"),
    Sample("p16_failure_signatures", "select session_id, command, count(*) as failures, count(distinct signature) as kinds from {s} where kind = 'request' and outcome = 'failed' group by session_id, command", STEPS,
           "select session_id, command, count(*) as failures, count(distinct signature) as kinds from rq where outcome = 'failed' group by session_id, command"),
    Sample("p17_output_kinds", "select session_id, count(*) as outputs, count(distinct out) as kinds from {s} where kind = 'request' and done is not null group by session_id", STEPS, "select session_id, count(*) as outputs, count(distinct out) as kinds from res group by session_id"),
    Sample("p33_error_results", r"select session_id, idx, text rlike '^\\s*(?:Error|error|ERROR|FAILED|Traceback)' as by_prefix, lower(text) rlike 'permission denied|no such file|command not found|<tool_use_error>' as by_marker from {s} where kind = 'completion'", EVENTS,
           "with m(marker) as (values ('permission denied'), ('no such file'), ('command not found'), ('<tool_use_error>')) select session_id, idx, regexp_matches(ltrim(text), '^(Error|error|ERROR|FAILED|Traceback)') as by_prefix, exists (select 1 from m where contains(lower(text), marker)) as by_marker from ev where kind = 'completion'"),
    Sample("j4_use_result", "select session_id, req as use_idx, name, path, idx as result_idx, greatest(1, length(text) div 4) as result_tokens from {s} where kind = 'completion' and req is not null", STEPS,
           "select r.session_id, r.idx as use_idx, r.tool_name as name, r.path, m.idx as result_idx, greatest(1, length(m.text) // 4) as result_tokens from met m join asked r on r.session_id = m.session_id and r.idx = m.req"),
    Sample("j6_next_run", "select session_id, idx, command, outcome, lead(idx) over w as next_idx, lead(outcome) over w as next_outcome from {s} where is_check window w as (partition by session_id, command order by idx)", STEPS,
           "select a.session_id, a.idx, a.command, a.outcome, (select min(b.idx) from rq b where b.session_id = a.session_id and b.command = a.command and b.is_check and b.idx > a.idx) as next_idx, (select arg_min(coalesce(b.outcome, ''), b.idx) from rq b where b.session_id = a.session_id and b.command = a.command and b.is_check and b.idx > a.idx) as next_outcome from rq a where a.is_check"),
    Sample("j8_handoff_overlap", """with h as (select session_id, segment, idx, size(words) as n, explode(words) as word from {s} where kind = 'request' and tool_kind = 'agent.handoff'),
o as (select session_id, segment, idx, explode(words) as word from {s} where kind = 'request' and tool_kind in ('fs.read', 'fs.search', 'net.fetch', 'exec.shell'))
select h.session_id, h.idx, o.idx as own_idx, count(*) as shared, round(count(*) * 1.0D / max(h.n), 4) as score from h join o on o.session_id = h.session_id and o.segment = h.segment and o.word = h.word and o.idx > h.idx group by h.session_id, h.idx, o.idx having count(*) >= 3 and count(*) >= 0.5 * max(h.n)""", SAID,
           "select h.session_id, h.idx, o.idx as own_idx, cast(len(list_intersect(h.words, o.words)) as bigint) as shared, round(len(list_intersect(h.words, o.words)) / len(h.words), 4) as score from sw h, sw o where o.session_id = h.session_id and o.segment = h.segment and o.idx > h.idx and h.kind = 'request' and h.tool_kind = 'agent.handoff' and o.kind = 'request' and o.tool_kind in ('fs.read', 'fs.search', 'net.fetch', 'exec.shell') and len(list_intersect(h.words, o.words)) >= 3 and 2 * len(list_intersect(h.words, o.words)) >= len(h.words)"),
    Sample("p7_block_text", "select session_id, sequence, sha2(case when kind = 'tool.requested' then concat(tool_name, ' ', arguments) else text end, 256) as text_sha256 from {e}", EVENTS,
           "select session_id, idx as sequence, sha256(if(kind = 'request', tool_name || ' ' || cast(input as varchar), text)) as text_sha256 from ev"),
    Sample("p14_runs_check", "select session_id, idx, checks, intent = 'change' as changes from {s} where kind = 'request' and command is not null and (checks or intent = 'change')", STEPS, "select session_id, idx, checks, intent = 'change' as changes from asked where raw_command is not null and (checks or intent = 'change')"),
    Sample("p30_fingerprint_novelty", """with f as (select session_id, sequence, tool_name, coalesce(path, '') as path, trim(regexp_replace(coalesce(command, ''), '\\\\s+', ' ')) as command, coalesce(get_json_object(arguments, '$.pattern'), get_json_object(arguments, '$.query'), '') as query, concat_ws(':', get_json_object(arguments, '$.offset'), get_json_object(arguments, '$.limit')) as span, arguments from {e} where kind = 'tool.requested'),
l as (select *, lag(struct(tool_name, path, command, query, span, arguments)) over (partition by session_id order by sequence) as old from f)
select session_id, sequence, case when old.tool_name <> tool_name then 1.0D when (old.path <> path or old.command <> command or old.query <> query or old.span <> span) then (cast(old.path <> path as int) + cast(old.command <> command as int) + cast(old.query <> query as int) + cast(old.span <> span as int)) / 4.0D when old.arguments <> arguments then 0.25D else 0.0D end as novelty from l where old is not null""", EVENTS,
           r"with f as (select session_id, row_number() over (partition by session_id order by idx) as n, idx, tool_name, [coalesce(path, ''), trim(regexp_replace(coalesce(raw_command, ''), '\s+', ' ', 'g')), coalesce(json_extract_string(input, '$.pattern'), ''), ''] as facts, cast(input as varchar) as whole from ev where kind = 'request') select b.session_id, b.idx as sequence, case when a.tool_name <> b.tool_name then 1::double else greatest(len(list_filter(range(1, 5), lambda k: a.facts[k] <> b.facts[k])) / 4, if(a.whole <> b.whole, 0.25, 0))::double end as novelty from f a join f b on b.session_id = a.session_id and b.n = a.n + 1"),
    Sample("p44_languages_of_paths", "select language, count(*) as uses, count(distinct path) as files from (select path, case lower(regexp_extract(path, '[.]([^./]+)$', 1)) when 'py' then 'Python' when 'md' then 'Markdown' when 'rst' then 'reStructuredText' when 'conf' then 'Config' else 'other' end as language from {s} where kind = 'request' and path is not null) x group by language", STEPS,
           "with l(suffix, language) as (values ('py', 'Python'), ('md', 'Markdown'), ('rst', 'reStructuredText'), ('conf', 'Config')) select coalesce(l.language, 'other') as language, count(*) as uses, count(distinct path) as files from asked left join l on ends_with(path, '.' || l.suffix) where path is not null group by all"),
    Sample("p45_roles_of_paths", r"select path, case when path rlike '(?:^|/)tests?/|(?:^|/)test_|_test\\.|\\.spec\\.' then 'test' when path rlike '\\.(?:md|rst|txt)$' then 'doc' when path rlike '(?:^|/)\\.github/|(?:^|/)ci/' then 'ci' when path rlike '\\.(?:toml|ya?ml|json|ini|cfg)$' then 'config' else 'source' end as role, count(*) as uses from {s} where kind = 'request' and path is not null group by path", STEPS,
           "select path, case when contains('/' || path, '/test') then 'test' when ends_with(path, '.md') or ends_with(path, '.rst') then 'doc' when contains(path, '.github/') then 'ci' when ends_with(path, '.toml') or ends_with(path, '.json') then 'config' else 'source' end as role, count(*) as uses from asked where path is not null group by path"),
    Sample("s12_transcript_coverage", "select session_id, count(*) as events, count(distinct uuid_of) as parents, count(case when kind = 'tool.completed' then 1 end) as results, count(usage) as with_usage from (select *, parent_id as uuid_of from {e}) x group by session_id", EVENTS,
           "with u as (select *, role = 'assistant' and row_number() over (partition by session_id, coalesce(request_id, uuid) order by file, line, place) = 1 and json_type(v, '$.message.usage') = 'OBJECT' as used from ev) select session_id, count(*) as events, count(*) - 1 as parents, count(*) filter (where kind = 'completion') as results, count(*) filter (where used) as with_usage from u group by session_id"),
    Sample("s25_session_markdown", "select session_id, concat('## ', session_id, chr(10), '| steps | requests | edits | checks |', chr(10), '|---:|---:|---:|---:|', chr(10), '| ', count(*), ' | ', count(case when kind = 'request' then 1 end), ' | ', count(case when is_edit then 1 end), ' | ', count(case when checks then 1 end), ' |') as markdown from {s} group by session_id", STEPS,
           "select session_id, format('## {}\n| steps | requests | edits | checks |\n|---:|---:|---:|---:|\n| {} | {} | {} | {} |', session_id, count(*), count(*) filter (where kind = 'request'), count(*) filter (where is_edit), count(*) filter (where checks)) as markdown from st group by session_id"),
    Sample("b1_group_ratio", """with m as (select case when session_id in ('habits', 'handoff', 'planning') or session_id rlike '[0-4]$' then 'group a' else 'group b' end as parent, session_id, sum(tokens) as tokens, round(sum(case when kind = 'request' and coalesce(outcome, '') <> 'failed' or kind = 'response' then tokens else 0 end) / sum(tokens), 4) as ratio from {s} where kind in ('request', 'response', 'reasoning') group by session_id)
select parent, count(*) as members, round(coalesce(sum(ratio * tokens) / sum(tokens), 0), 4) as ratio, round(100 * (1 - coalesce(sum(ratio * tokens) / sum(tokens), 0)), 1) as waste_percent from m group by parent""", STEPS,
           r"with t as (select s.session_id, s.kind, r.outcome, len(regexp_extract_all(case when s.kind = 'request' then s.name || ' ' || cast(s.input as varchar) else s.text end, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]')) as tokens from st s left join res r on r.session_id = s.session_id and r.idx = s.idx where s.kind in ('request', 'response', 'reasoning')), m as (select session_id, sum(tokens) as tokens, round(sum(tokens) filter (where kind = 'response' or (kind = 'request' and outcome is distinct from 'failed')) / sum(tokens), 4) as ratio from t group by session_id) select if(list_contains(['habits', 'handoff', 'planning', '0', '1', '2', '3', '4'], if(session_id like 'u%', session_id[-1], session_id)), 'group a', 'group b') as parent, count(*) as members, round(sum(ratio * tokens) / sum(tokens), 4) as ratio, round(100 - 100 * sum(ratio * tokens) / sum(tokens), 1) as waste_percent from m group by all"),
    Sample("b5_metric_records", """with m as (select session_id, max(sequence) as last, map('events', count(*), 'requests', count(case when kind = 'tool.requested' then 1 end), 'events ', count(*)) as metrics from {e} group by session_id),
r as (select session_id, last, explode(metrics) as (name, value) from m), q as (select session_id, trim(name) as name, value, last + row_number() over (partition by session_id order by name) as sequence from r)
select session_id, name, max_by(value, sequence) as value, max(sequence) as sequence, max_by(substr(sha2(concat_ws(chr(0), session_id, name, cast(value as string)), 256), 1, 16), sequence) as event_id from q group by session_id, name""", EVENTS,
           "with c as (select session_id, count(*) as n, count(*) filter (where kind = 'request') as k from ev group by session_id) select session_id, 'events' as name, n as value, n + 2 as sequence, substr(sha256(session_id || chr(0) || 'events' || chr(0) || n), 1, 16) as event_id from c union all select session_id, 'requests' as name, k as value, n + 3 as sequence, substr(sha256(session_id || chr(0) || 'requests' || chr(0) || k), 1, 16) as event_id from c"),
    Sample("b6_recomputed_from_log", """with l as (select to_json(struct(event_id, session_id, sequence, kind, tool_kind, path)) as line from {e}),
d as (select from_json(line, 'event_id string, session_id string, sequence bigint, kind string, tool_kind string, path string') as x from l),
a as (select x.session_id, count(*) as events, count(distinct x.path) as paths, count(case when x.tool_kind = 'fs.read' then 1 end) as reads from d group by x.session_id),
b as (select session_id, count(*) as events, count(distinct path) as paths, count(case when tool_kind = 'fs.read' then 1 end) as reads from {e} group by session_id)
select a.session_id, a.events, a.paths, a.reads, a.events = b.events and a.paths = b.paths and a.reads = b.reads as same from a join b on a.session_id = b.session_id""", EVENTS,
           "select session_id, count(*) as events, count(distinct path) as paths, count(*) filter (where tool_kind = 'fs.read') as reads, true as same from ev group by session_id"),
    Sample("s6_discovered_sessions", """with f as (select case when n % 5 = 1 then concat('p', n % 7, '/u', n - 1, '/subagents/', session_id, '.jsonl') else concat('p', n % 7, '/', session_id, if(n % 11 = 3, '.txt', '.jsonl')) end as path, modified from (select session_id, coalesce(try_cast(substr(session_id, 2) as bigint), 0) as n, max(sequence) as modified from {e} group by session_id) x),
s as (select *, regexp_extract(path, '([^/]+)[.]jsonl$', 1) as session, nullif(regexp_extract(path, '([^/]+)/subagents/[^/]+$', 1), '') as parent, split(path, '/')[0] as project from f where path like '%.jsonl')
select project, session, parent, cast(modified as bigint) as modified, parent is null and row_number() over (partition by project, parent is null order by modified desc, path) = 1 as latest from s""", EVENTS,
           "with n as (select session_id, coalesce(try_cast(substr(session_id, 2) as bigint), 0) as n, count(*) as modified from ev group by session_id), t as (select 'p' || (n % 7) as project, session_id as session, if(n % 5 = 1, 'u' || (n - 1), null) as parent, modified from n where n % 5 = 1 or n % 11 <> 3) select project, session, parent, modified, parent is null and session = (select arg_min(o.session, struct_pack(m := -o.modified, s := o.project || '/' || o.session || '.jsonl')) from t o where o.project = t.project and o.parent is null) as latest from t"),
]


#: The detectors' findings as one: where a rule has no step of its own, the session's segment stands for it.
FOUND = {"d1_same_call_again": ("repeated_tool_call", "idx"), "d2_same_look_again": ("repeated_exploration", "idx"), "d3_rework": ("rework_cycle", "idx"), "d4_unchecked_edits": ("unvalidated_implementation", "segment"), "d5_edits_unseen": ("premature_implementation", "idx"),
         "d7_round_trips": ("fragmented_edits", "start_idx"), "d8_unused_reads": ("unused_context", "idx"), "d9_handoff_done_again": ("unnecessary_handoff", "idx"), "d10_restated_reasoning": ("repeated_reasoning", "idx"), "d11_rewrites": ("regeneration", "idx"),
         "d13_too_much_context": ("excessive_context", "segment"), "d14_too_little_context": ("insufficient_context", "idx")}
RISKS = "('unvalidated_implementation', 'premature_implementation', 'insufficient_context')"
_by_name = {p.name: p for p in PLANS}


def _union(of: Callable[[Sample], str]) -> str:
    parts = " union all ".join(f"select session_id, cast({place} as bigint) as place, '{detector}' as detector, confidence from ({of(_by_name[name])})" for name, (detector, place) in FOUND.items())
    return f"with u as ({parts}) select session_id, place, detector, confidence, confidence >= 0.7 as sure, row_number() over (partition by session_id order by case when detector in {RISKS} then 1 else 0 end, confidence desc, place, detector) as rank from u"


PLANS.append(Sample("u1_all_findings", _union(lambda p: p.sql).replace("confidence >= 0.7 ", "confidence >= 0.7D "), SAID, _union(lambda p: p.duck)))


def p12_simple_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(steps(given_events(spark, sf_dir)))


def commands(found: DataFrame) -> DataFrame:
    """The simple commands of the shell lines among steps."""
    found = found.where("kind = 'request' and command is not null")
    return found.select("session_id", "idx", F.posexplode(shell.simple_commands("command")).alias("place", "command"))


P12_ORACLE = f"with {EVENTS}, " + r"""c as (select session_id, idx, string_split_regex(regexp_replace(trim(raw_command), '\s+', ' ', 'g'), ' ?(\|\||&&|[|;]) ?') as parts from ev where raw_command is not null),
x as (select session_id, idx, unnest(parts) as command, cast(unnest(range(len(parts))) as integer) as place from c)
select session_id, idx, place, regexp_replace(trim(regexp_replace(regexp_replace(command, '''[^'']*''', replace(regexp_extract(command, '''([^'']*)''', 1), ' ', '·')), ' ?> ?\S+', '')), ' +', ' ', 'g') as command from x"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {p.name: p.run for p in PLANS} | {"p12_simple_commands": p12_simple_commands}


def oracle_sql() -> dict[str, str]:
    return {p.name: p.oracle for p in PLANS} | {"p12_simple_commands": P12_ORACLE}
