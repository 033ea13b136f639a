"""Transcripts that Spark derives from the given tables: one JSON line for each thing that a user's events stand for.

A user is a session, and an event a prompt, a thought, a reply, or a call with its result. Which of them it is depends on
the event's type and on the cents of its value; its key says which file, test or pattern is meant; what is said is a
rule's own or comes from the conversation whose number is the user's. The text is one SELECT that any SQL engine can run, so that an oracle reads the
same lines. Repeated, open, failed and denied calls, orphan results and repeated blocks come about as the events fall; some prompts are
followed by a look at twelve files, and some thoughts are thought five times.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: What an event becomes, by type and cents modulo 12 (from, to): kind, tool, input and result, with {places} for columns.
RULES = [
    ("signup", 0, 1, "prompt", None, None, None),
    ("signup", 2, 2, "prompt", None, "Fix the totals in src/m{a}.py and make sure that row {b} is only read once.", None),
    ("signup", 3, 3, "prompt", None, "{turn}", None),
    ("signup", 4, 6, "call", "Edit", '{"file_path":"src/m0.py","old_string":"a","new_string":"c{b}"}', "The file src/m0.py has been updated."),
    ("signup", 7, 7, "think", None, None, None),
    ("signup", 8, 8, "think", None, "Let me read m{a}.py first.", None),
    ("signup", 9, 9, "think", None, "Both rows of m{a}.py are read on lines 341 and 35{b}, so that the totals come out twice.", None),
    ("signup", 10, 11, "call", "TodoWrite", '{"todos":["part {b}"]}', "ok"),
    ("view", 0, 5, "call", "Read", '{"file_path":"src/m{a}.py"}', "1{tab}def f{a}(): pass{line}2{tab}row_{b} = {a}"),
    ("view", 6, 6, "call", "Grep", '{"pattern":"row_{b}","path":"src"}', "src/m{a}.py:2"),
    ("view", 7, 7, "call", "Grep", '{"pattern":"callers","path":"search/modules/list"}', "src/m{b}.py:1"),
    ("view", 8, 8, "call", "Bash", '{"command":"cat src/m{a}.py"}', "def f{a}(): pass"),
    ("view", 9, 9, "call", "Bash", '{"command":"ls src"}', "m{a}.py"),
    ("view", 10, 10, "call", "Task", '{"description":"Search callers","prompt":"Search modules and list callers"}', "callers: src/m{b}.py"),
    ("view", 11, 11, "call", "WebFetch", '{"url":"https://example.org/{a}"}', "page {a}"),
    ("click", 0, 2, "call", "Edit", '{"file_path":"src/m0.py","old_string":"a","new_string":"d{b}"}', "The file src/m0.py has been updated."),
    ("click", 3, 6, "call", "Edit", '{"file_path":"src/m{a}.py","old_string":"a","new_string":"b{b}"}', "The file src/m{a}.py has been updated."),
    ("click", 7, 8, "call", "Write", '{"file_path":"src/n{b}.py","content":"one = {a}{line}two = 2{line}row = 3{line}four = 4{line}five = 5"}', "{made} src/n{b}.py{done}"),
    ("click", 9, 9, "call", "Edit", '{"file_path":"docs/g{b}.md","old_string":"a","new_string":"b"}', "The file docs/g{b}.md has been updated."),
    ("click", 10, 10, "call", "Bash", '{"command":"git stash"}', "Saved"),
    ("click", 11, 11, "call", "Bash", '{"command":"sed -i s/a/b/ src/m{a}.py"}', ""),
    ("error", 0, 6, "call", "Bash", '{"command":"pytest -q tests/test_m{b}.py"}', "FAILED test_{c}{line}1 failed in 0.{a}0s"),
    ("error", 7, 8, "call", "Bash", '{"command":"make test"}', "2 failed in 0.{a}1s"),
    ("error", 9, 9, "call", "Bash", '{"command":"apt install p{c}"}', "Permission denied"),
    ("error", 10, 10, "call", "Read", '{"file_path":"src/gone{c}.py"}', "<tool_use_error>File does not exist.</tool_use_error>"),
    ("error", 11, 11, "call", "Bash", '{"command":"sleep {b}"}', None),
    ("purchase", 0, 6, "call", "Bash", '{"command":"pytest -q tests/test_m{b}.py"}', "{b} passed in 0.{a}2s"),
    ("purchase", 7, 7, "call", "Bash", '{"command":"ruff check ."}', "All checks passed"),
    ("purchase", 8, 8, "say", None, None, None),
    ("purchase", 9, 9, "say", None, "[Request interrupted by the user at part {b}.]", None),
    ("purchase", 10, 10, "say", None, "The totals in src/m{a}.py are fixed and row {b} is only read once.", None),
    ("purchase", 11, 11, "orphan", None, None, "who asked for {a}?"),
]
#: A key's parts: one of five files, one of four others, one of two cases.
PARTS = {"a": "cast(k % 5 as string)", "b": "cast(k % 4 as string)", "c": "cast(k % 2 as string)", "tab": "chr(92) || 't'", "line": "chr(92) || 'n'", "made": "case when k % 2 = 0 then 'File created successfully at:' else 'The file' end", "turn": "case when k % 3 = 0 then 'Go ahead.' when k % 3 = 1 then 'Actually, fix the totals in src/n' || cast(k % 4 as string) || '.py instead.' else 'Yes' end", "done": "case when k % 2 = 0 then '' else ' has been updated.' end"}


def _text(template: str | None) -> str:
    """The template as an expression: literals and the columns of its places."""
    if template is None:
        return "cast(null as string)"
    out = template.replace("'", "''")
    for name, column in PARTS.items():
        out = out.replace(f"{{{name}}}", f"' || {column} || '")
    return f"'{out}'"


def _chosen(column: int) -> str:
    rows = (f"when event_type = '{r[0]}' and cents between {r[1]} and {r[2]} then {_text(r[column])}" for r in RULES)
    return f"case {' '.join(rows)} end"


def _asked() -> str:
    """Whether an event's words are a rule's own."""
    return " or ".join(f"event_type = '{r[0]}' and cents between {r[1]} and {r[2]}" for r in RULES if r[3] != "call" and r[5])


_BODY = """'","sessionId":"u' || u || '","timestamp":"' || moment || '",'"""
#: file, line, value; the tables' names stand in braces.
LINES = f"""with said as (select conv_id, turn, max(translate(text, chr(34) || chr(92) || chr(9) || chr(13), '    ')) as text from {{conversations}} group by conv_id, turn),
ev as (select event_id, cast(user_id as string) as u, user_id, ts, event_type, cast(floor(value * 100) as bigint) % 12 as cents, cast(get_json_object(props, '$.k') as bigint) as k, replace(substr(cast(ts as string), 1, 19), ' ', 'T') || 'Z' as moment from {{events}}),
act as (select e.*, {_chosen(3)} as kind, {_chosen(4)} as tool, {_chosen(5)} as input, {_chosen(6)} as result, coalesce(case when {_asked()} then {_chosen(5)} end, replace(s.text, chr(10), chr(92) || 'n'), 'Part ' || cast(k as string) || ' of m' || cast(k % 5 as string) || '.py comes next.') as words from ev e left join said s on s.conv_id = e.user_id and s.turn = e.k % 8),
one as (select u, ts, event_id, 1 as part, case kind
  when 'prompt' then '{{"type":"user","uuid":"a' || cast(event_id as string) || {_BODY} || '"message":{{"role":"user","content":"' || words || '"}}}}'
  when 'orphan' then '{{"type":"user","uuid":"a' || cast(event_id as string) || {_BODY} || '"message":{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"x' || cast(event_id as string) || '","content":"' || result || '"}}]}}}}'
  else '{{"type":"assistant","uuid":"a' || cast(event_id as string) || {_BODY} || '"requestId":"q' || cast(event_id as string) || '","message":{{"role":"assistant","model":"m-large","content":[' ||
    case kind when 'call' then '{{"type":"tool_use","id":"c' || cast(event_id as string) || '","name":"' || tool || '","input":' || input || '}}' when 'think' then '{{"type":"thinking","thinking":"' || words || '"}}' else '{{"type":"text","text":"' || words || '"}}' end
    || '],"usage":{{"input_tokens":' || cast(100 + k as string) || ',"output_tokens":' || cast(10 + cents as string) || ',"cache_read_input_tokens":' || cast(50 * k as string) || '}}}}}}' end as value from act),
two as (select u, ts, event_id, 2 as part, '{{"type":"user","uuid":"b' || cast(event_id as string) || {_BODY} || '"message":{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"c' || cast(event_id as string) || '","content":"' || result || '"}}]}}}}' as value from act where kind = 'call' and result is not null),
three as (select u, ts, event_id, 3 as part, value from one where event_id % 29 = 0),
look as (select u, ts, event_id, moment, cast(event_id as string) || 'x' || cast(i as string) as id, i from act join (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) as b(i) on i <= 12 where kind = 'prompt' and k % 4 = 0),
four as (select u, ts, event_id, 10 + 2 * i as part, '{{"type":"assistant","uuid":"r' || id || {_BODY} || '"requestId":"r' || id || '","message":{{"role":"assistant","model":"m-large","content":[{{"type":"tool_use","id":"r' || id || '","name":"Read","input":{{"file_path":"src/w' || cast(i as string) || '.py"}}}}],"usage":{{"input_tokens":90,"output_tokens":' || cast(i as string) || ',"cache_read_input_tokens":0}}}}}}' as value from look),
five as (select u, ts, event_id, 11 + 2 * i as part, '{{"type":"user","uuid":"s' || id || {_BODY} || '"message":{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"r' || id || '","content":"def w' || cast(i as string) || '(): pass"}}]}}}}' as value from look),
six as (select u, ts, event_id, 40 + i as part, '{{"type":"assistant","uuid":"t' || cast(event_id as string) || 'x' || cast(i as string) || {_BODY} || '"requestId":"t' || cast(event_id as string) || 'x' || cast(i as string) || '","message":{{"role":"assistant","model":"m-large","content":[{{"type":"thinking","thinking":"' || words || '"}}],"usage":{{"input_tokens":80,"output_tokens":8,"cache_read_input_tokens":0}}}}}}' as value from act join (values (1), (2), (3), (4)) as b(i) on i <= 4 where kind = 'think' and k % 4 = 1)
select 'u' || u || '.jsonl' as file, cast(row_number() over (partition by u order by ts, event_id, part) as int) as line, value from (select * from one union all select * from two union all select * from three union all select * from four union all select * from five union all select * from six) x"""
ORACLE = LINES.replace("get_json_object(", "json_extract_string(").replace("{events}", "events").replace("{conversations}", "conversations")


#: An event's rule, a row for each cent, with the words that are a rule's own beside the input of a call.
_RULED = ", ".join(
    "(" + ", ".join([str(n), f"'{kind}'", str(cents), *("cast(null as string)" if x is None else "'" + x.replace("'", "''") + "'" for x in (does, tool, given if does == "call" else None, result, given if does != "call" else None))]) + ")"
    for n, (kind, cents, does, tool, given, result) in enumerate((kind, cents, *rest) for kind, first, last, *rest in RULES for cents in range(first, last + 1))
)


def _filled(template: str) -> str:
    """A template's places filled by a row's key; one that needs a key is null without it."""
    out = template
    for name, column in PARTS.items():
        out = f"replace({out}, '{{{name}}}', {f"coalesce({column}, '')" if name in 'abc' else column})"
    return f"case when k is null and {template} rlike '[{{][abc][}}]' then null else {out} end"


def _one_pass() -> str:
    """LINES with each event read and judged once. What a rule makes of a key depends on the key modulo 60, so that all rules
    are filled beforehand, in a table of 7,200 rows. Lines are numbered before they are made: what moves is an event's rule,
    its key and what was said, if it is needed."""
    steps = {"one": "one as (select u, ts, event_id, 1 as part, ", "two": "two as (select u, ts, event_id, 2 as part, ", "four": "four as (select u, ts, event_id, 10 + 2 * i as part, ", "five": "five as (select u, ts, event_id, 11 + 2 * i as part, ", "six": "six as (select u, ts, event_id, 40 + i as part, "}
    value = {n: re.search(rf"^{re.escape(begin)}(.*?) as value from ", LINES, re.DOTALL | re.MULTILINE)[1] for n, begin in steps.items()}  # type: ignore[index]
    value |= {n: value[n].replace("|| id ||", "|| cast(event_id as string) || 'x' || cast(i as string) ||") for n in ("four", "five")}
    said = LINES.split("\nev as")[0]
    return f"""{said}
ruled as (select n * 121 + coalesce(k + 60, 0) as rule, kind_of, cents_of, k as k_of, does as kind, tool, {_filled("input")} as input, {_filled("result")} as result, {_filled("own")} as own
  from (values {_RULED}) as r(n, kind_of, cents_of, does, tool, input, result, own) cross join (select explode(concat(sequence(-59, 59), array(cast(null as int)))) as k) z),
ev as (select event_id, user_id, ts, event_type, cast(floor(value * 100) as bigint) % 12 as cents, cast(get_json_object(props, '$.k') as bigint) as k from {{events}}),
act as (select /*+ broadcast(r) */ e.*, r.rule, r.kind, r.kind = 'call' and r.result is not null as answered, case when r.own is null and r.kind is distinct from 'call' then e.k % 8 end as asks
  from ev e left join ruled r on r.kind_of = e.event_type and r.cents_of = e.cents and r.k_of <=> cast(e.k % 60 as int)),
told as (select a.event_id, a.user_id, a.ts, a.cents, a.k, a.rule, s.text, concat(array(1), case when answered then array(2) else array() end, case when event_id % 29 = 0 then array(3) else array() end,
  case when kind = 'prompt' and k % 4 = 0 then sequence(12, 35) else array() end, case when kind = 'think' and k % 4 = 1 then sequence(41, 44) else array() end) as parts from act a left join said s on s.conv_id = a.user_id and s.turn = a.asks),
dealt as (select /*+ repartition(user_id) */ * from told),
each as (select event_id, user_id, ts, cents, k, rule, case when part between 2 and 40 and part <> 3 then null else text end as text, part from (select *, explode(parts) as part from dealt) y),
placed as (select *, cast(row_number() over (partition by user_id order by ts, event_id, part) as int) as line from each),
full as (select /*+ broadcast(r) */ p.*, cast(p.user_id as string) as u, replace(substr(cast(ts as string), 1, 19), ' ', 'T') || 'Z' as moment, r.kind, r.tool, r.input, r.result, case when part > 40 then part - 40 else (part - 10) div 2 end as i,
  coalesce(r.own, replace(p.text, chr(10), chr(92) || 'n'), 'Part ' || cast(k as string) || ' of m' || cast(k % 5 as string) || '.py comes next.') as words from placed p left join ruled r on r.rule = p.rule)
select 'u' || u || '.jsonl' as file, line, case when part in (1, 3) then {value["one"]} when part = 2 then {value["two"]} when part > 40 then {value["six"]} when part % 2 = 0 then {value["four"]} else {value["five"]} end as value from full"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line, value: transcripts as flowgauge.sources.transcripts.records takes them."""
    # only the tables' own braces are places to fill
    text = re.sub(r"\{(?!events\}|conversations\})", "{{", re.sub(r"(?<!\{events)(?<!\{conversations)\}", "}}", _one_pass()))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "conversations")})
