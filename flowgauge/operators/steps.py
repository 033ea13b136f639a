"""Steps: canonical events with the facts that detectors read, each request met with its completion.

One row an event: session_id, idx, kind (prompt, reasoning, response, request, completion), tool_kind, name, path, command,
call_key, segment (prompts so far), tokens; req (a completion's request), done (a request's last completion) and, on both,
out (a fingerprint of the output), outcome and signature of a check; words, idents and lines as sets of strings; intent and
checks of a shell line; is_edit, is_check and explores. A completion has the tool, path and command of its request.

A request is known by its call id, and a used id means its latest request; a completion without one has no request. All
windows are by session, so that one exchange serves them; facts are taken a row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions import scalars, shell, vectorised

KINDS = {"intent.stated": "prompt", "tool.requested": "request", "tool.completed": "completion"}
RESULTS = """
with g as (select *, case when call_id is not null and kind in ('request', 'completion') then count(case when kind = 'request' then 1 end) over (partition by session_id, call_id order by idx) end as turn from {e}),
m as (select *, turn > 0 as paired from g),
r as (select *, case when paired then max(case when kind = 'request' then idx end) over w end as asked, case when paired then max(case when kind = 'completion' then idx end) over w end as answered,
  case when paired then first_value(struct(tool_kind, tool_name, path, command, intent, checks)) over (partition by session_id, call_id, turn order by idx) end as tool,
  case when paired then max_by(case when kind = 'completion' then struct(print, read_outcome, read_signature) end, case when kind = 'completion' then idx end) over w end as result
  from m window w as (partition by session_id, call_id, turn))
select session_id, idx, event_id, kind, ts, text, call_id, cast(sum(case when kind = 'prompt' then 1 else 0 end) over (partition by session_id order by idx) as bigint) as segment,
  coalesce(tool.tool_kind, tool_kind) as tool_kind, coalesce(tool.tool_name, tool_name) as name, coalesce(tool.path, path) as path, coalesce(tool.command, command) as command, call_key,
  coalesce(tool.intent, intent) as intent, coalesce(case when kind in ('request', 'completion') then coalesce(tool.checks, checks) end, false) as tool_checks,
  case when kind = 'completion' then asked end as req, case when kind = 'request' then answered end as done, result, given, content, tokens
from r"""


def steps(events: DataFrame) -> DataFrame:
    """The steps of events (see flowgauge.sources.transcripts)."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    call = F.col("kind") == "tool.requested"
    arguments = vectorised.canonical_json(F.coalesce("arguments", F.lit("{}")))
    values = F.concat_ws(" ", F.map_values(F.from_json("arguments", "map<string,string>")))
    output = F.coalesce("text", F.lit(""))
    base = events.select(
        "session_id", F.col("sequence").cast("long").alias("idx"), "event_id", F.coalesce(kinds[F.col("kind")], F.col("kind")).alias("kind"), "ts", "text", "call_id", "tool_kind", "tool_name", "path",
        F.trim(F.regexp_replace("command", r"\s+", " ")).alias("command"), F.when(call, values).otherwise(F.col("text")).alias("given"), F.get_json_object("arguments", "$.content").alias("content"),
        F.when(call, F.substring(F.sha2(F.concat(F.coalesce("tool_kind", F.lit("other")), F.lit("\u0000"), arguments).cast("binary"), 256), 1, 16)).alias("call_key"),
        F.when(F.col("command").isNotNull(), shell.shell_intent("command")).alias("intent"), F.when(F.col("command").isNotNull(), shell.runs_check("command")).alias("checks"),
        F.when(~call, scalars.output_fingerprint(output)).alias("print"), scalars.validation_outcome(output).alias("read_outcome"), scalars.failure_signature(output).alias("read_signature"),
        F.when(F.col("kind") != "tool.completed", scalars.token_count(F.concat_ws(" ", "tool_name", F.coalesce("arguments", "text")))).otherwise(0).cast("long").alias("tokens"),
    )
    met = events.sparkSession.sql(RESULTS, e=base)
    request, completion = F.col("kind") == "request", F.col("kind") == "completion"
    shell_check = (F.col("intent") == "validate") | F.col("tool_checks")
    file_text = completion & F.col("tool_kind").isin("fs.read", "fs.edit", "fs.write")
    none = F.expr("cast(array() as array<string>)")
    written = F.when(request & (F.col("tool_kind") == "fs.write"), F.col("content"))
    return met.select(
        "session_id", "idx", "event_id", "kind", "ts", "call_id", "segment", "tool_kind", "name", "path", "command", "call_key", "intent", "req", "done", "tokens",
        F.col("result.print").alias("out"), F.when(shell_check, F.col("result.read_outcome")).alias("outcome"), F.when(shell_check & (F.col("result.read_outcome") == "failed"), F.col("result.read_signature")).alias("signature"),
        F.when(file_text, none).otherwise(scalars.content_words(F.coalesce("given", F.lit("")))).alias("words"), F.when(completion, scalars.identifiers(F.coalesce("text", F.lit("")))).otherwise(none).alias("idents"),
        F.when(completion & (F.col("tool_kind") == "fs.read"), scalars.source_lines(F.col("text"))).when(written.isNotNull(), scalars.source_lines(written)).otherwise(none).alias("lines"),
        (request & F.col("tool_checks") | (request & (F.col("intent") == "validate"))).alias("checks"), (request & F.coalesce(F.col("tool_kind").isin("fs.edit", "fs.write"), F.lit(False))).alias("is_edit"),
        F.coalesce(request & (F.col("intent") == "validate"), F.lit(False)).alias("is_check"), (request & explores(F.col("tool_kind"), F.col("intent"))).alias("explores"), "text",
    )


def explores(tool: Column, intent: Column) -> Column:
    return F.when(tool == "exec.shell", intent == "explore").otherwise(~F.coalesce(tool.isin("fs.edit", "fs.write", "plan"), F.lit(False)))
