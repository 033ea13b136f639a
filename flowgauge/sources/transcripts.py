"""Transcripts of coding sessions (JSON lines) as canonical events, all sessions in one job.

A file is split into numbered lines, records are parsed permissively, sibling records of one request are merged by
dropping repeated blocks, and each block becomes an event with a stable id. Records of unknown type are counted by
coverage(), never fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Neutral kinds of the tools of a coding harness.
TOOL_KINDS = {
    "Read": "fs.read", "NotebookRead": "fs.read", "Grep": "fs.search", "Glob": "fs.search", "LS": "fs.search",
    "Edit": "fs.edit", "MultiEdit": "fs.edit", "NotebookEdit": "fs.edit", "Write": "fs.write",
    "Bash": "exec.shell", "BashOutput": "exec.shell", "KillShell": "exec.shell",
    "WebFetch": "net.fetch", "WebSearch": "net.fetch", "Task": "agent.handoff", "Agent": "agent.handoff",
    "TodoWrite": "plan", "ExitPlanMode": "plan",
}
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,is_error:boolean>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of every line that isn't blank."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    split = whole.select("file", F.posexplode(F.split("value", "\n")).alias("at", "value"))
    return split.where(F.trim("value") != "").select("file", (F.col("at") + 1).alias("line"), "value")


def records(raw: DataFrame) -> DataFrame:
    """One row for each well-formed record of raw (file, line, value); a missing uuid is made from the line number."""
    # a line is read once for all its fields, and its message once
    outer = raw.select("file", "line", F.json_tuple("value", "type", "uuid", "sessionId", "requestId", "timestamp", "message").alias("type", "uuid", "session_id", "request_id", "at", "message")).where("type is not null")
    inner = outer.select("*", F.json_tuple("message", "role", "model", "content", "usage").alias("says", "model", "content", "used"))
    return inner.select(
        "file", "line", "type", F.coalesce("uuid", F.concat(F.lit("line-"), F.col("line").cast("string"))).alias("uuid"), "session_id", "request_id", F.try_to_timestamp("at").alias("ts"),
        F.coalesce("says", "type").alias("role"), "model", "content", F.from_json("used", USAGE).alias("usage"),
    )


def parsed(recs: DataFrame) -> DataFrame:
    """All content blocks of user and assistant records."""
    text = F.trim("content").startswith("[")
    each = F.when(text, F.from_json("content", "array<string>")).otherwise(F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))))
    out = recs.where(F.col("role").isin("user", "assistant") & F.col("content").isNotNull()).select("*", F.posexplode(each).alias("block_index", "raw")).drop("content")
    out = out.select("*", F.json_tuple("raw", "type", "text", "thinking", "id", "name", "tool_use_id", "input", "content").alias("block_type", "said", "thought", "own_id", "tool_name", "used_id", "arguments", "inner"))
    inner = F.col("inner")
    body = F.coalesce("said", "thought", F.when(F.trim(inner).startswith("["), F.array_join(F.transform(F.from_json(inner, "array<struct<text:string>>"), lambda x: x["text"]), " ")).otherwise(inner), F.lit(""))
    return out.select("*", body.alias("text"), F.coalesce("own_id", "used_id").alias("call_id")).drop("said", "thought", "own_id", "used_id", "inner")


def blocks(recs: DataFrame) -> DataFrame:
    """Content blocks, repeats within a request dropped, the first kept."""
    out = parsed(recs)
    same = F.sha2(F.concat_ws("\u0001", F.coalesce("block_type", F.lit("")), F.trim(F.regexp_replace("text", r"\s+", " ")), F.coalesce("tool_name", F.lit("")), F.coalesce("call_id", F.lit("")), F.coalesce("arguments", F.lit(""))), 256)
    request = F.coalesce("request_id", "uuid")
    first = Window.partitionBy("file", "session_id", request, "role", same).orderBy("line", "block_index")
    return out.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy", "raw")


def row_events(recs: DataFrame) -> DataFrame:
    """What events say that can be told from one record: for streams."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = parsed(recs).withColumn("kind", event_kind(F.col("role"), F.col("block_type")))
    event_id = F.substring(F.sha2(F.concat_ws("\u0000", part("session_id"), part("uuid"), part("block_index"), part("kind")), 256), 1, 16)
    path = F.coalesce(F.get_json_object("arguments", "$.file_path"), F.get_json_object("arguments", "$.notebook_path"), F.get_json_object("arguments", "$.path"))
    return out.select("session_id", event_id.alias("event_id"), "kind", "tool_name", path.alias("path"), "ts", "text")


def event_kind(role: Column, block: Column) -> Column:
    return (
        F.when(block == "tool_result", "tool.completed").when(block == "tool_use", "tool.requested").when(block == "thinking", "reasoning")
        .when(role == "user", "intent.stated").otherwise("response")
    )


def events(spark: SparkSession, path: str) -> DataFrame:
    """Canonical events: event_id, session_id, sequence, kind, actor, text, ts, parent_id, tool columns, and usage on the
    first event of each request alone."""
    return events_of(records(lines(spark, path)))


def events_of(recs: DataFrame) -> DataFrame:
    """The canonical events of records."""
    # all windows are within a session, those of blocks too
    found = blocks(recs.repartition("session_id"))
    order = Window.partitionBy("session_id").orderBy("file", "line", "block_index")
    turn = Window.partitionBy("session_id", F.coalesce("request_id", "uuid")).orderBy("file", "line", "block_index")
    kinds = F.create_map(*(F.lit(x) for pair in TOOL_KINDS.items() for x in pair))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = found.select("*", F.row_number().over(order).cast("long").alias("sequence"), F.row_number().over(turn).alias("nth"), event_kind(F.col("role"), F.col("block_type")).alias("kind"))
    out = out.withColumn("event_id", F.substring(F.sha2(F.concat_ws("\u0000", part("session_id"), part("uuid"), part("block_index"), part("kind")), 256), 1, 16))
    out = out.select("*", F.json_tuple("arguments", "file_path", "notebook_path", "path", "command").alias("file_path", "notebook_path", "any_path", "command"))
    return out.select(
        "event_id", "session_id", "sequence", "kind", F.when(F.col("kind") == "tool.completed", "tool").otherwise(F.col("role")).alias("actor"), "text", "ts",
        F.lag("event_id").over(Window.partitionBy("session_id").orderBy("sequence")).alias("parent_id"),
        "tool_name", F.when(F.col("kind") == "tool.requested", F.coalesce(kinds[F.col("tool_name")], F.lit("other"))).alias("tool_kind"), "call_id", "arguments",
        F.coalesce("file_path", "notebook_path", "any_path").alias("path"), "command",
        F.when((F.col("nth") == 1) & (F.col("role") == "assistant"), F.col("usage")).alias("usage"), "model", "line",
    )


def coverage(recs: DataFrame) -> DataFrame:
    """How many records of each session are content, metadata, or of no known type."""
    content = F.col("role").isin("user", "assistant") & F.col("content").isNotNull()
    return recs.groupBy("session_id").agg(F.count(F.when(content, 1)).alias("content"), F.count(F.when(~content, 1)).alias("other"), F.count_distinct("uuid").alias("records"))


def steps_feed(found: DataFrame) -> DataFrame:
    """Events as the feed that session plans take: prompts, reads, edits and checks, a check judged by its completion."""
    from flowgauge.functions.scalars import token_count, validation_outcome

    done = found.where("kind = 'tool.completed'").select("session_id", "call_id", F.col("text").alias("output")).dropDuplicates(["session_id", "call_id"])
    asked = found.where("kind in ('intent.stated', 'tool.requested')").join(done, ["session_id", "call_id"], "left")
    kind = F.when(F.col("kind") == "intent.stated", "prompt").when(F.col("tool_kind").isin("fs.read", "fs.search"), "read").when(F.col("tool_kind").isin("fs.edit", "fs.write"), "edit").when(F.col("tool_kind") == "exec.shell", "check")
    out = asked.select("session_id", "sequence", "event_id", "ts", kind.alias("kind"), F.when(kind == "check", validation_outcome(F.coalesce("output", F.lit("")))).alias("outcome"), F.coalesce("path", "command").alias("path"), token_count(F.concat_ws(" ", "tool_name", F.coalesce("arguments", "text"))).cast("long").alias("tokens"))
    return out.where("kind is not null").withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("sequence")).cast("long"))
