"""A second harness: routing runs, as an export of usage rows and a document of tasks, as canonical events.

A task's first attempt is a request to a provider; an attempt after one that failed is a failover when the provider
changes, and else an escalation when the model does. The usage rows give tokens and times; the document the goal (the
prompt) and the result of each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USAGE = "run_id string, task_id string, provider string, model string, input_tokens long, output_tokens long, latency_ms long, success int, created_at string"
TASK = "struct<id:string,title:string,role:string,status:string,error:string,finished_at:string>"
EXPLAIN = f"struct<run:struct<id:string,goal:string,status:string,created_at:string>,tasks:array<{TASK}>>"


def events(usage: DataFrame, explain: DataFrame) -> DataFrame:
    """session_id, sequence, kind, task_id, text, model, ts, input_tokens, output_tokens of runs: usage has one JSON object a
    row, explain one JSON document a run (column value each). Rows that can't be read, or have no run, are left out."""
    rows = usage.select(F.from_json("value", USAGE).alias("u")).select("u.*").where("run_id is not null and task_id is not null").withColumn("ts", F.try_to_timestamp("created_at"))
    docs = explain.select(F.from_json("value", EXPLAIN).alias("d")).where("d.run.id is not null")
    attempt = Window.partitionBy("run_id", "task_id").orderBy(F.asc_nulls_last("ts"), "provider", "model")
    tried = rows.withColumn("before", F.lag(F.struct("success", "provider", "model")).over(attempt))
    failed = F.col("before.success") == 0
    marker = F.when(failed & (F.col("before.provider") != F.col("provider")), "route.failover").when(failed & (F.col("before.model") != F.col("model")), "route.escalated")
    text = lambda c: c.cast("string").alias("text")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = tried.withColumn("kind", marker).where("kind is not null").select(F.col("run_id").alias("session_id"), F.lit(1).alias("rank"), "kind", "task_id", text(F.concat_ws(" -> ", "before.provider", "provider")), "model", "ts", none("long", "input_tokens"), none("long", "output_tokens"))
    turns = tried.select(F.col("run_id").alias("session_id"), F.lit(2).alias("rank"), F.when(F.col("success") == 1, "response").otherwise("attempt.failed").alias("kind"), "task_id", text(F.col("provider")), "model", "ts", "input_tokens", "output_tokens")
    goals = docs.select(F.col("d.run.id").alias("session_id"), F.lit(0).alias("rank"), F.lit("intent.stated").alias("kind"), none("string", "task_id"), text(F.col("d.run.goal")), none("string", "model"), F.try_to_timestamp("d.run.created_at").alias("ts"), none("long", "input_tokens"), none("long", "output_tokens"))
    ends = docs.select(F.col("d.run.id").alias("session_id"), F.explode("d.tasks").alias("t")).select("session_id", F.lit(3).alias("rank"), F.when(F.col("t.status") == "failed", "task.failed").otherwise("task.completed").alias("kind"), F.col("t.id").alias("task_id"), text(F.coalesce("t.error", "t.title")), none("string", "model"), F.try_to_timestamp("t.finished_at").alias("ts"), none("long", "input_tokens"), none("long", "output_tokens"))
    order = Window.partitionBy("session_id").orderBy(F.expr("rank = 0").desc(), F.asc_nulls_last("ts"), "rank", "task_id", "model")
    return goals.unionByName(marks).unionByName(turns).unionByName(ends).withColumn("sequence", F.row_number().over(order).cast("long")).drop("rank")


def failed_routes(found: DataFrame) -> DataFrame:
    """Findings for failovers: session_id, sequence, task_id, confidence, 0.8 where the task has a response after it, else 0.55."""
    later = Window.partitionBy("session_id", "task_id").orderBy("sequence").rowsBetween(1, Window.unboundedFollowing)
    answered = F.max(F.when(F.col("kind") == "response", 1)).over(later)
    return found.withColumn("answered", answered).where("kind = 'route.failover'").select("session_id", "sequence", "task_id", F.when(F.col("answered") == 1, 0.8).otherwise(0.55).alias("confidence"))


def unearned_escalations(found: DataFrame) -> DataFrame:
    """Findings for escalations that bring nothing: session_id, sequence, task_id, confidence, 0.8 where the next turn of the
    task fails too, 0.6 where none follows, and none where it gives a response."""
    nxt = Window.partitionBy("session_id", "task_id").orderBy("sequence")
    return found.withColumn("following", F.lead("kind").over(nxt)).where("kind = 'route.escalated' and coalesce(following, '') <> 'response'").select("session_id", "sequence", "task_id", F.when(F.col("following") == "attempt.failed", 0.8).otherwise(0.6).alias("confidence"))
