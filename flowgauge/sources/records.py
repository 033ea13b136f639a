"""Smaller sources and sinks: hook payloads, the event log, test reports, price books and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.sources.transcripts import TOOL_KINDS

#: Versions of the event document that can be read.
READABLE = ("0.1", "0.2", "0.3", "0.4", "0.5")
EVENT = "struct<schema:string,id:string,session_id:string,sequence:int,kind:string,actor:string,text:string,timestamp:string,parent_id:string,tool:struct<native_name:string,kind:string,call_id:string,arguments:string>,usage:struct<input_tokens:bigint,output_tokens:bigint,model:string>>"
LABELS = ("aligned_reasoning", "redundant_reasoning", "aligned_tool_call", "unnecessary_tool_call", "aligned_response", "over_explanation")


def tool_kind(name: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in TOOL_KINDS.items() for x in pair))
    return F.coalesce(kinds[name], F.lit("other"))


def hook_events(payloads: DataFrame) -> DataFrame:
    """Events of hook payloads (column value, one JSON object a row; batch or stream): session_id, kind, tool_name,
    tool_kind, call_id, text. A call that is over gives its request and its completion; other hooks give nothing."""
    get = lambda p: F.get_json_object("value", f"$.{p}")
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    hook = get("hook_event_name")
    none = F.expr("cast(array() as array<struct<kind: string, text: string>>)")
    found = (
        F.when(hook == "UserPromptSubmit", F.array(part("intent.stated", get("prompt"))))
        .when(hook == "PreToolUse", F.array(part("tool.requested", get("tool_input"))))
        .when(hook == "PostToolUse", F.array(part("tool.requested", get("tool_input")), part("tool.completed", get("tool_response"))))
        .when(hook == "Stop", F.array(part("task.completed", F.lit(None).cast("string"))))
        .when(hook == "SubagentStop", F.array(part("subagent.completed", F.lit(None).cast("string"))))
        .otherwise(none)
    )
    each = payloads.select(get("session_id").alias("session_id"), get("tool_name").alias("tool_name"), get("tool_use_id").alias("call_id"), F.explode(found).alias("x")).where("session_id is not null")
    return each.select("session_id", "x.kind", "tool_name", F.when(F.col("tool_name").isNotNull(), tool_kind(F.col("tool_name"))).alias("tool_kind"), "call_id", "x.text")


def append_log(events: DataFrame, path: str) -> None:
    """Appends events (event_id, session_id, sequence, kind, actor, text) to a log of JSON lines, a folder a session."""
    document = F.to_json(F.struct(F.lit("session.event/0.5").alias("schema"), F.col("event_id").alias("id"), "session_id", "sequence", "kind", "actor", "text"))
    events.select(document.alias("value"), F.col("session_id").alias("session")).write.mode("append").partitionBy("session").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's events, each id once (its first sequence); damaged lines and unknown versions are left out."""
    lines = spark.read.text(path).select(F.from_json("value", EVENT).alias("e")).select("e.*")
    version = F.element_at(F.split("schema", "/"), -1)
    known = lines.where(F.col("id").isNotNull() & version.isin(*READABLE))
    first = known.groupBy("id").agg(F.min_by(F.struct(*(c for c in known.columns if c != "id")), "sequence").alias("e"))
    return first.select("id", "e.*")


def test_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """check_id, status (error, failed, skipped or passed) and seconds of each case in JUnit reports."""
    case = "_classname string, _name string, _time double, failure string, error string, skipped string"
    raw = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\u0000").schema(case).load(path)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("failure").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return raw.select(F.concat_ws("::", "_classname", "_name").alias("check_id"), status.alias("status"), F.col("_time").alias("seconds"))


def verdict(outcomes: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """One row: verdict, and counts. Of several runs of a check the worst counts; a required check (check_id) without a
    run leaves the task incomplete, a failed one has it rejected."""
    rank = F.when(F.col("status") == "error", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "passed", 2).otherwise(3)
    worst = outcomes.groupBy("check_id").agg(F.min(rank).alias("rank"))
    if required is not None:
        worst = required.select("check_id").distinct().join(worst, "check_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    found = worst.agg(F.count(F.lit(1)).alias("checks"), count(F.col("rank") <= 1).alias("failed"), count(F.col("rank").isNull() | (F.col("rank") == 3)).alias("missing"))
    return found.select(F.when(F.col("failed") > 0, "rejected").when((F.col("missing") > 0) | (F.col("checks") == 0), "incomplete").otherwise("accepted").alias("verdict"), "checks", "failed", "missing")


def price_book(spark: SparkSession, path: str) -> DataFrame:
    """model, effective_from and rates of a price book, with a row for each alias too."""
    rates = "struct<input:double,output:double,cache_read:double,cache_write:double>"
    raw = spark.read.schema(f"prices array<struct<model:string,aliases:array<string>,effective_from:date,rates:{rates}>>").json(path, multiLine=True)
    each = raw.select(F.explode("prices").alias("p"))
    names = F.array_distinct(F.concat(F.array("p.model"), F.coalesce("p.aliases", F.expr("cast(array() as array<string>)"))))
    return each.select(F.explode(names).alias("model"), "p.effective_from", "p.rates.*")


def priced(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """turns (turn_id, model, day and tokens by kind) with dollars by the latest prices in force; none: null."""
    from pyspark.sql import Window

    p = prices.select(F.col("model").alias("p_model"), "effective_from", *(F.col(c).alias(f"rate_{c}") for c in ("input", "output", "cache_read", "cache_write")))
    both = turns.join(p, (F.col("model") == F.col("p_model")) & (F.col("effective_from") <= F.col("day")), "left")
    latest = Window.partitionBy("turn_id").orderBy(F.desc_nulls_last("effective_from"))
    dollars = sum(F.coalesce(F.col(f"{c}_tokens"), F.lit(0)) * F.col(f"rate_{c}") for c in ("input", "output", "cache_read", "cache_write")) / 1e6
    return both.withColumn("r", F.row_number().over(latest)).where("r = 1").select(*turns.columns, dollars.alias("dollars"))


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid and refused records of an annotation file (JSON lines); a record needs an id and a known gold label."""
    raw = spark.read.schema("id string, session_id string, phase string, gold_label string, predicted_label string, score double, tokens bigint").json(path)
    good = F.col("id").isNotNull() & F.col("gold_label").isin(*LABELS) & (F.col("predicted_label").isNull() | F.col("predicted_label").isin(*LABELS))
    return raw.where(good), raw.where(~good | good.isNull())
