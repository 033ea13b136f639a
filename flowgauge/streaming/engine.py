"""The incremental engine: one event at a time into a session's state, in whatever order and however often events come.

The state of a session is a value (counts) and maps. What was met is kept for ever, as digests: ids of the events applied, so
that an event that comes again changes nothing; requests whose usage is counted, so that each counts once; and the calls that
were made. The places of edits and checks are kept too, so that what depends on order is right for events that come late.
Digests lie in one bucket, or in many small ones once there are more, and places in blocks: a session's events of a batch
read and write each bucket or block once, and an event's cost does not grow with its session. The one bucket and the first
block are in the value, so that a small session is read once and written once a batch. A session that is
silent for a time reports itself closed by a timer. All of it is in the state store, and a restarted query goes on from
its checkpoint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowgauge.shared import checkpoints
from flowgauge.sources import transcripts

EVENTS = "session_id string, event_id string, seq long, call string, mark string, request_id string, used long"
REPORT = "session_id string, n_events long, requests long, tokens_used long, duplicate_calls long, peak_unvalidated_edits long, closed boolean"
#: Digests in one bucket at most, those in one of many at most, places in a block, and rows applied at once.
ALONE, SHARED, BLOCK, ROWS = 1024, 64, 1024, 2000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_of(records: DataFrame) -> DataFrame:
    """Records as the engine's events: a call is a tool with its arguments; a mark tells an edit or a check; used are the
    tokens that the record's request states."""
    blocks = transcripts.parsed(records).withColumn("kind", transcripts.event_kind(F.col("role"), F.col("block_type")))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    asked = F.col("kind") == "tool.requested"
    command = F.get_json_object("arguments", "$.command")
    mark = F.when(asked & F.col("tool_name").isin("Edit", "MultiEdit", "NotebookEdit", "Write"), "edit").when(asked & command.rlike(r"^\s*(?:pytest|ruff|mypy|tox|make\s+(?:test|check|lint|ci))(?:\s|$)"), "check")
    used = F.coalesce(F.col("usage.input_tokens"), F.lit(0)) + F.coalesce(F.col("usage.output_tokens"), F.lit(0))
    return blocks.select(
        "session_id", F.substring(F.sha2(F.concat_ws("\u0000", part("session_id"), part("uuid"), part("block_index"), part("kind")), 256), 1, 16).alias("event_id"), F.col("line").cast("long").alias("seq"),
        F.when(asked, F.concat_ws(" ", "tool_name", "arguments")).alias("call"), mark.alias("mark"), "request_id", used.cast("long").alias("used"),
    )


def peak(marks: list[tuple[int, str]]) -> int:
    """The most edits since a check, or since the start."""
    open_ = most = 0
    for _, mark in sorted(marks):
        open_ = 0 if mark == "check" else open_ + 1
        most = max(most, open_)
    return most


def buckets(kept: int) -> int:
    """How many buckets hold so many digests: a power of two."""
    return 1 if kept <= ALONE else 1 << ((kept - 1) // SHARED).bit_length()


def digest(kind: str, text: str) -> str:
    return hashlib.blake2b(f"{kind} {text}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def placed(text: str) -> dict[int, str]:
    """A block's marks by their places."""
    return {int(seq): mark for seq, mark in (x.split(":") for x in text.split())}


def written(marks: dict[int, str]) -> str:
    return " ".join(f"{seq}:{mark}" for seq, mark in marks.items())


class Kept:
    """The digests of a session: alone holds them while they are few, then state has them in buckets, which are read when they
    are first asked for and written by flush()."""

    def __init__(self, state: object, kept: int, alone: str) -> None:
        self.state, self.kept, self.n, self.changed = state, kept, buckets(kept), set()
        self.read = {0: set(alone.split())} if self.n == 1 else {}

    def bucket(self, at: int) -> set[str]:
        if at not in self.read:
            self.read[at] = set(self.state.getValue((at,))[0].split())
        return self.read[at]

    def add(self, key: str) -> bool:
        """Whether the digest is new."""
        at = int(key[:8], 16) & (self.n - 1)
        found = self.bucket(at)
        if key in found:
            return False
        found.add(key)
        self.changed.add(at)
        self.kept += 1
        return True

    def flush(self) -> None:
        before, self.n = self.n, buckets(self.kept)
        if self.n == 1:
            return
        # a bucket is split into those with its number modulo the old count; one at a time is read
        for at in sorted(self.changed) if self.n == before else range(before):
            parts = {k: [] for k in range(at, self.n, before)}
            for key in self.bucket(at):
                parts[int(key[:8], 16) & (self.n - 1)].append(key)
            for k, keys in parts.items():
                self.state.updateValue((k,), (" ".join(keys),))
            del self.read[at]
        self.read, self.changed = {}, set()

    def alone(self) -> str:
        return " ".join(self.read[0]) if self.n == 1 else ""


class Engine(StatefulProcessor):
    """The state of one session. idle: milliseconds of silence after which it reports itself closed, or None."""

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n long, requests long, used long, duplicates long, kept long, alone string, marks string, blocks long")
        self.kept = handle.getMapState("kept", "bucket long", "digests string")
        self.marks = handle.getMapState("marks", "block long", "marks string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, requests, used, duplicates, kept, alone, first_block, blocks = self.counts.get() or (0, 0, 0, 0, 0, "", "", 0)
        met, places = Kept(self.kept, kept, alone), placed(first_block)
        for batch in rows:
            columns = [batch[c].tolist() for c in ("event_id", "seq", "call", "mark", "request_id", "used")]
            for first in range(0, len(batch), ROWS):
                marks: dict[int, str] = {}
                for event_id, seq, call, mark, request_id, tokens in zip(*(c[first : first + ROWS] for c in columns)):
                    if not met.add(digest("event", event_id)):
                        continue
                    n += 1
                    if isinstance(request_id, str) and met.add(digest("request", request_id)):
                        requests, used = requests + 1, used + int(tokens)
                    if isinstance(call, str) and not met.add(digest("call", call)):
                        duplicates += 1
                    if isinstance(mark, str):
                        (places if 0 <= seq < BLOCK else marks)[int(seq)] = mark
                met.flush()
                blocks += self.mark(marks)
        counts = (n, requests, used, duplicates, met.kept, met.alone(), written(places), blocks)
        self.counts.update(counts)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self.report(key, False, counts)

    def mark(self, marks: dict[int, str]) -> int:
        """Puts marks by their places into the state's blocks, the later of two at one place; how many
        blocks are new."""
        changed: dict[int, dict[int, str]] = {}
        for seq, mark in marks.items():
            changed.setdefault(seq // BLOCK, {})[seq] = mark
        more = 0
        for block, new in changed.items():
            known = self.marks.containsKey((block,))
            more += not known
            self.marks.updateValue((block,), (written((placed(self.marks.getValue((block,))[0]) if known else {}) | new),))
        return more

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield self.report(key, True, self.counts.get())

    def report(self, key: tuple, closed: bool, counts: tuple) -> pd.DataFrame:
        n, requests, used, duplicates, _, _, first_block, blocks = counts
        places = list(placed(first_block).items())
        if blocks:
            places += [place for _, (text,) in self.marks.iterator() for place in placed(text).items()]
        most = peak(places)
        return pd.DataFrame({"session_id": [key[0]], "n_events": [n], "requests": [requests], "tokens_used": [used], "duplicate_calls": [duplicates], "peak_unvalidated_edits": [most], "closed": [closed]})

    def close(self) -> None:
        pass


def fold(events: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of reports, one for each session that a batch of events (see rows_of) touches."""
    mode = "None" if idle is None else "ProcessingTime"
    return events.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Engine(idle), outputStructType=REPORT, outputMode="Update", timeMode=mode)


def run(spark: SparkSession, folder: str, state: str, files: int = 4) -> None:
    """Applies the events that are in a folder of Parquet files and haven't been applied, some files a batch; reports go to
    state/reports under their batch's number, so that a batch that is run again overwrites its own."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state}/reports/batch={number}")

        fold(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def reports(spark: SparkSession, state: str) -> DataFrame:
    """The last report of each session."""
    all_ = spark.read.parquet(f"{state}/reports")
    last = all_.groupBy("session_id").agg(F.max_by(F.struct(*(c for c in all_.columns if c not in ("session_id", "batch"))), "batch").alias("r"))
    return last.select("session_id", "r.n_events", "r.requests", "r.tokens_used", "r.duplicate_calls", "r.peak_unvalidated_edits")


def redelivered(events: DataFrame, folder: str, files: int) -> None:
    """Writes events to a folder in an order of no sense, every third of them twice and in different files."""
    # events are derived once for both copies
    both = events.withColumn("copy", F.explode(F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both.repartition(files, F.xxhash64("event_id", "copy")).drop("copy").write.mode("overwrite").parquet(folder)


def replayed(spark: SparkSession, records: DataFrame, files: int = 8) -> DataFrame:
    """The reports after all records were delivered as redelivered() has them, in several batches."""
    import uuid

    place = f"{checkpoints(spark)}/engine-{uuid.uuid4().hex}"
    # every core writes, and half of the files are a batch
    files = max(files, spark.sparkContext.defaultParallelism)
    redelivered(rows_of(records), f"{place}/events", files)
    run(spark, f"{place}/events", place, -(-files // 2))
    return reports(spark, place)
