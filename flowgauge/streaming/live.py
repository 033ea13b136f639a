"""The live side: transcripts tailed as a stream, the event log replayed, and the control loop over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowgauge.sources import transcripts


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that appear in a folder of transcripts, as a stream of file, value; a file's order is its records' own."""
    return spark.readStream.format("text").option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")


def tailed_events(lines: DataFrame) -> DataFrame:
    """Events of tailed lines, row by row: session_id, event_id, kind, tool_name, path, ts, text; what depends on other rows
    (sequence, parents, repeats) is for the batch that takes them up."""
    return transcripts.row_events(transcripts.records(lines.withColumn("line", F.lit(0))))


def replay(spark: SparkSession, log: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """analyse over all events of a log (see flowgauge.sources.records), every session by itself, each event once."""
    from flowgauge.sources.records import read_log

    return analyse(read_log(spark, log))


def control_loop(events: DataFrame, state: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame], deliver: Callable[[DataFrame], None]) -> StreamingQuery:
    """Observes a stream of events (session_id, event_id, ...), and for each batch analyses the sessions that it touches,
    decides, and intervenes.

    Observed events are appended to state/events, each id once however often it comes. decide gets all events of the
    sessions touched and gives advice (session_id, signal_id, ...); advice given before, by signal, is dropped, what is left is
    written to state/advice/<batch>, delivered, and then appended to state/ledger. A batch that is run again delivers what
    it had written and adds nothing, so that advice is delivered once, and again only where the driver died before it could
    note that; none is lost.
    """

    def known(spark: SparkSession, name: str) -> DataFrame | None:
        # a folder counts once its write has ended
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{name}/_SUCCESS")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return spark.read.parquet(f"{state}/{name}") if fs.exists(path) else None

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = known(spark, f"advice/{number}")
        if told is None:
            seen, fresh = known(spark, "events"), batch.dropDuplicates(["session_id", "event_id"])
            if seen is not None:
                fresh = fresh.join(seen.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti")
            fresh.write.mode("append").parquet(f"{state}/events")
            touched = batch.select("session_id").distinct()
            advice = without_told(spark, decide(known(spark, "events").join(touched, "session_id", "left_semi")))
            advice.write.mode("overwrite").parquet(f"{state}/advice/{number}")
            told = known(spark, f"advice/{number}")
        deliver(told)
        without_told(spark, told).write.mode("append").parquet(f"{state}/ledger")

    def without_told(spark: SparkSession, advice: DataFrame) -> DataFrame:
        given = known(spark, "ledger")
        return advice if given is None else advice.join(given.select("session_id", "signal_id"), ["session_id", "signal_id"], "left_anti")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
