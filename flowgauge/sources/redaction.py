"""Redaction of text columns by ordered classes, as chained replacements that stay in the JVM, and of transcripts: home
and working folders become pseudonyms, file contents and long outputs a mark with their hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes in the order in which they are taken out, each a Java pattern.
CLASSES = {
    "private-key": r"(?s)-----BEGIN [A-Z0-9 ]*-----.*?(?:-----END [A-Z0-9 ]*-----|\z)",
    "aws-access-key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github-token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,})",
    "api-key": r"\bsk-[A-Za-z0-9_-]{16,}",
    "slack-token": r"\bxox[abposr]-[A-Za-z0-9-]{10,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "bearer-token": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
    "assigned-secret": r"""(?i)\b(?:password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token)["']?\s*[:=]\s*["']?(?!\[REDACTED:)[^\s"',;]{6,}""",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
}


#: What of an assigned secret stays: its name, and what stands before the value.
NAMED = r"""(?i)^([A-Za-z_-]+["']?\s*[:=]\s*["']?)"""


def _tag(name: str, salt: str) -> Callable[[Column], Column]:
    def tag(found: Column) -> Column:
        kept = F.regexp_extract(found, NAMED, 1) if name == "assigned-secret" else F.lit("")
        gone = F.substr(found, F.length(kept) + 1, F.length(found))
        return F.concat(kept, F.lit(f"[REDACTED:{name}#"), F.substring(F.sha2(F.concat(F.lit(salt), gone).cast("binary"), 256), 1, 8), F.lit("]"))

    return tag


def redact(text: Column, salt: str = "") -> Column:
    """text with every match of every class replaced by [REDACTED:class#hash]: eight digits of the salted SHA-256 of what
    was there, so that equal secrets stay equal and others differ. The name of an assigned secret stays."""
    for name, pattern in CLASSES.items():
        # text is worked out once for each class: its uses would double with every class otherwise
        text = F.element_at(F.transform(F.array(text), _replaced(name, pattern, salt)), 1)
    return text


def _replaced(name: str, pattern: str, salt: str) -> Callable[[Column], Column]:
    def one(text: Column) -> Column:
        tags = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _tag(name, salt))
        pieces = F.zip_with(F.split(text, pattern, -1), tags, lambda piece, t: F.concat(piece, F.coalesce(t, F.lit(""))))
        return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)

    return one


def pseudonym(value: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 12)


def redact_table(df: DataFrame, columns: list[str], salt: str = "") -> DataFrame:
    """df with its text columns redacted, and how many replacements of each class they hold (redacted: map<string,bigint>)."""
    out = df.withColumns({c: redact(F.col(c), salt) for c in columns})
    joined = F.concat_ws(" ", *columns)
    counts = F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.array(*(F.regexp_count(joined, F.lit(rf"\[REDACTED:{n}#[0-9a-f]{{8}}\]")).cast("long") for n in CLASSES)))
    return out.withColumn("redacted", F.map_filter(counts, lambda k, v: v > 0))


#: A home folder at the start of a path.
HOME = r"""(?:/home/[^/\s"'\\]+|/Users/[^/\s"'\\]+|/root(?=/|\b)|[A-Za-z]:\\{1,2}Users\\{1,2}[^\\/\s"']+)"""
LONGEST_OUTPUT = 2000


def import_corpus(events: DataFrame, folder: str, salt: str = "", longest: int = LONGEST_OUTPUT) -> DataFrame:
    """Writes events (see flowgauge.sources.transcripts) to folder/events as Parquet by session, redacted, and a manifest, one
    row a session, to folder/manifest; returns the manifest: session_id, events, redactions, dropped outputs, sha256.

    What a file reader gave becomes [file content: N lines, sha256:...], another output of more than longest characters
    [output: N characters, sha256:...]; home folders become ~.
    """
    from flowgauge.operators.steps import steps

    readers = steps(events).where("kind = 'completion' and tool_kind = 'fs.read'").select("session_id", F.col("idx").alias("sequence"), F.lit(True).alias("reads"))
    held = events.join(readers, ["session_id", "sequence"], "left")
    digest = lambda c: F.substring(F.sha2(F.concat(F.lit(salt), c).cast("binary"), 256), 1, 16)
    text = F.col("text")
    long = (F.col("kind") == "tool.completed") & (F.length(text) > longest)
    file_mark = F.concat(F.lit("[file content: "), F.size(F.split(text, "\n")).cast("string"), F.lit(" lines, sha256:"), digest(text), F.lit("]"))
    output_mark = F.concat(F.lit("[output: "), F.length(text).cast("string"), F.lit(" characters, sha256:"), digest(text), F.lit("]"))
    cut = F.when(F.col("reads"), file_mark).when(long, output_mark).otherwise(text)
    clean = lambda c: F.regexp_replace(redact(c, salt), HOME, "~")
    out = held.select("session_id", "sequence", "event_id", "kind", "actor", "tool_name", "tool_kind", clean(cut).alias("text"), clean(F.col("arguments")).alias("arguments"), (F.coalesce("reads", F.lit(False)) | long).alias("dropped"))
    out.write.mode("overwrite").partitionBy("session_id").parquet(f"{folder}/events")
    written = events.sparkSession.read.schema(out.schema).parquet(f"{folder}/events")
    marks = F.regexp_count(F.concat_ws(" ", "text", "arguments"), F.lit(r"\[REDACTED:[a-z0-9-]+#[0-9a-f]{8}\]"))
    lines = F.array_sort(F.collect_list(F.struct("sequence", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))))
    found = written.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.sum(marks).cast("long").alias("redactions"), F.count(F.when(F.col("dropped"), 1)).alias("dropped"), F.sha2(F.array_join(F.transform(lines, lambda x: x["sha"]), "").cast("binary"), 256).alias("sha256"))
    found.write.mode("overwrite").parquet(f"{folder}/manifest")
    return events.sparkSession.read.parquet(f"{folder}/manifest")
