"""WARC archives compressed with Zstandard: one frame a record, and the dictionary in a leading skippable frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all its other frames. Each of
these is one complete WARC/1.1 record. The reader takes frames one by one, so memory holds one record and not the
archive, and checks magic numbers, header lines, lengths, digests and the closing blank lines.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import cut, new_folder, small_batches

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Payloads of this many bytes or more are stored once; later equal ones are revisits.
LEAST_REVISIT = 100
#: An archive is closed at this many uncompressed bytes; the dictionary is trained on at most SAMPLE bytes of its first records.
ROTATE, SAMPLE, DICTIONARY = 64 << 20, 1 << 20, 16 << 10
LEVEL = 3
#: A payload is hot if its rows are this part of all rows whose payload occurs more than once: there are at most HOT of them.
HOT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The record types of the format, and the forms of header values that become results.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
DIGITS, WHOLE, SHA256 = re.compile("[0-9]{1,18}"), re.compile("-?[0-9]{1,19}"), re.compile("sha256:[0-9a-f]{64}")
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Damaged(ValueError):
    """An archive or record that breaks the format."""


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record. A revisit holds HTTP headers only; the length and digest are of the full payload."""
    block = HTTP if revisit else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    target = " ".join((url or "").split())  # a line break in a URL must not begin another header
    lines += [f"WARC-Target-URI: {target}"] * bool(target) + [f"WARC-Page-ID: {page_id}"] * (page_id is not None)
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}"] + [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of one record; raises Damaged. A header may stand once (but for
    WARC-Concurrent-To, whose last is kept); lengths are ASCII digits, digests of payloads are in hex."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as error:
        raise Damaged("headers are not UTF-8") from error
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Damaged("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Damaged(f"bad header line {line[:80]!r}")
        if name.lower() in fields and name.lower() != "warc-concurrent-to":
            raise Damaged(f"{name} stands twice")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Damaged(f"no {name}")
    if fields["warc-type"] not in TYPES:
        raise Damaged(f"no type {fields['warc-type'][:80]!r}")
    for name, form in (("content-length", DIGITS), ("warc-payload-length", DIGITS), ("warc-page-id", WHOLE), ("warc-refers-to-page-id", WHOLE), ("warc-payload-digest", SHA256)):
        if name in fields and not form.fullmatch(fields[name]):
            raise Damaged(f"{name} has not its form")
    if len(rest) != (n := int(fields["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("the block's length is not its Content-Length")
    block = rest[:n]
    if (said := fields.get("warc-block-digest")) and said != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise Damaged("the block's digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if fields["warc-type"] == "response" and "warc-payload-digest" in fields:
        if fields["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}" or int(fields.get("warc-payload-length", len(payload))) != len(payload):
            raise Damaged("the payload's digest or length differs")
    return fields, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; where they are too few to train on, their own bytes serve as raw content."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY] or b"WARC/1.1\r\n"


def write_archive(records: list[bytes], rest: Iterable[bytes], out: io.RawIOBase) -> int:
    """Writes the dictionary, trained on the first records, then these and the rest; returns the number of records."""
    dictionary = train(records)
    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
    packer, count = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True), 0
    for part in (records, rest):
        for r in part:
            out.write(packer.compress(r))
            count += 1
    return count


def read_archive(source: io.RawIOBase) -> Iterator[bytes]:
    """The records of an archive, frame by frame. Raises Damaged for a missing dictionary or a broken or cut frame."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise Damaged("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise Damaged("the dictionary is cut off")
    if dictionary[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    unpacker, held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), b""
    while held or (held := source.read(1 << 16)):
        while len(held) < 4 and (more := source.read(1 << 16)):
            held += more
        magic = struct.unpack("<I", held[:4])[0] if len(held) >= 4 else 0
        if magic >> 4 == 0x184D2A5:
            while len(held) < 8 and (more := source.read(1 << 16)):
                held += more
            size = 8 + struct.unpack("<I", held[4:8])[0]
            while len(held) < size and (more := source.read(1 << 16)):
                held += more
            if len(held) < size:
                raise Damaged("a skippable frame is cut off")
            held = held[size:]
            continue
        if magic != FRAME:
            raise Damaged("no frame where one should begin")
        frame, parts = unpacker.decompressobj(), []
        try:
            while not frame.eof:
                if not held and not (held := source.read(1 << 16)):
                    raise Damaged("a frame is cut off")
                parts.append(frame.decompress(held))
                held = b""
        except zstandard.ZstdError as error:
            raise Damaged(str(error)) from error
        held = frame.unused_data
        yield b"".join(parts)


def assigned(pages: DataFrame) -> DataFrame:
    """Each page with its payload's digest and size and, where an equal payload of LEAST_REVISIT bytes or more has a
    smaller page_id, revisit (true) and refers_to. A revisit of a hot payload has no html any more.

    Only digests are grouped. Payloads that hold 1 in HOT or more of all repeated rows, and so at most HOT of them, are
    broadcast: their rows are decided where they are read, lose the html that a revisit doesn't store, and are dealt out by
    page_id. The other rows meet their payload's one row by digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    again = cut(base.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"))
    least = (again.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = again.where(F.col("n") >= least).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first"))
    later = lambda first: F.coalesce(F.col(first).isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col(first))), F.lit(False))
    known = base.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left").withColumn("html", F.when(~later("hot_first"), F.col("html")))
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.xxhash64("url").cast("string"))))
    rest = again.where(F.col("n") < least).select(F.col("digest").alias("again"), F.col("first"))
    met = known.withColumn("key", key).join(rest.hint("shuffle_hash"), F.col("key") == F.col("again"), "left").withColumn("first", F.coalesce("hot_first", "first"))
    return met.withColumn("revisit", later("first")).withColumn("refers_to", F.when(F.col("revisit"), F.col("first"))).drop("again", "first", "hot", "hot_first", "key")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) to archives below folder, a URI that pyarrow opens on driver and executors alike.

    Returns path and records of each archive. A task writes under a name of its own attempt; only the archives that are
    listed belong to the result, so what a lost task left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        names = ["page_id", "url", "html", "digest", "size", "refers_to", "revisit"]

        def records() -> Iterator[bytes]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    for page_id, url, html, digest, size, refers_to, revisit in zip(*(part.column(c).to_pylist() for c in names)):
                        yield record(page_id, url, b"" if revisit else html.encode(), digest, size, refers_to, revisit)

        source, k, ahead = records(), 0, next
        pending = ahead(source, None)
        while pending is not None:
            total = taken = 0
            samples: list[bytes] = []
            while pending is not None and taken < SAMPLE:
                samples.append(pending)
                taken += len(pending)
                pending = ahead(source, None)
            total = taken

            def rest() -> Iterator[bytes]:
                nonlocal pending, total
                while pending is not None and total < ROTATE:
                    total += len(pending)
                    yield pending
                    pending = ahead(source, None)

            path = f"{base}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.warc.zst"
            with store.open_output_stream(path) as out:
                count = write_archive(samples, rest(), out)
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    small_batches(pages.sparkSession)
    return cut(assigned(pages).select("page_id", "url", "html", "digest", "size", "refers_to", "revisit").mapInArrow(run, "path string, records long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the listed archives.

    Digest and length are computed from the payload for a response, and taken from its header for a revisit, which holds
    none. Raises Damaged where an archive breaks the format or holds another number of records than was listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda f, k: int(f[k]) if k in f else None
        for b in batches:
            for path, listed in zip(b.column("path").to_pylist(), b.column("records").to_pylist()):
                found, count = [], 0
                with store.open_input_stream(path) as source:
                    for data in read_archive(source):
                        f, payload = parse(data)
                        revisit = f["warc-type"] == "revisit"
                        size, digest = (int(f["warc-payload-length"]), f["warc-payload-digest"].removeprefix("sha256:")) if revisit else (len(payload), hashlib.sha256(payload).hexdigest())
                        found.append((number(f, "warc-page-id"), size, digest, f["warc-type"], number(f, "warc-refers-to-page-id")))
                        count += 1
                        if len(found) == 10_000:
                            yield _rows(found)
                            found = []
                if count != listed:
                    raise Damaged(f"{path} holds {count} records; {listed} were written")
                if found:
                    yield _rows(found)

    return archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(run, COLUMNS)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every row of pages and reads the archives back.

    A null html is an empty payload; a null url is left out; a null page_id makes a record without that header, which
    revisits an equal payload that has an id. Rows that repeat the smallest page_id of a payload are all responses.
    No rows: no archives and no rows. Other columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
from f
"""
