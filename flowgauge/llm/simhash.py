"""SimHash near-duplicates: fingerprints of 4-word shingles, linked exactly at a small Hamming radius.

Fingerprints are compared in tiles with numpy's exclusive-or and bit counts. The distinct fingerprints are sorted by
bit counts (of the word's halves, then of quarters, then of bytes), so that a tile spans few counts; a pair of tiles is
skipped when their counts, summed over these parts, differ by more than the radius. That is a lower bound of the Hamming
distance, so nothing is lost. The more fingerprints there are, the more parts a tile is narrow in, and the greater the
share of pairs that is skipped; the work still grows faster than the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import byte_texts, components, cut, met, texts

SEED = 42
WORDS = 4
RADIUS = 4
#: Tiles' sides, and how many rows of tiles are bounded at once.
TILE, RUN = 128, 256
#: Fingerprints in a block, the unit that is sent to a task: 16,384 for small inputs, at most a million (8 MB).
BLOCK, MOST_BLOCK, EVEN_BLOCKS = 16_384, 1_000_000, 128
#: Links held before they are folded into the block pair's union.
FOLD = 2_000_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words split at ASCII white space, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    grams = list(map(b" ".join, zip(*(w[k:] for k in range(words))))) if len(w) >= words else [b" ".join(w)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65_536):
        part = grams[at : at + 65_536]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, sha: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row of docs (doc_id, text), and sha (of the text), if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = byte_texts(b)
            fp = np.array([fingerprint(t) for t in all_], np.uint64).view(np.int64)
            more = [pa.array([hashlib.sha256(t).hexdigest() for t in all_], pa.string())] if sha else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp), *more], ["doc_id", "fp"] + ["sha"] * sha)

    return texts(docs).mapInArrow(run, "doc_id long, fp long" + ", sha string" * sha)


def _bounds(fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest bit counts of each run of size fingerprints: of the 8 bytes, the 4 quarters and the 2 halves."""
    c = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    quarters = c[:, ::2] + c[:, 1::2]
    c = np.concatenate([c, quarters, quarters[:, ::2] + quarters[:, 1::2]], axis=1)
    at = np.arange(0, len(fps), size)
    return np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Lower bounds of the Hamming distance between each run of a and each run of b: of every part of the word the gap
    between its counts, or the sum of its two parts' bounds where that is more."""
    gap = lambda k: np.maximum(0, np.maximum(lo_a[:, None, k] - hi_b[None, :, k], lo_b[None, :, k] - hi_a[:, None, k]))
    quarters = [np.maximum(gap(8 + q), gap(2 * q) + gap(2 * q + 1)) for q in range(4)]
    return sum(np.maximum(gap(12 + h), quarters[2 * h] + quarters[2 * h + 1]) for h in range(2))


class _Union:
    """Array union-find over the members of two blocks; every root is its component's first member."""

    def __init__(self, n: int) -> None:
        self.p, self.held, self.count = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.count += len(i)
        if self.count > FOLD:
            self.fold()

    def fold(self) -> None:
        if self.held:
            i, j = (np.concatenate(x) for x in zip(*self.held))
            while len(i):
                a, b = self.p[i], self.p[j]
                keep = a != b
                i, j, a, b = i[keep], j[keep], a[keep], b[keep]
                np.minimum.at(self.p, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(q := self.p[self.p], self.p):
                    self.p = q
        self.held, self.count = [], 0


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked within a and between a and b (b None: within a): fewer than members, and no link lost."""
    both = a if b is None else np.concatenate([a, b])
    union, other, base = _Union(len(both)), a if b is None else b, 0 if b is None else len(a)
    (lo_a, hi_a), (lo_b, hi_b) = _bounds(a, TILE), _bounds(other, TILE)
    for first in range(0, len(lo_a), RUN):
        near = _apart(lo_a[first : first + RUN], hi_a[first : first + RUN], lo_b, hi_b) <= radius
        for s, t in zip(*np.nonzero(np.triu(near, first) if b is None else near)):
            s += first
            x, y = a[s * TILE : (s + 1) * TILE], other[t * TILE : (t + 1) * TILE]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if b is None and s == t:
                i, j = i[i < j], j[i < j]
            if len(i):
                union.add(i + s * TILE, j + t * TILE + base)
    union.fold()
    member = np.nonzero(union.p != np.arange(len(both)))[0]
    return both[member], both[union.p[member]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b between fingerprints, in whose components all those lie that a chain of links joins; prints has fp, distinct."""
    spark = prints.sparkSession
    total = prints.count()
    blocks = max(1, min(EVEN_BLOCKS, -(-total // BLOCK)), -(-total // MOST_BLOCK))
    part = lambda at, bits: F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)))
    # the other half, quarter or byte is what is left of the one above; runs get the narrower in more parts the more rows there are
    keys = [part(0, 32), part(32, 32), part(0, 16), part(32, 16), *(part(16 * k, 8) for k in range(4)), F.col("fp")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches]
        fps = np.concatenate(parts).view(np.uint64) if parts else np.zeros(0, np.uint64)
        if len(fps):
            lo, hi = _bounds(fps, len(fps))
            yield pa.RecordBatch.from_arrays([pa.array([fps.tobytes()], pa.binary()), pa.array([lo[0].tobytes() + hi[0].tobytes()], pa.binary())], ["fps", "span"])

    # coalesced too: a session that deals rows to more partitions still gets no more blocks, whose pairs grow with the square
    ranged = prints.select("fp").repartitionByRange(blocks, *keys).coalesce(blocks).sortWithinPartitions(*keys)
    packed = cut(ranged.mapInArrow(pack, "fps binary, span binary").withColumn("block", F.monotonically_increasing_id()))
    #: One row for each block: 56 bytes for 16,384 to a million fingerprints.
    spans = sorted((r.block, r.span) for r in packed.select("block", "span").toLocalIterator())
    if not spans:
        return spark.createDataFrame([], "a long, b long")
    ids = np.array([s[0] for s in spans], np.int64)
    ends = np.frombuffer(b"".join(s[1] for s in spans), np.int16).reshape(len(spans), 2, 14)

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                near = k + np.nonzero(_apart(ends[k : k + 1, 0], ends[k : k + 1, 1], ends[k:, 0], ends[k:, 1])[0] <= radius)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), ids[k])), pa.array(ids[near])], ["one", "two"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two, x, y in zip(*(b.column(c).to_pylist() for c in ("one", "two", "x", "y"))):
                i, j = linked(np.frombuffer(x, np.uint64), None if one == two else np.frombuffer(y, np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(i.view(np.int64)), pa.array(j.view(np.int64))], ["a", "b"])

    pairs = spark.range(len(ids)).mapInArrow(partners, "one long, two long")
    first = packed.select(F.col("block").alias("one"), F.col("fps").alias("x"))
    second = packed.select(F.col("block").alias("two"), F.col("fps").alias("y"))
    met = pairs.join(first, "one").join(second, "two").select("one", "two", "x", "y")
    tasks = max(1, min(len(ids) * (len(ids) + 1) // 2, 4 * spark.sparkContext.defaultParallelism if len(ids) < EVEN_BLOCKS else len(ids) * 16))
    return met.repartition(tasks, F.xxhash64("one", "two")).mapInArrow(compare, "a long, b long")


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """Each distinct fingerprint of prints (doc_id, fp): fp, n (its rows), least (its smallest doc_id) and root (that of its component)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    return cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that a chain of links reaches, the row's own included. A null or blank text has
    fingerprint zero and is linked like any other; a null doc_id keeps its row, and never is a component_id unless all
    ids of the component are null; repeated rows stay repeated. No rows: no rows. Other columns are ignored.
    """
    prints = cut(fingerprints(docs))
    placed = _rooted(prints, radius)
    first = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    of = cut(met(placed, first, "root", "component_id", "fp").select("fp", "component_id", "n"))
    return met(prints, of, "fp", "component_id", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component of docs (doc_id, text, any others), with all its columns; rows without a doc_id stay.

    Of the rows with a doc_id the one with the smallest stays; of several with that id, in this order, the one whose text
    has the smallest SHA-256, and the one whose other columns come first as JSON. Rows of one doc_id whose texts belong to
    different components are each judged in its own. No rows: no rows.
    """
    id_, sha, place = "keep one: id", "keep one: sha", "keep one: place"
    prints = cut(fingerprints(docs, True))
    rooted = met(prints, _rooted(prints, radius).select("fp", "n", "root"), "fp", "root", "sha")
    chosen = rooted.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "sha")).alias("one")).select(F.col("one.doc_id").alias("_id"), F.col("one.sha").alias("_sha"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    known = docs.where("doc_id is not null").select(*names, F.col("doc_id").cast("long").alias(id_), whole.alias(sha))
    kept = known.join(chosen, (F.col(id_) == F.col("_id")) & (F.col(sha) == F.col("_sha")), "left_semi")
    order = F.to_json(F.struct(*(c for c, name in zip(names, docs.columns) if name != "text")))
    first = kept.withColumn(place, F.row_number().over(Window.partitionBy(id_, sha).orderBy(order))).where(F.col(place) == 1)
    return first.select(*names).unionByName(docs.where("doc_id is null"))
