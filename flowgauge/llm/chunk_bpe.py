"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the last 32 code points cuts texts where their content says so, so that texts that share a passage
share the chunks inside it. A chunk is encoded once, by itself, and kept with the ends of its pre-tokens. Chunks are then
joined: what a chunk's end leaves open is encoded again together with the next chunk's beginning, until a pre-token ends
where one of the next chunk's own ends. From there on both read the same text from the same place, so that they agree to
the last pre-token whose end doesn't depend on what follows the chunk.

A pre-token's end depends on its own characters and on the next two at most (a contraction has three characters, white
space is given back one): the pre-tokens of a piece of text are those of the whole as long as two characters follow them.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowgauge.llm.common import texts

MODEL = "byte_bpe_50k.json"
#: Code points of a chunk: at least, at most, and the bits of the hash that are zero at a cut (one place in 256).
LEAST, MOST, BITS = 256, 4096, 8
#: Code points that the hash looks back over, as a power of two, and those hashed at a time.
LOOK, BLOCK = 5, 1 << 20
#: Chunks and pre-tokens that a worker keeps in either of two generations; longer pre-tokens aren't kept.
CHUNKS, PIECES, LONG = 16_384, 300_000, 64
#: The pattern's character classes are the tokenizer's up to here; texts with later ones are split by the tokenizer.
KNOWN = 0x530


def cuts(text: str) -> list[int]:
    """Where chunks end, the text's end last. A cut depends on the 32 code points before it and on where the chunk began."""
    out, begun = [], 0
    if len(text) > LEAST:
        for start in range(0, len(text), BLOCK):
            before = min(start, (1 << LOOK) - 1)
            part = text[start - before : start + BLOCK].encode("utf-32-le")
            h = np.frombuffer(part, "<u4").astype(np.uint32) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            factor = 0x01000193
            for k in range(LOOK):
                longer = h.copy()
                longer[1 << k :] += h[: -(1 << k)] * np.uint32(factor) if len(h) > 1 << k else 0
                h, factor = longer, factor * factor & 0xFFFFFFFF
            for at in (np.flatnonzero(h[before:] >> np.uint32(32 - BITS) == 0) + start + 1).tolist():
                while at - begun > MOST:
                    begun += MOST
                    out.append(begun)
                if at - begun >= LEAST:
                    out.append(at)
                    begun = at
        while len(text) - begun > MOST:
            begun += MOST
            out.append(begun)
    if begun < len(text):
        out.append(len(text))
    return out


class Recent(dict):
    """What make() gives for a key, kept in two generations: the older goes when the newer is full, and what is asked for
    again moves to the newer."""

    def __init__(self, make: Callable, most: int, longest: int) -> None:
        self.make, self.most, self.longest, self.older, self.made = make, most, longest, {}, 0

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            self.made += 1
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Chunk(NamedTuple):
    """The ends of a chunk's pre-tokens in code points, the ids up to each, and all ids as unsigned 32-bit integers."""

    ends: array
    counts: array
    ids: bytes


class ChunkBpe:
    def __init__(self, path: str, pattern: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take up what stands beside them are not known here")
        self.special = {t.content: i for i, t in added.items()}
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.regex, self.late = re.compile(_spelt_out(pattern)), re.compile(f"[^\\x00-{chr(KNOWN - 1)}]")
        signs = _signs()
        self.sign = str.maketrans({chr(b): c for b, c in signs.items()})
        byte = {c: bytes([b]) for b, c in signs.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = {i: b"".join(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocabulary.items()}
        self.digits = {i: str(i) for i in self.bytes}
        self.pieces = Recent(self.piece, PIECES, LONG)
        self.chunks = Recent(self.chunk, CHUNKS, MOST)

    def piece(self, piece: str) -> bytes:
        """The ids of one pre-token by the model's merges."""
        found = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.sign))
        return array("I", [t.id for t in found]).tobytes()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, without added tokens."""
        if self.late.search(text) is None:
            return self.regex.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def chunk(self, text: str) -> Chunk:
        found = self.split(text)
        ids = list(map(self.pieces.__getitem__, found))
        return Chunk(array("I", accumulate(map(len, found))), array("I", accumulate(map(len, ids))), b"".join(ids))

    def repaired(self, left: str, text: str, known: Chunk, closed: bool) -> tuple[list[bytes], int, str]:
        """Ids of left, which begins at a pre-token, and of the text after it up to the first end of a pre-token that is
        one of known's as well; that place in the text, or -1 if there is none, and what is then still open."""
        own, whole = {0, *known.ends}, left + text
        width = len(left) + 48
        while True:
            part = whole[:width]
            done, at = [], 0
            for piece in self.split(part):
                at += len(piece)
                if at + 2 > len(part) and not (closed and len(part) == len(whole)):
                    at -= len(piece)
                    break
                done.append(self.pieces[piece])
                if at - len(left) in own:
                    return done, at - len(left), ""
            if len(part) == len(whole):
                return done, -1, whole[at:]
            width *= 4

    def plain(self, text: str) -> list[bytes]:
        """The ids of a text without added tokens, in parts."""
        out, left, begun, stops = [], "", 0, cuts(text)
        for k, end in enumerate(stops):
            if end - begun < len(left) - MOST and k < len(stops) - 1:
                continue  # a pre-token over many chunks: take in as much again before the next attempt
            part, closed = text[begun:end], k == len(stops) - 1
            known = self.chunks[part]
            ends, counts, ids = known
            skip, begun = 0, end
            if left:
                done, at, left = self.repaired(left, part, known, closed)
                out += done
                if at < 0:
                    continue
                skip = counts[bisect_right(ends, at) - 1] if at else 0
            last = len(ends) if closed else bisect_right(ends, len(part) - 2)
            # an end before the place of agreement isn't an end of the whole
            if last and counts[last - 1] >= skip and (not skip or ends[last - 1] >= at):
                out.append(ids[skip : counts[last - 1]])
                left = part[ends[last - 1] :]
            else:
                left = part[at:] if skip else part
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers; added tokens' strings in it are those tokens."""
        if self.marks is None or self.marks.search(text) is None:
            return b"".join(self.plain(text))
        out: list[bytes] = []
        for k, part in enumerate(self.marks.split(text)):
            out += [array("I", [self.special[part]]).tobytes()] if k % 2 else self.plain(part)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _spelt_out(pattern: str) -> str:
    """The pattern with its classes as ranges of the code points below KNOWN, for the plain engine, which is twice as fast."""

    def ranges(name: str) -> str:
        inside = regex.compile(name)
        found = [k for k in range(KNOWN) if inside.fullmatch(chr(k))]
        starts = [k for k in found if k - 1 not in found]
        return "".join(f"\\u{a:04x}-\\u{next(k for k in found if k >= a and k + 1 not in found):04x}" for a in starts)

    letters, numbers, blanks = (ranges(c) for c in (r"\p{L}", r"\p{N}", r"\s"))
    inner = lambda m: m[0].replace(r"\s", blanks).replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
    pattern = re.sub(r"\[[^]]*\]", inner, pattern)
    return pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]")


def _signs() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printed, else the next one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_loaded: dict[tuple[str, str], ChunkBpe] = {}


def load(path: str, pattern: str) -> ChunkBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ChunkBpe(path, pattern)
    return _loaded[path, pattern]


def _mapped(rows: DataFrame, path: str | None, pattern: str | None, schema: pa.Schema, sql: str, row: Callable) -> DataFrame:
    path, pattern = path or public_tokenizers.path(MODEL), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            made = [row(bpe, key.as_py(), value.as_py()) for key, value in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)] if made else [pa.array([], f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, sql)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs (doc_id, text), whole texts.

    A null or empty text has no ids; null doc_ids and repeated rows are kept; no rows: no rows; other columns are ignored.
    Each worker loads the tokenizer from path (by default the installed byte-level one) and keeps its own chunks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _mapped(texts(docs), path, pattern, schema, "doc_id long, ids array<int>", lambda bpe, key, text: (key, array("I", bpe.encode(text)).tolist()))


def decode(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of each row of coded (doc_id, ids); null ids: an empty text; bytes that aren't UTF-8: U+FFFD."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    rows = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return _mapped(rows, path, pattern, schema, "doc_id long, text string", lambda bpe, key, ids: (key, bpe.decode(ids or [])))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of each row of docs; awkward rows
    as in encode()."""

    def row(bpe: ChunkBpe, key: int | None, text: str) -> tuple:
        ids = array("I", bpe.encode(text)).tolist()
        return key, len(ids), hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(texts(docs), path, pattern, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
