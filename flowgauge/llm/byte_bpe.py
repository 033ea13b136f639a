"""Byte-level BPE by prefix dynamic programming.

In the encoding of a byte string each prefix has exactly one valid last token: the token that ends the prefix and whose
predecessor, the last token of what precedes it, may stand beside it (the two encode as themselves). Last tokens are
kept for every prefix, so that one more byte costs one look-up of the suffixes, equal prefixes are never computed again,
and an edit leaves the prefixes before it as they are.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowgauge.llm.common import texts

RANKS = "byte_bpe_50k.tiktoken"
#: Entries of a worker's table of prefixes and of either generation of its table of pieces; pairs of tokens it remembers.
PREFIXES, PIECES, BESIDE = 1_000_000, 400_000, 1_000_000
#: Pieces over this many bytes are encoded without entering the tables.
LONG = 64


class PrefixBpe:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.sizes = {i: len(t) for t, i in self.ranks.items()}
        self.longest = max(self.sizes.values())
        self.split = regex.compile(pattern)
        self.beside: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, dict[int, list[tuple[bytes, float]]]] = {0: {}, -1: {}}
        self.finder = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.finder.add_word(token.decode("latin-1"), (i, len(token)))
        self.finder.make_automaton()
        self.next: dict[int, int] = {}
        self.token = [-1]
        self.pieces = _Pieces(self)

    def merged(self, data: bytes, below: int = 1 << 30) -> list[bytes]:
        """The plain definition: join the neighbours of least rank, the leftmost first, until none has a rank under below."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The parts that at some time make up a token's left (0) or right (-1) end, each with the rank of the merge that
        takes it up, which for the token itself never comes."""
        if (known := self.edges[side].get(token)) is None:
            part, known, until = self.bytes[token], [], math.inf
            while part:
                known.append((part, until))
                until = self.ranks[part]
                halves = self.merged(part, until)
                part = halves[side] if len(halves) == 2 else b""
            self.edges[side][token] = known
        return known

    def may_stand(self, first: int, second: int) -> bool:
        """Whether two tokens side by side encode as themselves: no merge across their border comes before both of its
        parts are taken up. Equal merges go from left to right, so that the second's own comes too late in a tie."""
        if (known := self.beside.get((first, second))) is None:
            if len(self.beside) > BESIDE:
                self.beside.clear()
            ranks, right = self.ranks, self.edge(second, 0)
            known = self.beside[first, second] = not any((rank := ranks.get(a + b)) is not None and rank < until and rank <= limit for a, until in self.edge(first, -1) for b, limit in right)
        return known

    def append(self, data: bytes, end: int, last: list[int]) -> int:
        """The last token of data[:end], given in last (by length) those of the shorter prefixes."""
        ranks, beside = self.ranks, self.beside
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(data[start:end])
            if token is not None:
                if start == 0:
                    return token
                may = beside.get((last[start], token))
                if self.may_stand(last[start], token) if may is None else may:
                    return token
        raise ValueError("a byte has no token")

    def lasts(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix, by its length (-1 for the empty one); known: those of the first prefixes."""
        last = list(known) if known else [-1]
        for end in range(len(last), len(data) + 1):
            last.append(self.append(data, end, last))
        return last

    def edit(self, data: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """The text after an edit and its last tokens; the prefixes up to the edit are taken over, and so is what follows
        once longest bytes in a row have the last tokens they had."""
        new = data[:at] + added + data[at + removed :]
        out, shift, same = last[: at + 1], len(added) - removed, 0
        for end in range(at + 1, len(new) + 1):
            if same >= self.longest:
                out += last[end - shift :]
                break
            out.append(self.append(new, end, out))
            same = same + 1 if end - shift > at + removed and last[end - shift] == out[end] else 0
        return new, out

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        out, end, sizes = [], len(data), self.sizes
        while end:
            out.append(last[end])
            end -= sizes[last[end]]
        out.reverse()
        return out

    def found(self, data: bytes, last: list[int]) -> Iterator[tuple[int, int]]:
        """Appends to last the last tokens of all longer prefixes, and gives each with the place of its last byte. The automaton
        has all tokens in the data by their ends, the longest first; one of those that end at a place is valid there."""
        beside = self.beside
        for end, (token, size) in self.finder.iter(data.decode("latin-1")):
            if end != len(last) - 1:
                continue
            if start := end + 1 - size:
                may = beside.get((last[start], token))
                if not (self.may_stand(last[start], token) if may is None else may):
                    continue
            last.append(token)
            yield end, token

    def piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token. Prefixes are numbered: next holds the number of a prefix with one more byte."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) > LONG:
            last = [-1]
            for _ in self.found(data, last):
                pass
            return self.tokens(data, last)
        if len(self.token) > PREFIXES:
            self.next, self.token = {}, [-1]
        after, token, at, last, known = self.next, self.token, 0, [-1], 0
        for byte in data:
            if (below := after.get(at << 8 | byte)) is None:
                break
            at = below
            last.append(token[at])
            known += 1
        if known < len(data):
            for end, found in self.found(data, last):
                below = after[at << 8 | data[end]] = len(token)
                token.append(found)
                at = below
        return self.tokens(data, last)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Pre-token -> its ids in bytes, computed when first asked for. Of two generations the older goes when the newer is
    full; what is asked for in the older moves to the newer, so that frequent pieces stay."""

    def __init__(self, bpe: PrefixBpe) -> None:
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.bpe.piece(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= LONG:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[tuple[str, str], PrefixBpe] = {}


def load(path: str, pattern: str) -> PrefixBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = PrefixBpe(path, pattern)
    return _loaded[path, pattern]


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text), whole texts.

    A null or empty text has no tokens; null ids and repeated rows are kept; no rows: no rows. Other columns are ignored.
    Each worker loads the vocabulary from path (by default the installed byte-level one).
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            n, ids, decoded = [], [], []
            for text in b.column("text"):
                coded = bpe.encode(text.as_py())
                n.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(coded)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
