"""Packing token sequences by minimum bin slack.

Every document becomes word-level BPE ids and an end id. Whole windows of a long document are sequences of their own;
the remaining lengths of a task's documents are packed window by window: the longest remaining piece is placed, and a
subset-sum dynamic programme over the multiset of the other lengths, on one big integer as bit set, finds the multiset
that comes closest to the free space, with its counts read back from the steps. Should no multiset fill a window
exactly, one more piece is cut. What is left at a task's end is cut at powers of two, which take no padding.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from flowgauge.llm.common import texts

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 2
#: Tokens of remainders that a task holds before it packs them, and those it then keeps for the next round.
HELD, KEPT = 1 << 21, 1 << 16
#: Entries of a worker's table of words; it is halved when full. Words over LONG characters don't enter it.
WORDS, LONG = 400_000, 64
#: Output rows of a batch.
ROWS = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters whose normal form, case and class are the same in every version of the character tables. A text of these
#: alone is split here, word by word, just as the tokenizer would split it; any other text goes to the tokenizer whole.
_PLAIN = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x149), *range(0x14A, 0x17F), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
_class = lambda kind: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)
_OTHER = re.compile("[^" + "".join(map(re.escape, _PLAIN)) + "]|<\\|")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 ones stand for themselves, the
    others, in order, are the letters from 256 on."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = str.maketrans(_byte_letters())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        """A word is in normal form and lower case already, and one pre-token, so that the model's merges alone are left."""
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.tokenizer.model.tokenize(spelt)]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONG:
            if len(self) >= WORDS:
                for key in [k for k, _ in zip(self, range(WORDS // 2))]:
                    del self[key]
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower())))


_loaded: dict[str, WordIds] = {}


def load(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def closest(lengths: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to room without passing it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in lengths if x <= room), reverse=True):
        left, times = min(lengths[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, times = left - times, times * 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += times
            total -= length * times
    return dict(taken)


class Packer:
    """Takes (doc_id, start, ids, doc_tokens) pieces; gives rows of SCHEMA, in the order of sequences."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY) -> None:
        self.next, self.capacity, self.held = first_sequence, capacity, 0
        self.pool: dict[int, list[tuple]] = defaultdict(list)

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // 4
            yield doc_id, start, length, zlib.crc32(ids), doc_tokens, self.next, offset
            offset += length
        self.next += 1

    def put(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.pool[length].append(piece)
        self.held += length

    def take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= length
        return piece

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """All rows that are settled once this document is there."""
        total, start, wide = len(ids) // 4, 0, self.capacity * 4
        while (start + self.capacity) <= total:
            yield from self.sequence([(doc_id, start, ids[start * 4 : start * 4 + wide], total)])
            start += self.capacity
        if start < total:
            self.put((doc_id, start, ids[start * 4 :], total))
        if self.held >= HELD:
            yield from self.pack(KEPT)

    def pack(self, keep: int) -> Iterator[tuple]:
        """Fills sequences to the last place while more than keep tokens, and those of a sequence, are held."""
        while self.held > keep and self.held >= self.capacity:
            chosen = [self.take(max(self.pool))]
            room = self.capacity - len(chosen[0][2]) // 4
            for length, count in closest({k: len(v) for k, v in self.pool.items()}, room).items():
                chosen += [self.take(length) for _ in range(count)]
                room -= length * count
            if room:
                doc_id, start, ids, total = self.take(min(k for k in self.pool if k > room))
                chosen.append((doc_id, start, ids[: room * 4], total))
                self.put((doc_id, start + room, ids[room * 4 :], total))
            yield from self.sequence(chosen)

    def end(self) -> Iterator[tuple]:
        """The rest: sequences as long as the powers of two that make up its length."""
        yield from self.pack(0)
        left = [self.take(k) for k in sorted(self.pool, reverse=True) for _ in range(len(self.pool[k]))]
        size = 1 << max(0, self.capacity.bit_length() - 1)
        rest = sum(len(p[2]) // 4 for p in left)
        while rest:
            while size > rest:
                size >>= 1
            chosen, room = [], size
            while room:
                doc_id, start, ids, total = left.pop(0)
                length = min(room, len(ids) // 4)
                chosen.append((doc_id, start, ids[: length * 4], total))
                if length * 4 < len(ids):
                    left.insert(0, (doc_id, start + length, ids[length * 4 :], total))
                room -= length
            rest -= size
            yield from self.sequence(chosen)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each piece of docs (doc_id, text) in sequences of at most CAPACITY tokens, without padding.

    A null or empty text is its end id alone. A null doc_id is packed like any other; repeated rows are packed each.
    No rows: no rows. Other columns are ignored. sequence_id holds the task's number in its high bits: it is unique and
    the same when a task is run again. Every task packs what it reads, in bounded memory, and nothing is shuffled.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, rows = load(path), Packer(TaskContext.get().partitionId() << 40), []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names)
            rows.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                rows.extend(packer.add(doc_id.as_py(), words.encode(text.as_py()) + end))
                if len(rows) >= ROWS:
                    yield batch()
        rows.extend(packer.end())
        yield batch()

    return texts(docs).mapInArrow(run, SCHEMA)
