"""Periodic runs of words, by longest previous factors.

A suffix array (prefix doubling over many documents at once) and its common prefixes give the longest previous factor of
each place: the longest stretch of words from there that also begins earlier. These cut a document into Lempel-Ziv blocks.
A run that touches a block's border is found by Main's extensions: for each period, how far the words a period apart agree
to the left and to the right of the border. A run strictly inside a block is a copy of one in the block's earlier
occurrence: runs are kept in buckets by their start and copied from left to right.

Only runs of LEAST words and TIMES periods at least are asked for. A run that touches the border of blocks of lengths a
and b has a period below (a + b) / 2 and fewer than a + b words besides one period, so that borders with a + b <= 2 *
LEAST / 3 need no look, and documents whose longest common prefix is at most half of that have no run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run's fewest words and fewest periods.
LEAST, TIMES = 24, 3
#: Words of documents that share a suffix array; a longer document has one of its own. Periods looked at in one step.
TOGETHER, PERIODS = 60_000, 1 << 16


class Suffixes(NamedTuple):
    """The places of a sequence in the order of what follows; the common prefix of each with the one before it in that
    order; and for each k the rank of each place by its next 2**k symbols."""

    order: np.ndarray
    common: np.ndarray
    ranks: list[np.ndarray]


def suffixes(symbols: np.ndarray) -> Suffixes:
    """Prefix doubling. Places whose rank is theirs alone are left out of later sorting. Symbols are positive; what follows
    the end is less than any."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    now = symbols[order]
    new = np.concatenate(([True], now[1:] != now[:-1])) if n else np.zeros(0, bool)
    # a rank is one more than the place in order of the first of those that are equal, so that it stays when others are parted
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first + 1
    ranks = [rank[:n].astype(np.int32)]
    open_ = _shared(new)
    step = 1
    while len(open_):
        places = order[open_]
        after = np.minimum(places + step, n)
        key = rank[places] * (n + 2) + rank[after]
        by = np.argsort(key, kind="stable")
        key, places = key[by], places[by]
        order[open_] = places
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank = rank.copy()
        rank[places] = first + 1
        ranks.append(rank[:n].astype(np.int32))
        open_ = open_[_shared(fresh)]
        step *= 2
    return Suffixes(order, _forward(ranks, order[:-1], order[1:], n) if n else np.zeros(0, np.int64), ranks)


def _shared(new: np.ndarray) -> np.ndarray:
    """The places of those that are equal to a neighbour, given where equal ones begin."""
    if not len(new):
        return np.zeros(0, np.int64)
    alone = new & np.concatenate((new[1:], [True]))
    return np.flatnonzero(~alone)


def _forward(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How many symbols from a on equal those from b on."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + out, b + out
        inside = np.maximum(x, y) < n
        same = ranks[k][np.where(inside, x, 0)] == ranks[k][np.where(inside, y, 0)]
        out += (same & inside).astype(np.int64) << k
    return out


def _backward(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before a equal those before b."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        inside = np.minimum(x, y) >= 0
        same = ranks[k][np.where(inside, x, 0)] == ranks[k][np.where(inside, y, 0)]
        out += (same & inside).astype(np.int64) << k
    return out


def previous_factors(order: list[int], common: list[int]) -> tuple[list[int], list[int]]:
    """For each place the longest previous factor and an earlier place where it begins. Places leave the suffix array from
    the last to the first, so that both neighbours of the one that leaves are earlier; common[r] is between r - 1 and r."""
    n = len(order)
    place, lengths, sources = [0] * n, [0] * n, [0] * n
    for r, at in enumerate(order):
        place[at] = r
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    common = common + [0]
    for at in range(n - 1, -1, -1):
        r = place[at]
        p, q, up, down = before[r], after[r], common[r], common[after[r]]
        if up >= down:
            lengths[at], sources[at] = up, order[p] if up else 0
        else:
            lengths[at], sources[at] = down, order[q]
        if p >= 0:
            after[p] = q
        if q < n:
            before[q] = p
        common[q] = up if up < down else down
    return lengths, sources


def blocks(lengths: list[int]) -> list[int]:
    """The borders of the Lempel-Ziv blocks, 0 and the end among them."""
    out, at = [0], 0
    while at < len(lengths):
        at += max(1, lengths[at])
        out.append(at)
    return out


def at_borders(borders: list[int], ranks: list[np.ndarray], n: int) -> set[tuple[int, int, int]]:
    """start, end, period of the runs that touch a border, by Main's extensions."""
    edges = np.array(borders + [n], np.int64)
    span = edges[2:] - edges[:-2]
    least = 2 * LEAST // TIMES
    found: set[tuple[int, int, int]] = set()
    wide = np.flatnonzero(span > least)
    at, most = edges[1:-1][wide], (span[wide] - 1) // 2
    begun = 0
    while begun < len(at):
        stop = max(begun + 1, int(np.searchsorted(np.cumsum(most[begun:]), PERIODS)) + begun)
        many = most[begun:stop]
        s = np.repeat(at[begun:stop], many)
        p = np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many) + 1
        # words before and after the border against those a period to the left, then to the right
        for a, b in ((s - p, s), (s, s + p)):
            ok = (a >= 0) & (b <= n)
            x, y, q = a[ok], b[ok], p[ok]
            # nothing agrees on either side of the border: no run
            start, end = x - _backward(ranks, x, y), y + _forward(ranks, x, y, n)
            long = end - start >= np.maximum(LEAST, TIMES * q)
            found.update(zip(start[long].tolist(), end[long].tolist(), q[long].tolist()))
        begun = stop
    return found


def copied(borders: list[int], sources: list[int], found: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """found, and the runs strictly inside blocks, copied from the blocks' earlier occurrences. Buckets are by start; copies of
    copies come about as a bucket is filled before those to its right are."""
    buckets: dict[int, set[tuple[int, int]]] = {}
    starts: list[int] = []

    def put(start: int, end: int, period: int) -> None:
        if start not in buckets:
            buckets[start] = set()
            insort(starts, start)
        buckets[start].add((end, period))

    for run in found:
        put(*run)
    for s, t in zip(borders, borders[1:]):
        if t - s <= LEAST:
            continue
        back = s - sources[s]
        k = bisect_right(starts, s - back)
        while k < len(starts) and starts[k] < t - back:
            here = starts[k]
            for end, period in list(buckets[here]):
                if end < t - back:
                    put(here + back, end + back, period)
            k = bisect_right(starts, here)
    return {(start, end, period) for start, ends in buckets.items() for end, period in ends}


def runs_of(order: np.ndarray, common: np.ndarray, ranks: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """start, length, smallest period of all runs of one sequence, by start, then period. common[r] is between r - 1 and r."""
    n = len(order)
    lengths, sources = previous_factors(order.tolist(), common.tolist())
    borders = blocks(lengths)
    period: dict[tuple[int, int], int] = {}
    for start, end, q in copied(borders, sources, at_borders(borders, ranks, n)):
        period[start, end] = min(q, period.get((start, end), q))
    return sorted((start, end - start, q) for (start, end), q in period.items())


def runs(documents: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document's words. A document's symbols are its own, so that one suffix array serves them all; a mark
    after each document ends what is compared."""
    numbers: dict[str, int] = {}
    sizes = np.array([len(d) for d in documents], np.int64)
    words = np.array([numbers.setdefault(w, len(numbers)) for d in documents for w in d], np.int64)
    total, many = len(words), len(documents)
    owner = np.repeat(np.arange(many), sizes)
    symbols = np.zeros(total + many, np.int64)
    symbols[np.arange(total) + owner] = owner * (len(numbers) + 1) + words + 2
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols[begins + sizes] = np.arange(many) * (len(numbers) + 1) + 1
    found = suffixes(symbols)
    common = np.concatenate(([0], found.common)) if len(symbols) else found.common
    # documents follow each other in order too, as their symbols do: each with its mark first
    most = np.maximum.reduceat(common, begins) if many else np.zeros(0)
    out: list[list[tuple[int, int, int]]] = []
    for k in range(many):
        a, n = int(begins[k]), int(sizes[k])
        if n < LEAST or most[k] <= LEAST // TIMES:
            out.append([])
            continue
        inner = common[a + 1 : a + 1 + n].copy()
        inner[0] = 0
        levels = int(most[k]).bit_length()
        out.append(runs_of(found.order[a + 1 : a + 1 + n] - a, inner, [r[a : a + n] for r in found.ranks[:levels]]))
    return out


def kept(n: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of words that stay when each run is cut down to its first period."""
    out, at = [], 0
    for start, end in sorted((s + q, s + length) for s, length, q in found):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return out + [(at, n)] if at < n else out


def highest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length for its period; ties: the smallest start, then period."""
    best = None
    for run in found:  # they come by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _mapped(docs: DataFrame, words, row, schema: str) -> DataFrame:
    fields = [part.split(" ", 1) for part in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "array<struct<start:bigint,length:bigint,period:bigint>>": pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            keys: list[int | None] = []
            now: list[list[str]] = []
            size = 0

            def close() -> None:
                rows.extend(row(k, w, f) for k, w, f in zip(keys, now, runs(now)))

            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                own = words(key, WORD.findall(text.as_py()))
                if now and size + len(own) > TOGETHER:
                    close()
                    keys, now, size = [], [], 0
                keys.append(key)
                now.append(own)
                size += len(own)
            close()
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    return texts(docs).mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period) and the text with each run cut down to its
    first period (words joined by one space), for each row of docs (doc_id, text).

    A null text has no words; null doc_ids and repeated rows are kept, repeated rows have equal runs; no rows: no rows; other
    columns are ignored. A document is one task's work, whatever its length; its arrays take some 150 bytes a word.
    """
    row = lambda key, words, found: (key, [dict(zip(("start", "length", "period"), r)) for r in found], " ".join(w for a, b in kept(len(words), found) for w in words[a:b]))
    return _mapped(docs, lambda key, words: words, row, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(key: int | None, words: list[str]) -> list[str]:
    """The words, of one id in ten (by CRC-32) with a periodic tail made of its own words. A null id has none."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the run with the greatest exponent; runs_sha256 and
    collapsed_sha256, for the rows of docs as planted() has them. Awkward rows as in find(); without a run: four nulls."""

    def row(key: int | None, words: list[str], found: list[tuple[int, int, int]]) -> tuple:
        best = highest(found)
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        rest = " ".join(words if not found else [w for a, b in kept(len(words), found) for w in words[a:b]])
        return (key, len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())

    return _mapped(docs, planted, row, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
