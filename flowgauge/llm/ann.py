"""Approximate nearest neighbours by collision counting.

Every vector is lifted to the length of the longest (one more component), so that the largest inner product is the
nearest point. HASHES random directions project the points of a block; each direction's points are sorted by their
projections, once for all queries that meet the block. A query's window around its own projection starts small and grows on
all directions at once, by virtual rehashing: no bucket is built anew, only the window's two ends move outward in the
sorted array, and the points that they pass are counted, each once a direction. A point counted in SHARE of the directions
is a collision, and is verified by its true inner product; the search ends once enough points are verified, or the windows
hold all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm import blocks

EVERY, K = 20, 20
HASHES, SHARE, SEED = 64, 0.65, 11
#: Points verified before a search may end: so many, and so great a part of the block's distinct points.
VERIFY, PART = 500, 0.11
#: Half the first window, in standard deviations of the projections; each window is GROWTH times the last, and the last holds all.
FIRST, GROWTH, ROUNDS = 0.3, 1.2, 16


class Index:
    """Sorted projections of a block's distinct vectors."""

    def __init__(self, c: np.ndarray, ids: np.ndarray, k: int) -> None:
        # equal vectors are one point with the smallest ids of them: those that any query can ask for
        order = np.lexsort((ids, *c.T))
        new = np.concatenate([[True], (c[order][1:] != c[order][:-1]).any(1)])
        first = np.nonzero(new)[0]
        asked = blocks.needed(ids[order], new, k)
        self.ids = ids[order[asked]]
        self.begin = np.searchsorted((np.cumsum(new) - 1)[asked], np.arange(len(first) + 1))
        self.rows, self.k = c[order[first]], k
        scale = np.abs(self.rows).max(initial=0) or 1.0
        unit = self.rows / scale
        sizes = (unit * unit).sum(1)
        self.longest, self.scale = np.sqrt(sizes.max(initial=0)), scale
        lifted = np.concatenate([unit, np.sqrt(np.maximum(0, sizes.max(initial=0) - sizes))[:, None]], axis=1)
        self.directions = np.random.default_rng(SEED).normal(size=(lifted.shape[1], HASHES))
        projected = np.ascontiguousarray((lifted @ self.directions).T)
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        self.spread = float(projected.std()) or 1.0
        self.need = int(np.ceil(SHARE * HASHES))
        self.enough = min(len(self.rows), max(VERIFY, 4 * k, int(PART * len(self.rows))))

    def windows(self, q: np.ndarray) -> "Windows":
        return Windows(self, q)

    def search(self, q: np.ndarray, own: int, windows: "Windows", n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best found, without the query's own id; n is the query's place in windows."""
        mine = np.searchsorted(self.begin, np.nonzero(self.ids == own)[0], "right") - 1
        counts = np.zeros(len(self.rows), np.uint8)
        left = right = windows.middle(n)
        for r in range(ROUNDS + 1):
            more_left, more_right = windows.ends(r, n)
            self.passed(counts, more_left, left, right, more_right)
            left, right = more_left, more_right
            g = np.nonzero(counts >= self.need)[0]
            others = int((self.begin[g + 1] - self.begin[g]).sum()) - int((counts[mine] >= self.need).sum())
            if len(g) >= self.enough and others >= self.k:
                break
        score, ids = np.repeat(self.rows[g] @ q, self.begin[g + 1] - self.begin[g]), self.ids[blocks.expand(self.begin, g)]
        score, ids = score[ids != own], ids[ids != own]
        best = blocks.order(score, ids, self.k)
        return ids[best], score[best]

    def passed(self, counts: np.ndarray, low: np.ndarray, left: np.ndarray, right: np.ndarray, high: np.ndarray) -> None:
        """Counts the points between the windows' old ends (left, right) and their new ones (low, high)."""
        ends = zip(self.order, low.tolist(), left.tolist(), right.tolist(), high.tolist())
        places = np.concatenate([part for row, a, b, c, d in ends for part in (row[a:b], row[c:d])])
        counts += np.bincount(places, minlength=len(self.rows)).astype(np.uint8)

    def ask(self, ask: np.ndarray, q: np.ndarray) -> blocks.Found:
        windows = self.windows(q)
        for n in range(len(q)):
            yield n, *self.search(q[n], ask[n], windows, n)


class Windows:
    """The ends of all queries' windows, worked out a round at a time for all of them, when one asks for it."""

    def __init__(self, index: Index, q: np.ndarray) -> None:
        unit = q / np.abs(q).max(axis=1, keepdims=True)
        # a query's length doesn't change the order: it is drawn to the points' length
        self.at = unit / np.sqrt((unit * unit).sum(1, keepdims=True)) * index.longest @ index.directions[:-1]
        self.index, self.known = index, {}

    def middle(self, n: int) -> np.ndarray:
        """The places of a query's own projections in each direction's sorted array."""
        return self.places(-1, 0.0)[0][n]

    def ends(self, r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A query's first places, and those behind the last, in each direction. The last round's windows hold all points."""
        if r == ROUNDS:
            return np.zeros(HASHES, np.int64), np.full(HASHES, len(self.index.rows), np.int64)
        low, high = self.places(r, self.index.spread * FIRST * GROWTH**r)
        return low[n], high[n]

    def places(self, r: int, half: float) -> tuple[np.ndarray, np.ndarray]:
        """The windows of half this size for all queries; worked out when one first asks."""
        if r not in self.known:
            low, high = np.zeros(self.at.shape, np.int64), np.zeros(self.at.shape, np.int64)
            for h in range(HASHES):
                low[:, h] = np.searchsorted(self.index.sorted[h], self.at[:, h] - half)
                high[:, h] = np.searchsorted(self.index.sorted[h], self.at[:, h] + half, "right") if r >= 0 else low[:, h]
            self.known[r] = low, high
        return self.known[r]


def prepare(k: int) -> Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], blocks.Found]]:
    return lambda ids, c: Index(c, ids, k).ask


def nearest(table: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by inner product in double precision.

    Queries are the rows of table (vec_id, embedding) whose vec_id is divisible by every; candidates all rows but those
    of the query's own id, of the same dimension. Rows with a null id, or a vector that is null, zero or holds null or
    non-finite components, take no part. Ties go to the smaller vec_id; a repeated candidate row is returned as often as
    it occurs, a repeated query id asks once. Every candidate is indexed; with at most k of them all are returned. No
    rows: no rows. Other columns are ignored.
    """
    whole = table.where(F.exists(F.col("embedding"), lambda x: x != 0))
    return blocks.search(whole, every, k, "double", prepare(k))
