"""Exact top-k inner products by pivot-table elimination.

Each component x becomes floor(256 x). For a block of candidates the distances to PIVOTS of them are tabled, once
for all queries that meet it. For a query the table gives, by the triangle inequality, the greatest of the lower bounds of its distance to each candidate, and so
an upper bound of the inner product, (|q|^2 + |c|^2 - d^2) / 2. Candidates are evaluated in the order of these bounds,
until the k-th best score found is greater than the next bound: then no other can enter, not even by a tie.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from flowgauge.llm import blocks

EVERY, K, PIVOTS, STEP = 50, 5, 48, 512
#: Below this sum doubles hold integers exactly.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(256.0 * x)


def pivots(c: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Candidates far from each other: each is the farthest from those before it; fewer where all others are equal to one."""
    chosen = [int(np.argmax((c * c).sum(1)))]
    far = ((c - c[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(c)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((c - c[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _integers(row: np.ndarray) -> list[int]:
    return [math.floor(256.0 * x) if abs(x) < 2.0**1000 else int(x) * 256 for x in row.tolist()]


class Table:
    """A block of candidates with the distances of each to the pivots, made once for all queries that meet it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        # equal rows are one candidate with the smallest ids of them: those that any query can ask for
        c = whole(vectors)
        key = c if np.isfinite(c).all() else vectors
        order = np.lexsort((ids, *key.T))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]).any(1)])
        self.k, asked = k, blocks.needed(ids[order], new, k)
        self.ids = ids[order[asked]]
        self.begin = np.searchsorted((np.cumsum(new) - 1)[asked], np.arange(new.sum() + 1))
        self.vectors = vectors[order[new]]
        self.rows = c[order[new]]
        self.most, self.largest = float(np.abs(self.rows).max(initial=1)), float(np.abs(self.vectors).max(initial=1))
        self.tables: dict[bool, tuple] = {}
        self.last: tuple[int | None, tuple] | None = None

    def scale(self, q: np.ndarray, vector: np.ndarray) -> int | None:
        """None where doubles hold the squared lengths of the query and of all candidates, and the products, exactly; else
        the power of two that brings all components below 1, for bounds with a slack."""
        if max(1, len(q)) * (self.most**2 + float(np.abs(q).max(initial=1)) ** 2) * 4 < EXACT:
            return None
        return math.frexp(max(self.largest, float(np.abs(vector).max(initial=1))))[1]

    def table(self, exact: bool) -> tuple:
        """Rows, squared lengths, pivots and the distances to these; not exact: of rows whose largest component is below 1."""
        if exact not in self.tables:
            rows = self.rows if exact else np.ldexp(self.vectors, -math.frexp(self.largest)[1])
            sizes, p = (rows * rows).sum(1), pivots(rows)
            self.tables[exact] = (rows, sizes, p, np.sqrt(np.maximum(0, sizes[None, :] + sizes[p][:, None] - 2 * rows[p] @ rows.T)))
        return self.tables[exact]

    def scaled(self, scale: int | None) -> tuple:
        """table() brought to a scale; the last one is kept."""
        if scale is None:
            return self.table(True)
        if self.last is None or self.last[0] != scale:
            (rows, sizes, p, table), by = self.table(False), math.frexp(self.largest)[1] - scale
            self.last = scale, (np.ldexp(rows, by), np.ldexp(sizes, 2 * by), p, np.ldexp(table, by))
        return self.last[1]

    def ask(self, ask: np.ndarray, vectors: np.ndarray) -> blocks.Found:
        q = whole(vectors)
        scales = [self.scale(a, b) for a, b in zip(q, vectors)]
        for n in sorted(range(len(q)), key=lambda n: -1 if scales[n] is None else scales[n]):
            scale = scales[n]
            rows, sizes, p, table = self.scaled(scale)
            # doubles round squared lengths of many rows below 1 by less than the slack squared
            mine, near, over = (q[n], 1e-6, 1e-3) if scale is None else (np.ldexp(vectors[n], -scale), 1e-4 + 1e-6 * q.shape[1], 1e-4 * max(1, q.shape[1]))
            own, at_pivots = mine @ mine, rows[p] @ mine
            away = np.sqrt(np.maximum(0, own + sizes[p] - 2 * at_pivots))
            low, gap = np.zeros(len(rows)), np.empty(len(rows))
            for j in range(len(p)):
                np.maximum(low, np.abs(np.subtract(table[j], away[j], out=gap), out=gap), out=low)
            bound = (own + sizes - np.maximum(0, low - near) ** 2) / 2 + over
            live = np.arange(len(rows))
            if scale is None:
                # the k-th best of the pivots' own scores (other rows than the query's) is passed by the k-th best of all
                seed = [s for j, s in zip(p, at_pivots) for i in self.ids[self.begin[j] : self.begin[j + 1]] if i != ask[n]]
                if len(seed) >= self.k:
                    live = np.nonzero(bound >= sorted(seed, reverse=True)[self.k - 1])[0]
            live = live[np.argsort(-bound[live], kind="stable")]
            yield n, *self._evaluated(live, bound, scale, q[n], vectors[n], ask[n])

    def _scores(self, part: np.ndarray, q: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Integer inner products, cut to the range of a long: as doubles, as longs or as Python's integers, whichever hold them."""
        most = self.most * float(np.abs(q).max(initial=1)) * max(1, len(q)) * 4
        if most < EXACT:
            return (self.rows[part] @ q).astype(np.int64)
        if most < 2.0**62 and max(self.most, float(np.abs(q).max(initial=1))) < 2.0**62:
            return self.rows[part].astype(np.int64) @ q.astype(np.int64)
        mine = _integers(vector)
        return np.array([max(LEAST, min(MOST, sum(a * b for a, b in zip(mine, _integers(self.vectors[g]))))) for g in part], np.int64)

    def _evaluated(self, live: np.ndarray, bound: np.ndarray, scale: int | None, q: np.ndarray, vector: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates in the order of their bounds until the k-th best found passes the next bound. A score cut to a long ties
        with all that are cut and passes no bound beyond a long, so that these are looked at too."""
        ids, found, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        while at < len(live):
            if len(found) == self.k:
                worst = float(found[-1]) if scale is None else math.ldexp(float(found[-1]) / 65536, -2 * scale)
                if bound[live[at]] < worst:
                    break
            part = live[at : at + step]
            at, step = at + step, min(2 * step, 8 * STEP)
            members = blocks.expand(self.begin, part)
            score = np.repeat(self._scores(part, q, vector), self.begin[part + 1] - self.begin[part])
            other = self.ids[members] != own
            ids, found = np.concatenate([ids, self.ids[members][other]]), np.concatenate([found, score[other]])
            best = np.lexsort((ids, ~found))[: self.k]
            ids, found = ids[best], found[best]
        return ids, found


def prepare(k: int) -> Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], blocks.Found]]:
    return lambda ids, vectors: Table(ids, vectors, k).ask


def top(table: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows of table (vec_id, embedding) whose vec_id is divisible by every; candidates all rows but those
    of the query's own id, of the same dimension. Rows with a null id, or a vector that is null or holds null or
    non-finite components, take no part. A repeated candidate row is returned as often as it occurs; a repeated query
    id asks once. Scores beyond a long are cut to its range. No rows: no rows. Other columns are ignored.
    """
    return blocks.search(table, every, k, "long", prepare(k))


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
