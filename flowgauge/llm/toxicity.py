"""Toxicity: a convolutional text classifier in numpy with hashed word embeddings.

Words (letters and digits, lower case) are hashed to BUCKETS embeddings, and their first STEM characters, which words of
a family share, to STEMS more; a word's embedding is the sum of the two. Filters of one, two and three words slide over
the whole text, each is max-pooled, and a logistic layer reads the maxima. Training is by hand-written gradients (only
the maxima carry any) on a bounded sample of labelled documents; a fifth of it calibrates the score, and a threshold for
each language. Scoring uses each filter's table of word responses, in chunks, so that memory does not follow a text's length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import small_batches

BUCKETS, STEMS, STEM = 1 << 15, 1 << 13, 4
DEPTH, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
#: The bound of the labelled sample: so many rows, of those of at most so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.03, 7
#: Standard errors taken off a word's log-odds before training.
CAUTION = 2.0
THRESHOLD = 0.3
#: Words scored at once.
CHUNK = 1 << 16
_WORD = re.compile(r"[^\W_]+")
PAD = BUCKETS + STEMS


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        code = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass"))
        k = code(word) % BUCKETS << 32 | BUCKETS + code(word[:STEM]) % STEMS
        if len(word) <= 64:
            if len(self) >= 250_000:
                self.clear()
            self[word] = k
        return k


_buckets = _Buckets()


def hashed(text: str) -> np.ndarray:
    """Rows of the embedding table for each word: its own and its stem's."""
    words = _WORD.findall(text.lower())
    return np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)).view(np.int32).reshape(-1, 2)


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS + STEMS + 1 rows, the last of zeros
    filters: list[np.ndarray]  # for each width: width x DEPTH x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict | None = None

    def tables(self) -> list[np.ndarray]:
        """For each width and place in it, every word's response."""
        return [self.embedding @ w[k] for w in self.filters for k in range(len(w))]


def _conv(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = x @ w[0]
    for k in range(1, len(w)):
        out[:-k] += x[k:] @ w[k]
    return out


def log_odds(ids: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each bucket, the lower confidence bound of the log-odds that a document with the word is toxic, at least 0:
    where the first component of the embeddings starts."""
    seen = np.zeros((2, PAD))
    for i, y in zip(ids, labels):
        seen[int(y), np.unique(i)] += 1
    n = np.bincount(labels.astype(int), minlength=2)[:2]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return np.maximum(0, odds - CAUTION * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)))


def train(ids: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fits the network to documents given as bucket numbers."""
    rng = np.random.default_rng(SEED)
    e = rng.normal(0, 0.02, (PAD + 1, DEPTH)).astype(np.float32)
    e[:PAD, 0] = log_odds(ids, labels)
    e[PAD] = 0
    filters = [rng.normal(0, 0.4, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0] = np.abs(w[:, 0]) + 0.4
    bias, weight = np.zeros(FILTERS * len(WIDTHS), np.float32), np.abs(rng.normal(0, 0.1, FILTERS * len(WIDTHS))).astype(np.float32)
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.02, 0.98))  # no labels: nothing is known to be toxic
    offset = float(np.log(share / (1 - share)))
    squares = [np.full_like(x, 1e-4) for x in (e, *filters, bias, weight)]
    o2 = 1e-4
    pad = np.full((max(WIDTHS) - 1, 2), PAD, np.int32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            parts = [np.concatenate([ids[k], pad]) for k in chosen]
            flat = np.concatenate(parts)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            x = e[flat[:, 0]] + e[flat[:, 1]]
            best = np.zeros((len(chosen), len(bias)), np.int64)
            top = np.zeros((len(chosen), len(bias)), np.float32)
            for n, w in enumerate(filters):
                c, cols = _conv(x, w), slice(n * FILTERS, (n + 1) * FILTERS)
                for d in range(len(chosen)):
                    # windows that begin in the text, or the padding of an empty one
                    part = c[starts[d] : max(starts[d] + 1, starts[d + 1] - len(pad))]
                    p = part.argmax(0)
                    best[d, cols], top[d, cols] = p + starts[d], part[p, np.arange(FILTERS)]
            act = top + bias
            relu = np.maximum(act, 0)
            z = relu @ weight + offset
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]).astype(np.float32) / len(chosen)
            g_weight = relu.T @ g + 1e-4 * weight
            g_act = np.outer(g, weight) * (act > 0)
            grads = {len(filters) + 1: g_act.sum(0), len(filters) + 2: g_weight}
            words, steps = [], []
            for n, w in enumerate(filters):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                ga, gw = g_act[:, cols], np.zeros_like(w)
                for k in range(len(w)):
                    where = np.minimum(best[:, cols] + k, len(flat) - 1)
                    gw[k] = np.einsum("df,dfe->ef", ga, x[where])
                    words += [flat[where, 0].ravel(), flat[where, 1].ravel()]
                    steps += [(ga[:, :, None] * w[k].T[None]).reshape(-1, DEPTH)] * 2
                grads[n + 1] = gw + 1e-4 * w
            touched, back = np.unique(np.concatenate(words), return_inverse=True)
            ge = np.zeros((len(touched), DEPTH), np.float32)
            np.add.at(ge, back, np.concatenate(steps))
            squares[0][touched] += ge**2
            e[touched] -= RATE * ge / np.sqrt(squares[0][touched])
            e[PAD] = 0
            for n, value in enumerate((*filters, bias, weight), 1):
                squares[n] += grads[n] ** 2
                value -= RATE * grads[n] / np.sqrt(squares[n])
            o2 += float(g.sum()) ** 2
            offset -= RATE * float(g.sum()) / np.sqrt(o2)
    return Model(e, filters, bias, weight, offset)


class Scorer:
    """Raw and calibrated scores of whole texts."""

    def __init__(self, model: Model) -> None:
        self.m, self.table = model, np.concatenate(model.tables(), axis=1)

    def maxima(self, ids: np.ndarray) -> np.ndarray:
        """Each filter's greatest response over a text; windows reach into padding at its end."""
        reach, best = max(WIDTHS) - 1, None
        for at in range(0, max(1, len(ids)), CHUNK):
            part = ids[at : at + CHUNK + reach]
            n = max(1, min(CHUNK, len(ids) - at))
            part = np.concatenate([part, np.full((n + reach - len(part), 2), PAD, np.int32)])
            t, found, col = self.table[part[:, 0]] + self.table[part[:, 1]], [], 0
            for w in WIDTHS:
                c = t[:n, col : col + FILTERS].copy()
                for k in range(1, w):
                    c += t[k : k + n, col + k * FILTERS : col + (k + 1) * FILTERS]
                found.append(c.max(0))
                col += w * FILTERS
            found = np.concatenate(found)
            best = found if best is None else np.maximum(best, found)
        return best

    def raw(self, text: str) -> float:
        return float(np.maximum(self.maxima(hashed(text)) + self.m.bias, 0) @ self.m.weight + self.m.offset)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.m.scale * self.raw(text) + self.m.shift, -40, 40))))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift of a logistic fit to raw scores, on targets drawn in by Platt's rule."""
    up, down = y.sum(), len(y) - y.sum()
    if not up or not down:
        return 1.0, 0.0
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    mean, spread = z.mean(), z.std() + 1e-6
    u = (z - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(300):  # damped Newton steps on a strictly convex loss
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = p * (1 - p)
        h = np.array([[(w * u * u).sum() + 0.01, (w * u).sum()], [(w * u).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, [((p - t) * u).sum() + 0.01 * a, (p - t).sum() + 0.01 * b])
        step *= min(1, 1 / (np.abs(step).max() + 1e-9))
        a, b = max(0.05, a - step[0]), b - step[1]
    return float(a / spread), float(b - a * mean / spread)


def _best_threshold(s: np.ndarray, y: np.ndarray) -> float:
    """The threshold of greatest F1; between equally good ones the middle of the gap."""
    order = np.argsort(-s, kind="stable")
    s, hit = s[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def signature(ids: np.ndarray) -> list[tuple[int, int]]:
    """Least hashes of a text's three-word runs, under four hash functions: near copies have most of them in common."""
    w = ids[:, 0].astype(np.uint64)
    if len(w) < 3:
        return []
    h = (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (w[2:] * np.uint64(0x165667B19E3779F9))
    return [(k, int((h * np.uint64(2 * k + 0x2545F4914F6CDD1D)).min())) for k in range(4)]


def fit_rows(rows: list[tuple[str, str | None, int]]) -> Model:
    """A calibrated model from (text, lang, toxic) rows; every fifth is kept for calibration where there are 50 or more.

    Of rows that share two of their four least hashes only the first is used, so that words of much copied texts don't
    count as often as they were copied.
    """
    ids, firsts, seen = [], [], set()
    for row in rows:
        i = hashed(row[0])
        mine = signature(i)
        if sum(x in seen for x in mine) < 2:
            ids.append(i)
            firsts.append(row)
        seen.update(mine)
    rows, y = firsts, np.array([r[2] for r in firsts], np.float32)
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
    model = train([i for i, h in zip(ids, held) if not h], y[~held])
    scorer = Scorer(model)
    use = held if held.any() else ~held
    z = np.array([scorer.raw(r[0]) for r, u in zip(rows, use) if u])
    model.scale, model.shift = _platt(z, y[use]) if len(z) else (1.0, 0.0)
    s, langs = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -40, 40))), [r[1] for r, u in zip(rows, use) if u]
    model.thresholds = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        if y[use][mine].sum() >= 5:
            model.thresholds[lang] = _best_threshold(s[mine], y[use][mine])
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of labelled rows, none of them held out: SAMPLE_ROWS of those whose text has at most
    SAMPLE_CHARS characters, drawn by a hash of doc_id and text; equal rows count once.

    A doc_id with several labels counts as toxic if one says so; null labels and ids are left out.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y")).where(remainder(F.col("id")) != 2)
    words = F.coalesce(F.col("text").cast("string"), F.lit(""))
    usable = docs.select(F.col("doc_id").cast("long").alias("id"), words.alias("words"), F.col("lang").cast("string").alias("tongue")).where(F.length("words") <= SAMPLE_CHARS).withColumn("print", F.xxhash64("id", "words"))
    # ids and prints alone are drawn first, so that no more than the sample's texts move
    drawn = usable.select("id", "print").join(known, "id").groupBy("print", "id").agg(F.first("y").alias("y")).orderBy("print", "id").limit(SAMPLE_ROWS)
    chosen = usable.join(F.broadcast(drawn.select(F.col("print").alias("drawn"), F.col("id").alias("drawn_id"), "y")), (F.col("print") == F.col("drawn")) & (F.col("id") == F.col("drawn_id")))
    rows = chosen.groupBy("print", "id").agg(F.min(F.struct("words", "tongue", "y")).alias("r")).select("id", "r.*").orderBy("id").limit(SAMPLE_ROWS).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.words))
    return fit_rows([(r.words, r.tongue, r.y) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), threshold (its language's, else 0.3), flagged (score >= threshold).

    One row for each row of docs (doc_id, text, lang). A null or empty text has the score of no words; a null doc_id has
    held_out null. No rows: no rows. Other columns are ignored; lang chooses the threshold and never touches the score.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s = [scorer.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(s, pa.float64())], ["doc_id", "lang", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, lang string, score double")
    limit = F.lit(THRESHOLD)
    for lang, value in (model.thresholds or {}).items():
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), limit.alias("threshold"), (F.col("score") >= limit).cast("int").alias("flagged"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is below the threshold of their language (0.3 where it has none, or there is no lang),
    with all their columns. A null or empty text has the score of no words; repeated rows are judged alike; no rows: no rows."""
    small_batches(docs.sparkSession)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at, tongue = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, limits = Scorer(shared.value), shared.value.thresholds or {}
        for b in batches:
            langs = b.column(tongue).to_pylist() if tongue is not None else [None] * b.num_rows
            keep = [scorer.score(t.as_py() or "") < limits.get(lang, THRESHOLD) for t, lang in zip(b.column(at), langs)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
