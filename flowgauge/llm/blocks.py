"""Searches by a query set against all rows, in blocks.

Vectors are packed into blocks of rows. Each block of candidates goes to a task with the blocks of queries that meet it
there, is prepared once, and then searched for each of them. Each meeting gives at most k rows a query, which are merged
by a partial aggregation. The more blocks of candidates there are, the fewer tasks share one: from twice as many as there
are cores on, each is sent to one task and prepared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import cut, small_batches

#: Rows in a block of candidates and of queries: 8 MB and 128 KB for 64 doubles a row.
CANDIDATES, QUERIES = 16_384, 256


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows whose id and vector are whole: no null, no null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size rows of equal dimension: block, dim, ids and data (64-bit integers and doubles, row by row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(data).tobytes()], pa.binary())], ["dim", "ids", "data"])

        for b in batches:
            ids, v = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                mine = np.nonzero(sizes == dim)[0]
                for at in range(0, len(mine), size):
                    part = mine[at : at + size]
                    data = flat[(ends[part][:, None] + np.arange(dim)[None, :]).ravel()]
                    have = held.setdefault(int(dim), ([], []))
                    have[0].append(ids[part])
                    have[1].append(data)
                    if sum(map(len, have[0])) >= size:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "dim int, ids binary, data binary").withColumn("block", F.monotonically_increasing_id())


Found = Iterator[tuple[int, np.ndarray, np.ndarray]]


def search(table: DataFrame, every: int, k: int, kind: str, prepare: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], Found]]) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by every, the k best of what is found.

    prepare(candidate ids, candidates) gives a function of query ids and queries, which gives, for each query, its number
    and its best candidates' ids and scores, best first, without the query's own id. Vectors meet those of their own
    dimension. A repeated query row asks once; a repeated candidate row may be found as often as it occurs.
    """
    spark, rows = table.sparkSession, vectors(table)
    small_batches(spark)
    total = rows.count()
    parts, some = max(1, -(-total // CANDIDATES)), max(1, -(-total // every // QUERIES))
    packed = cut(_pack(rows.repartition(parts), CANDIDATES))
    asked = cut(_pack(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).repartition(some), QUERIES))
    #: One row of 12 bytes for each block of candidates.
    there = [(r.block, r.dim) for r in packed.select("block", "dim").toLocalIterator()]
    if not there:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    by_dim: dict[int, list[int]] = {}
    for block, dim in there:
        by_dim.setdefault(dim, []).append(block)
    cores = max(1, spark.sparkContext.defaultParallelism)
    #: Tasks that share a block of candidates.
    share = max(1, min(some, -(-2 * cores // len(there))))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, block in zip(b.column("dim").to_pylist(), b.column("block").to_pylist()):
                near = by_dim.get(dim, [])
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(near), pa.int64()), pa.array(near, pa.int64())], ["asked", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ask = None, None
        for b in batches:
            # a block of candidates comes before the blocks of queries that meet it
            for asked, dim, i, v in zip(*(b.column(x) for x in ("asked", "dim", "ids", "data"))):
                ids, data = np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(v.as_buffer()) if dim.as_py() else np.zeros(0)
                data = data.reshape(len(ids), dim.as_py())
                if not asked.is_valid:
                    held, ask = (ids, data), None
                    continue
                if ask is None:
                    ask = prepare(*held)
                out = [(np.full(len(found), ids[n]), found, scores) for n, found, scores in ask(ids, data)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    pairs = asked.select("dim", "block").mapInArrow(partners, "asked long, met long")
    first = asked.select(F.col("block").alias("asked"), "dim", "ids", "data")
    queries = pairs.join(first, "asked").select("met", F.pmod(F.xxhash64("asked"), F.lit(share)).cast("int").alias("part"), "asked", "dim", "ids", "data")
    places = F.explode(F.sequence(F.lit(0), F.lit(share - 1)))
    candidates = packed.select(F.col("block").alias("met"), places.alias("part"), F.lit(None).cast("long").alias("asked"), "dim", "ids", "data")
    tasks = max(1, min(len(there) * share, 16 * cores))
    met = candidates.unionByName(queries).repartition(tasks, "met", "part").sortWithinPartitions("met", "part", F.asc_nulls_first("asked"))
    found = met.select("asked", "dim", "ids", "data").mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def order(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greatest score, then smallest id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.nonzero(scores >= edge)[0]
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def needed(ids: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """Which rows of groups of equal vectors some query can ask for: the rows that are among a group's first k once all rows
    of one other id are left out. Rows are ordered by group and then id; new marks each group's first."""
    count, group = np.arange(len(ids)), np.cumsum(new) - 1
    begins = new | np.concatenate([[True], ids[1:] != ids[:-1]])
    run, at = np.cumsum(begins) - 1, np.nonzero(begins)[0]
    # the most rows of one id before each id's, within its group: a running maximum that a new group always passes
    most = np.maximum.accumulate(group[at] * (len(ids) + 1) + np.diff(np.append(at, len(ids)))) - group[at] * (len(ids) + 1)
    before = np.where(new[at], 0, np.concatenate([[0], most[:-1]]))
    return count - np.nonzero(new)[0][group] - before[run] < k


def expand(begin: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The places begin[g] up to begin[g + 1] of each of the groups, one after the other."""
    sizes = begin[groups + 1] - begin[groups]
    return np.repeat(begin[groups] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
