"""Pairs of like vectors within a session, in blocks: no key's rows meet as a whole, and no pair is made only to be dropped.

A session's vectors are packed, in order, into blocks of BLOCK; each pair of blocks is compared by one matrix product. The
work is that of all pairs of a session, as the operators ask for; its rows are only those pairs that are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
#: Blocks of a session are dealt to as many groups, so that its pairs of blocks are cells for up to GROUPS * GROUPS tasks.
GROUPS = 8


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """The seqs and vectors of a block, without a Python object for each number."""
    vec, seqs = rows.field("vec"), rows.field("seq").to_numpy(zero_copy_only=False)
    sizes = np.unique(vec.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) != 1:
        raise ValueError(f"vectors of one session have {sizes.tolist()} components")
    return seqs, vec.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _packed(vectors: DataFrame) -> DataFrame:
    """session_id, block, seqs, data, dim: the vectors of a session by order, drawn to length one; empty and zero ones are left out."""
    double = F.col("vec").cast("array<double>")
    size = F.sqrt(F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x))
    known = vectors.select("session_id", F.col("seq").cast("long").alias("seq"), double.alias("vec"), size.alias("size")).where("size > 0")
    placed = known.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1) / BLOCK).cast("int"))
    rows = placed.select("session_id", "block", "seq", F.transform("vec", lambda x: x / F.col("size")).alias("vec"))
    return rows.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq", "vec"))).alias("rows"))


def pairs(vectors: DataFrame, least: float, first: bool = False) -> DataFrame:
    """session_id, seq, earlier, similarity (4 places) of vectors (session_id, seq, vec) whose rounded cosine is at least
    `least`; with first, only each one's first like it. A block is at most BLOCK rows."""
    key = vectors.schema["session_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                session, same = b.column("session_id")[row].as_py(), b.column("same")[row].as_py()
                (early, a), (late, c) = (_matrix(b.column(side)[row].values) for side in ("early", "late"))
                ids = [early, late]
                near = np.round(c @ a.T, 12)
                hit = np.floor(near * 1e4 + 0.5) / 1e4 >= least - 1e-12
                if same:
                    hit &= np.tri(len(c), len(a), -1, bool)
                i, j = np.nonzero(hit)
                if first:
                    i, at = np.unique(i, return_index=True)
                    j = j[at]
                yield pa.RecordBatch.from_arrays([pa.array([session] * len(i), b.column("session_id").type), pa.array(ids[1][i]), pa.array(ids[0][j]), pa.array(near[i, j])], ["session_id", "seq", "earlier", "similarity"])

    blocks = _packed(vectors)
    group = F.pmod(F.col("block"), F.lit(GROUPS))
    every = F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))
    early = blocks.select("session_id", group.alias("g"), F.col("block").alias("a"), F.col("rows").alias("early"), every.alias("h"))
    late = blocks.select("session_id", group.alias("h"), F.col("block").alias("b"), F.col("rows").alias("late"), every.alias("g"))
    met = early.join(late.hint("merge"), ["session_id", "g", "h"]).where("a <= b")
    found = met.select("session_id", "early", "late", (F.col("a") == F.col("b")).alias("same")).mapInArrow(run, f"session_id {key}, seq long, earlier long, similarity double")
    if first:
        found = found.groupBy("session_id", "seq").agg(F.min_by(F.struct("earlier", "similarity"), "earlier").alias("x")).select("session_id", "seq", "x.*")
    return found.withColumn("similarity", F.round("similarity", 4))


def redundancy(vectors: DataFrame, least: float) -> DataFrame:
    """Each session's share of vectors that are in a pair."""
    found = pairs(vectors, least)
    ends = found.select("session_id", "seq").unionByName(found.select("session_id", F.col("earlier").alias("seq"))).distinct()
    n = vectors.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    both = n.join(ends.groupBy("session_id").agg(F.count(F.lit(1)).alias("redundant")), "session_id", "left").withColumn("redundant", F.coalesce("redundant", F.lit(0)).cast("long"))
    return both.select("session_id", "total", "redundant", F.round(F.col("redundant") / F.col("total"), 4).alias("score"))
