"""Graph operators over edges (src, dst): what can be reached, to a depth, level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowgauge import shared

#: Rows of a batch that a walk gives back, or those of one start where they are more.
ROWS = 100_000


def reach(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, node and depth of every node within `depth` steps of each start (column node), nearest depth first. A pair of
    start and node is walked on from once, so that the work doesn't grow with the number of walks."""
    steps = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    rim = met = _cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    for at in range(1, depth + 1):
        ahead = rim.join(steps, rim["node"] == steps["src"]).select("start", F.col("dst").alias("node")).distinct()
        rim = _cut(ahead.join(met, ["start", "node"], "left_anti").withColumn("depth", F.lit(at)))
        if rim.isEmpty():
            break
        met = met.unionByName(rim)
    return met


def _walks(edges: DataFrame, by: str, found: Callable[[np.ndarray, int, np.ndarray, np.ndarray], tuple], schema: T.StructType) -> DataFrame:
    """found(nodes, start, reached, depths) of every node of every graph of by, from the nearest on: places in nodes, and the
    fewest edges to each. A task takes many graphs, one after the other, and holds the edges of one; from each of its nodes
    it walks to every other once, so that a pair of nodes is met as often as edges lead to its end, and never shuffled."""
    known = edges.select(by, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    key = T.StructType([schema.fields[0]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ends in _graphs(batches):
            nodes, at = np.unique(ends, return_inverse=True)
            after: list[list[int]] = [[] for _ in nodes]
            for s, d in set(map(tuple, at.reshape(ends.shape).tolist())):
                after[s].append(d)
            out, size = [], 0
            for start in range(len(nodes)):
                met: dict[int, int] = {}
                rim, depth = [start], 0
                while rim:
                    depth += 1
                    ahead = {n for r in rim for n in after[r]} - met.keys()
                    met.update(dict.fromkeys(ahead, depth))
                    rim = list(ahead)
                if met:
                    columns = found(nodes, start, np.fromiter(met.keys(), np.int64, len(met)), np.fromiter(met.values(), np.int64, len(met)))
                    out.append(columns)
                    size += len(columns[0])
                if size >= ROWS or out and start == len(nodes) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([keys] * size, to_arrow_type(key.fields[0].dataType)), *(pa.array(np.concatenate(c)).cast(to_arrow_type(f.dataType)) for c, f in zip(zip(*out), schema.fields[1:]))], schema.names)
                    out, size = [], 0

    return known.repartition(by).sortWithinPartitions(by).mapInArrow(each, schema)


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
    """Each key and its edges, of rows (key, src, dst) that are sorted by key."""
    held: list[np.ndarray] = []
    last: object = None
    for b in batches:
        keys, ends = b.column(0).to_pylist(), np.column_stack([b.column(1).to_numpy(), b.column(2).to_numpy()])
        begins = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for begin, end in zip(begins, [*begins[1:], len(keys)]):
            if held and keys[begin] != last:
                yield last, np.concatenate(held)
                held = []
            last = keys[begin]
            held.append(ends[begin:end])
    if held:
        yield last, np.concatenate(held)


def closure(edges: DataFrame, by: str = "session_id") -> DataFrame:
    """by, src, dst, depth: every node that can be reached from another within one graph of by, and the fewest edges to it.

    A graph is walked where its edges are, level by level from each node, whatever the longest walk is. A node on a cycle
    reaches itself. Rows with nulls are no edges.
    """
    schema = T.StructType([edges.schema[by], edges.schema["src"], edges.schema["dst"], T.StructField("depth", T.IntegerType())])
    return _walks(edges, by, lambda nodes, start, reached, depths: (np.full(len(reached), nodes[start]), nodes[reached], depths.astype(np.int32)), schema)


def reconstruction(edges: DataFrame, by: str = "session_id") -> DataFrame:
    """For each node that rests on others: how many parts it is made up of with itself, its depth, and a sum of their numbers."""

    def summed(nodes: np.ndarray, start: int, reached: np.ndarray, depths: np.ndarray) -> tuple:
        others = reached != start
        n = int(others.sum())
        rows = [(nodes[start], n + 1, depths[others].max(), nodes[reached[others]].sum() + nodes[start])] if n else []
        return tuple(np.array([r[k] for r in rows], np.int32 if k == 2 else np.int64) for k in range(4))

    long = T.LongType()
    return _walks(edges, by, summed, T.StructType([edges.schema[by], T.StructField("start", edges.schema["src"].dataType), T.StructField("parts", long), T.StructField("depth", T.IntegerType()), T.StructField("checksum", long)]))


def levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest walk to each node from one that nothing leads to; null for nodes on a cycle or behind one.

    Nodes that no edge leads to are peeled off a round at a time, with their edges: as many rounds as levels, and never
    more rows than edges. What can't be peeled is on a cycle or behind one.
    """
    edges = _cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    left = _cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    out, level = None, 0
    while True:
        free = _cut(left.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if out is None else out.unionByName(rest)
        part = free.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        left = _cut(left.join(free, "node", "left_anti"))
        edges = _cut(edges.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1


def neighbours(edges: DataFrame, both_ways: bool = False) -> DataFrame:
    """Each node's neighbours: node, neighbour."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))).distinct() if both_ways else out.distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle, however long."""
    return shortest_cycles(edges).select("node")


def _cut(df: DataFrame) -> DataFrame:
    """The same rows without what led to them, held in the checkpoint folder that driver and executors share."""
    shared.checkpoints(df.sparkSession)
    return df.checkpoint()


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """node and shortest, the least number of edges of a cycle through it, of every node on a cycle, however long.

    All nodes walk at once, a step at a time. A pair of start and node is walked on from once, where it is first met, and
    no more from a start that has come back; so the walk ends by itself, with at most as many steps as there are nodes.
    """
    edges = _cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    rim = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("length"))
    met = rim
    while True:
        home = rim.where("start = node").select("start")
        going = rim.join(home, "start", "left_anti").select("start", F.col("node").alias("src"), "length")
        step = going.join(edges, "src").select("start", F.col("dst").alias("node"), (F.col("length") + 1).alias("length")).distinct()
        rim = _cut(step.join(met, ["start", "node"], "left_anti"))
        if rim.isEmpty():
            return met.where("start = node").select("node", F.col("length").alias("shortest"))
        met = _cut(met.unionByName(rim))
