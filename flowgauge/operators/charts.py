"""Process behaviour charts over any number of sessions: no window is without a partition, and none holds a whole measure.

Rows are put into ranges of their order and numbered in two levels: within a range, and by the sizes of the ranges before it,
of which there are as many as ranges. Rules look back at most seven points; so points are cut into blocks, each with the
last seven of the block before it, and windows run within a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge import shared

BLOCK = 65536
#: Natural limits and sigma from the mean moving range, fewest sessions for limits, what counts as equal.
LIMIT, SIGMA, FEWEST, EPSILON = 2.66, 1.128, 8, 1e-9
BACK = 7


def numbered(frame: DataFrame, by: str, order: list[str], parts: int | None = None) -> DataFrame:
    """The rows with `place`, their number from 0 within `by` in that order, whatever share of all rows one `by` has. The
    order must tell rows of one `by` apart. Ranges are written first, as a range drawn again could differ."""
    spark = frame.sparkSession
    shared.checkpoints(spark)
    ranges = frame.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), by, *order)
    ranges = ranges.withColumn("part_", F.spark_partition_id()).checkpoint()
    sizes = ranges.groupBy(by, "part_").agg(F.count(F.lit(1)).alias("size_"))
    ahead = Window.partitionBy(by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(by).alias("by_"), F.col("part_").alias("at_"), F.coalesce(F.sum("size_").over(ahead), F.lit(0)).alias("offset_"))
    within = F.row_number().over(Window.partitionBy(by, "part_").orderBy(*order)) - 1
    met = ranges.withColumn("within_", within).join(offsets, F.col(by).eqNullSafe(F.col("by_")) & (F.col("part_") == F.col("at_")))
    return met.withColumn("place", F.col("within_") + F.col("offset_")).select(*frame.columns, "place")


def _blocks(points: DataFrame) -> DataFrame:
    """The points by block_, with those before it that its own (own_) look back at."""
    block = F.floor(F.col("place") / BLOCK)
    late = F.col("place") % BLOCK >= BLOCK - BACK
    copied = points.withColumn("block_", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    return copied.withColumn("own_", F.col("block_") == block)


def limits(points: DataFrame) -> DataFrame:
    """measure, centre, sigma, ucl, lcl of points with place, value and the measure's bounds low and high; none for a measure
    of fewer than eight. A limit beyond its bound is null."""
    w = Window.partitionBy("measure", "block_").orderBy("place")
    moved = _blocks(points).withColumn("moved", F.abs(F.col("value") - F.lag("value").over(w))).where("own_")
    sums = moved.groupBy("measure").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("centre"), F.avg("moved").alias("mr"), F.first("low").alias("low"), F.first("high").alias("high")).where(F.col("n") >= FEWEST)
    above, below = F.col("centre") + LIMIT * F.col("mr"), F.col("centre") - LIMIT * F.col("mr")
    return sums.select("measure", "centre", (F.col("mr") / SIGMA).alias("sigma"), F.when(F.col("high").isNull() | (above <= F.col("high")), above).alias("ucl"), F.when(F.col("low").isNull() | (below >= F.col("low")), below).alias("lcl"))


def signals(values: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """measure, session_id, place, value, rule, side of all signals of (measure, session_id, value, low, high and the columns of
    the order). Sessions where a measure is null or not a number are no part of its process.

    Rules: beyond_limits; two_of_three points beyond two sigma and four_of_five beyond one, the point itself among them;
    run_of_eight on one side of the centre. The last three only on a side whose limit lies within the measure's bounds, zones
    only where sigma is above 0.
    """
    known = values.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & F.col("measure").isNotNull())
    points = numbered(known, "measure", order, parts)
    joined = _blocks(points).drop("low", "high").join(limits(points), "measure")
    off = F.col("value") - F.col("centre")
    found = []
    for side, sign, limit in (("above", 1, F.col("ucl")), ("below", -1, F.col("lcl"))):
        open_ = limit.isNotNull()
        w = Window.partitionBy("measure", "block_").orderBy("place")
        far = lambda k: sign * off > (k + EPSILON) * F.col("sigma")
        count = lambda test, n: F.count(F.when(test, 1)).over(w.rowsBetween(1 - n, 0))
        zone = lambda k, n, least: open_ & (F.col("sigma") > 0) & far(k) & (F.col("place") + 1 >= n) & (count(far(k), n) >= least)
        found += [
            F.when(open_ & (sign * (F.col("value") - limit) > EPSILON), F.struct(F.lit("beyond_limits").alias("rule"), F.lit(side).alias("side"))),
            F.when(zone(2, 3, 2), F.struct(F.lit("two_of_three").alias("rule"), F.lit(side).alias("side"))),
            F.when(zone(1, 5, 4), F.struct(F.lit("four_of_five").alias("rule"), F.lit(side).alias("side"))),
            F.when(open_ & (count(sign * off > EPSILON, 8) == 8), F.struct(F.lit("run_of_eight").alias("rule"), F.lit(side).alias("side"))),
        ]
    told = joined.select("measure", "session_id", "place", "value", "own_", F.array(*found).alias("told")).where("own_")
    return told.select("measure", "session_id", "place", "value", F.explode(F.array_compact("told")).alias("signal_")).select("measure", "session_id", "place", "value", F.col("signal_.rule").alias("rule"), F.col("signal_.side").alias("side"))
