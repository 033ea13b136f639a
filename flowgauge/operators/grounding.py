"""Operators on repository evidence: change surfaces, edits outside them, broken contracts and evidence use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import file_role


def surface(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """task, path, place: the seeds (task, path), their neighbours by imports in either direction, and the tests that
    belong to either. Of several places the nearest counts."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    test = file_role(F.col("path")) == "test"
    seed = seeds.select("task", "path").distinct()
    near = seed.join(both, seed["path"] == both["src"]).select("task", F.col("dst").alias("path")).where(~test)
    core = seed.withColumn("rank", F.lit(0)).unionByName(near.distinct().withColumn("rank", F.lit(1)))
    tests = core.join(both, core["path"] == both["src"]).select("task", F.col("dst").alias("path")).where(test).distinct().withColumn("rank", F.lit(2))
    found = core.unionByName(tests).groupBy("task", "path").agg(F.min("rank").alias("rank"))
    return found.select("task", "path", F.element_at(F.array(*map(F.lit, ("seed", "neighbour", "test"))), F.col("rank") + 1).alias("place"))


def placed_edits(edits: DataFrame, area: DataFrame, edges: DataFrame) -> DataFrame:
    """edits (task, seq, path) with their place: on the surface, one link beyond it, or unrelated."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    beyond = area.join(both, area["path"] == both["src"]).select("task", F.col("dst").alias("path")).distinct().withColumn("linked", F.lit(True))
    on = area.select("task", "path", "place")
    out = edits.join(on, ["task", "path"], "left").join(beyond, ["task", "path"], "left")
    return out.select("task", "seq", "path", F.when(F.col("place").isNotNull(), F.col("place")).when(F.col("linked"), "expansion").otherwise("unrelated").alias("place"))


def unrelated_modifications(placed: DataFrame) -> DataFrame:
    """Findings for edits without an import link to the surface."""
    return placed.where("place = 'unrelated'").select("task", "seq", "path", F.lit("unrelated_modification").alias("detector"), F.when(file_role(F.col("path")) == "test", 0.55).otherwise(0.60).alias("confidence"))


def surface_expansions(placed: DataFrame) -> DataFrame:
    """Findings for edits one link beyond the surface."""
    return placed.where("place = 'expansion'").select("task", "seq", "path", F.lit("surface_expansion").alias("detector"), F.lit(0.6).alias("confidence"))


def _within(module: Column, package: Column) -> Column:
    return (module == package) | F.startswith(module, F.concat(package, F.lit(".")))


def boundary_violations(imports: DataFrame, contracts: DataFrame) -> DataFrame:
    """New imports (seq, src, dst as modules, removed_later) that a forbidden contract (name, source, target as packages)
    breaks; contracts are a small table, met by prefix. The longest target that fits owns the import."""
    from pyspark.sql import Window

    hit = imports.join(contracts, _within(F.col("src"), F.col("source")) & _within(F.col("dst"), F.col("target")))
    owner = Window.partitionBy("seq", "src", "dst").orderBy(F.desc(F.length("target")), "name")
    return hit.withColumn("r", F.row_number().over(owner)).where("r = 1").select("seq", "src", "dst", "name", F.lit("boundary_violation").alias("detector"), F.when(F.col("removed_later"), 0.55).otherwise(0.90).alias("confidence"))


def evidence_use(reads: DataFrame, later: DataFrame) -> DataFrame:
    """For each read (task, seq, path) the first later event (task, seq, path, use) on its path, and how it was used."""
    u = later.select(F.col("task").alias("u_task"), F.col("path").alias("u_path"), F.col("seq").alias("used_seq"), "use")
    met = reads.join(u, (F.col("task") == F.col("u_task")) & (F.col("path") == F.col("u_path")) & (F.col("used_seq") > F.col("seq")), "left")
    return met.groupBy("task", "seq", "path").agg(F.min("used_seq").alias("first_use"), F.min_by("use", "used_seq").alias("use"))


def exploration_drift(reads: DataFrame, area: DataFrame, alignment: DataFrame, band: float = 0.5) -> DataFrame:
    """Reads (task, seq, path) off the surface where alignment (task, seq, score) is unknown or under the band."""
    off = reads.join(area.select("task", "path"), ["task", "path"], "left_anti").join(alignment, ["task", "seq"], "left")
    top = lambda c: F.split(c, "/")[0]
    home = area.groupBy("task").agg(F.collect_set(top(F.col("path"))).alias("home"))
    low = off.where(F.col("score").isNull() | (F.col("score") < band)).join(home, "task", "left")
    return low.select("task", "seq", "path", F.lit("exploration_drift").alias("detector"), F.when(F.array_contains("home", top(F.col("path"))), 0.60).otherwise(0.75).alias("confidence"))
