"""Bounded reverse traversal: what a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.functions.text import is_test_file, is_test_symbol
from arborine.operators.skew import heavy_values, meet_spread, spread
from arborine.sources.scratch import Scratch


def reverse_reach(steps: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, id, depth): ids that reach each seed along ``steps`` (src, dst) within ``max_depth`` steps, with their least depth.

    One join per level for all seeds; seeds are not among their own results. The steps and each level are written, so the plan stays
    as short as a level and a lost executor costs one level. The steps into an id that holds many of them are met in many tasks. Null
    seeds and ends reach nothing; repeated ones count once; empty tables give no rows.
    """
    scratch = Scratch(steps.sparkSession, "reach")
    held = scratch.save(steps.where("src is not null and dst is not null").select("src", "dst").distinct(), "steps")
    heavy = heavy_values(held, "dst", held.count())
    held = spread(held, "dst", "src", heavy)
    frontier = seeds.where(F.col("id").isNotNull()).select(F.col("id").alias("seed"), F.col("id").alias("at")).distinct()
    known = scratch.save(frontier.withColumn("depth", F.lit(0).cast("long")), "seen")
    frontier = known.select("seed", "at")
    for k in range(1, max_depth + 1):
        met = meet_spread(frontier.withColumnRenamed("at", "dst"), held, "dst", heavy).select("seed", F.col("src").alias("at")).distinct()
        new = scratch.save(met.join(known.select("seed", "at"), ["seed", "at"], "left_anti").withColumn("depth", F.lit(k).cast("long")), f"level{k}")
        if new.isEmpty():
            break
        known = known.unionByName(new)
        frontier = new.select("seed", "at")
    return known.where("depth > 0").select("seed", F.col("at").alias("id"), "depth")


def blast_radius(edges: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """(seed, id, depth, is_test): files that import each changed file (id) over up to ``max_depth`` steps."""
    steps = edges.where("kind = 'imports'").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return reverse_reach(steps, changed, max_depth).withColumn("is_test", is_test_file(F.col("id")))


def impacted_symbols(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, id, qualified_name): the symbols defined in the changed files (path)."""
    return nodes.where("kind <> 'file'").join(changed.select("path").distinct(), "path", "left_semi").select("path", "id", "qualified_name")


def symbol_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 4) -> DataFrame:
    """(seed, id, path, depth, is_test): nodes that call or extend each changed symbol (id), over up to ``max_depth`` steps."""
    real = nodes.where("path <> ''").select("id", "path")
    steps = edges.where("kind in ('calls', 'inherits')").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    steps = steps.join(real.select(F.col("id").alias("src")), "src", "left_semi")
    return reverse_reach(steps, changed, max_depth).join(real, "id").select("seed", "id", "path", "depth", is_test_symbol(F.col("path")).alias("is_test"))


def affected_tests(reach: DataFrame, path: str = "path") -> DataFrame:
    """(seed, path): the distinct test files among what each seed reaches."""
    return reach.where("is_test").select("seed", F.col(path).alias("path")).distinct()


def reach_report(reach: DataFrame, seeds: DataFrame, path: str = "path") -> DataFrame:
    """(seed, impacted, files, tests, max_depth) of every seed (id), also of those that nothing reaches.

    ``files`` are the distinct paths of what is impacted and ``tests`` those of them that are tests.
    """
    files = reach.groupBy("seed", path).agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d"), F.max("is_test").alias("t"))
    sums = files.groupBy("seed").agg(F.sum("n").alias("impacted"), F.count(F.lit(1)).alias("files"), F.count_if("t").alias("tests"), F.max("d").alias("max_depth"))
    every = seeds.where(F.col("id").isNotNull()).select(F.col("id").alias("seed")).distinct()
    return every.join(sums, "seed", "left").select("seed", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("impacted", "files", "tests", "max_depth")))
