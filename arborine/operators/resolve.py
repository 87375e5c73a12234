"""Resolution of imports, supertypes and calls to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.functions.text import clean_import, dotted_suffixes
from arborine.operators.lookup import file_imports
from arborine.sources.scratch import Scratch


def resolve_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_id, dst_id): import targets that name exactly one file.

    A target is a file's qualified name (the greatest id of several) or else the end of one file's only; targets that are
    files already and a file itself are left out.
    """
    files = nodes.where("kind = 'file'").select("id", "qualified_name")
    ends = files.select("id", F.col("qualified_name").alias("whole"), F.explode(dotted_suffixes(F.col("qualified_name"))).alias("target"))
    index = (
        ends.groupBy("target")
        .agg(F.max(F.when(F.col("whole") == F.col("target"), F.col("id"))).alias("exact"), F.min("id").alias("low"), F.max("id").alias("high"))
        .select("target", F.coalesce("exact", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("dst_id"))
        .where("dst_id is not null")
    )
    wanted = edges.where("kind = 'imports'").select("src_id", F.col("dst_id").alias("raw")).distinct().join(files.select(F.col("id").alias("raw")), "raw", "left_anti")
    return wanted.select("src_id", clean_import(F.col("raw")).alias("target")).join(index, "target").where("src_id <> dst_id").select("src_id", "dst_id").distinct()


def resolve_names(nodes: DataFrame, edges: DataFrame, kind: str, candidate_kinds: tuple[str, ...], imports: DataFrame, exclude_self: bool) -> DataFrame:
    """(src_id, name, dst_id): bare names that edges of ``kind`` point to, each resolved at its best tier or not at all.

    Tiers: the same file, a file that the source's file imports, anywhere. Where the best tier has more than
    one candidate the name stays unresolved. A name's candidates at the last tier are settled once per
    name, and those that a file's imports offer once per file and name, so no use of a popular name meets all its candidates.
    """
    wanted = edges.where((F.col("kind") == kind) & ~F.col("dst_id").contains("/")).select("src_id", F.col("dst_id").alias("name")).distinct()
    sources = nodes.where("path <> ''").select(F.col("id").alias("src_id"), F.col("path").alias("src_path"))
    asked = wanted.join(sources, "src_id")
    found = nodes.where(F.col("kind").isin(*candidate_kinds) & (F.col("path") != "")).select("id", "name", "path")
    other = F.col("id") != F.col("src_id") if exclude_self else F.lit(True)
    same = asked.join(found, (asked["name"] == found["name"]) & (asked["src_path"] == found["path"])).where(other).select("src_id", asked["name"], "id")
    same = same.groupBy("src_id", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"), F.lit(0).alias("tier"))
    known = imports.where("importer <> imported").distinct().join(found, F.col("imported") == F.col("path"))
    known = known.groupBy(F.col("importer").alias("src_path"), "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    near = asked.join(known, ["src_path", "name"]).select("src_id", "name", "n", "id", F.lit(1).alias("tier"))
    close = same.unionByName(near).groupBy("src_id", "name").agg(F.min_by(F.struct("n", "id"), "tier").alias("best"))
    settled = close.where("best.n = 1").select("src_id", "name", F.col("best.id").alias("dst_id"))
    anywhere = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n <= 2")
    far = asked.join(close.select("src_id", "name"), ["src_id", "name"], "left_anti").join(anywhere, "name")
    if exclude_self:
        pick = F.when(F.col("n") == 1, F.when(F.col("low") != F.col("src_id"), F.col("low"))).when(F.col("low") == F.col("src_id"), F.col("high")).when(F.col("high") == F.col("src_id"), F.col("low"))
    else:
        pick = F.when(F.col("n") == 1, F.col("low"))
    return settled.unionByName(far.select("src_id", "name", pick.alias("dst_id")).where("dst_id is not null"))


def resolve_calls(nodes: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls of bare names, to functions, methods and classes; a call may resolve to its own function."""
    return resolve_names(nodes, edges, "calls", ("function", "method", "class"), imports, False)


def resolve_inheritance(nodes: DataFrame, edges: DataFrame, imports: DataFrame) -> DataFrame:
    """Bases by bare name, to other classes."""
    return resolve_names(nodes, edges, "inherits", ("class",), imports, True)


def resolved(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` with the links of all three resolvers: imports first, as the others look at the imports between files."""
    links = resolve_imports(nodes, edges).withColumn("kind", F.lit("imports"))
    known = scratch.save(edges.unionByName(links).distinct(), "known")
    imports = scratch.save(file_imports(nodes, known), "imports")
    bases = resolve_inheritance(nodes, known, imports).select("src_id", "dst_id", F.lit("inherits").alias("kind"))
    calls = resolve_calls(nodes, known, imports).select("src_id", "dst_id", F.lit("calls").alias("kind"))
    return known.unionByName(bases).unionByName(calls).distinct()
