"""References to records that are missing, removed or written later than the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborine.operators.skew import join_skewed
from arborine.sources.scratch import Scratch


def orphan_references(edges: DataFrame, symbols: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Rows of ``edges`` whose record ``dst_id`` has no valid row of ``symbols``.

    Returns (edge_id, kind, indexed_at, reason), one row per offending row of ``edges``, repeats
    included. Reasons, first that holds: ``missing`` (no symbol row of that id has a path),
    ``deleted`` (the event with the largest ``seq`` of its path removed it), ``late`` (the
    earliest indexing of such a row is after the edge's). ``dst_id`` without ``/`` or null is no
    record id and gives no row; null ``seq`` never counts as last; a null time is never late;
    empty tables are tables without such rows. Other columns are ignored.

    Parents and children are tagged and put into one long table that is grouped by key, with
    partial aggregation before the shuffle, so a key that holds a third of the rows costs one
    row per map task. Only keys that lack a valid parent, or whose parent is later than their
    first child, meet the edges again.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "orphans")
    child = edges.where(F.col("dst_id").contains("/"))
    last = (
        file_changes.where(F.col("path").isNotNull() & F.col("seq").isNotNull())
        .groupBy("path").agg(F.max_by("removed", "seq").alias("gone"))
        .where("gone").select("path", F.lit(True).alias("gone"))
    )
    parents = (
        symbols.where(F.col("id").isNotNull() & F.col("path").isNotNull())
        .groupBy("id").agg(F.min("path").alias("path"), F.min("indexed_at").alias("born"))
        .join(last, "path", "left")
        .select(F.col("id").alias("key"), F.lit(1).alias("parent"), F.coalesce("gone", F.lit(False)).alias("gone"), "born", F.lit(0).cast("long").alias("rows"), F.lit(None).cast(edges.schema["indexed_at"].dataType).alias("first_child"))
    )
    children = child.groupBy(F.col("dst_id").alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.min("indexed_at").alias("first_child"))
    tagged = children.select(
        "key", F.lit(0).alias("parent"), F.lit(False).alias("gone"), F.lit(None).cast(symbols.schema["indexed_at"].dataType).alias("born"), "rows", "first_child"
    ).unionByName(parents)
    bad = (
        tagged.groupBy("key")
        .agg(F.max("parent").alias("parent"), F.max("gone").alias("gone"), F.max("born").alias("born"), F.sum("rows").alias("rows"), F.min("first_child").alias("first_child"))
        .where((F.col("rows") > 0) & ((F.col("parent") == 0) | F.col("gone") | (F.col("born") > F.col("first_child"))))
        .select(
            F.col("key").alias("dst_id"), "born",
            F.when(F.col("parent") == 0, "missing").when(F.col("gone"), "deleted").otherwise("late").alias("reason"),
        )
    )
    bad = scratch.save(bad, "bad")
    rows = child.select("edge_id", "kind", "indexed_at", "dst_id")
    return (
        join_skewed(rows, bad, "dst_id", rows.count(), "inner")
        .where((F.col("reason") != "late") | (F.col("born") > F.col("indexed_at")))
        .select("edge_id", "kind", "indexed_at", "reason")
    )


def orphan_report(edges: DataFrame, orphans: DataFrame) -> DataFrame:
    """Orphans per kind, month and reason: (kind, period, reason, orphans, refs).

    ``refs`` counts the record references of that kind and month; null kinds and times form
    groups of their own.
    """
    period = F.date_format("indexed_at", "yyyy-MM").alias("period")
    refs = edges.where(F.col("dst_id").contains("/")).groupBy("kind", period).agg(F.count(F.lit(1)).alias("refs"))
    found = orphans.groupBy("kind", period, "reason").agg(F.count(F.lit(1)).alias("orphans"))
    same = found["kind"].eqNullSafe(refs["kind"]) & found["period"].eqNullSafe(refs["period"])
    return found.join(refs, same).select(found["kind"], found["period"], "reason", "orphans", "refs")
