"""The current state of symbols and edges out of tables with repeats, late rows and removals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = ("id", "kind", "name", "qualified_name", "path", "language", "signature", "docstring", "start_line", "end_line")


def migrated(symbols: DataFrame) -> DataFrame:
    """``symbols`` with the columns of ``SYMBOL`` that an older table lacks: absent strings become '' and absent lines null."""
    missing = {c: F.lit(None).cast("long") if c.endswith("_line") else F.lit("") for c in SYMBOL if c not in symbols.columns}
    return symbols.withColumns(missing)


def upsert_nodes(symbols: DataFrame, order: str = "indexed_at", first: bool = False) -> DataFrame:
    """One row per id with a path: the last written by ``order`` (equal times: the greatest row), or the first. Null ids make no node.

    Absent strings become ''.
    """
    rest = [c for c in SYMBOL if c != "id"]
    rows = symbols.where(F.col("id").isNotNull() & F.col("path").isNotNull())
    last = rows.groupBy("id").agg((F.min if first else F.max)(F.struct(order, *rest)).alias("s"))
    return last.select("id", *(F.col(f"s.{c}") if c.endswith("_line") else F.coalesce(F.col(f"s.{c}"), F.lit("")).alias(c) for c in rest))


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The set of (src_id, dst_id, kind) whose source is a node; null ends make no edge."""
    distinct = edges.where(F.col("dst_id").isNotNull()).select("src_id", "dst_id", "kind").distinct()
    return distinct.join(nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi").select("src_id", "dst_id", "kind")


def placeholder_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids that edges point to and no node has."""
    return edges.where(F.col("dst_id").isNotNull()).select(F.col("dst_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")


def collapse_events(changes: DataFrame) -> DataFrame:
    """The last event per path by ``seq``: (path, removed, seq). Events without path or ``seq`` are left out; at equal ``seq`` removal wins."""
    rows = changes.where(F.col("path").isNotNull() & F.col("seq").isNotNull())
    last = rows.groupBy("path").agg(F.max(F.struct("seq", F.coalesce("removed", F.lit(False)).alias("removed"))).alias("e"))
    return last.select("path", F.col("e.removed").alias("removed"), F.col("e.seq").alias("seq"))


def delete_files(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the files of ``removed`` (path): edges go with either of their ends."""
    gone = nodes.join(removed.select("path").distinct(), "path", "left_semi").select("id")
    kept = nodes.join(removed.select("path").distinct(), "path", "left_anti")
    left = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return kept, left.select("src_id", "dst_id", "kind")


def update_actions(hashes: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """What an update does with each file: (path, action).

    ``events`` are collapsed events, ``hashes`` (path, content_hash) the state before and ``runs`` (path, content_hash, error) the
    newest parse. Actions: ``delete``, ``keep`` (the parse failed or is missing), ``skip`` (same hash), ``replace``.
    """
    now = events.join(runs, "path", "left").join(hashes.withColumnRenamed("content_hash", "before"), "path", "left")
    action = F.when(F.col("removed"), "delete").when(F.col("error").isNotNull() & (F.col("error") != "") | F.col("content_hash").isNull(), "keep").when(F.col("content_hash") == F.col("before"), "skip").otherwise("replace")
    return now.select("path", action.alias("action"))


def apply_update(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after an update: files to delete or replace go with their edges in both directions, the new rows of files to replace come in.

    Rows of other files, in ``new_nodes`` too, stay out of it. Edges are still to be resolved, as a replaced file
    takes the resolved edges of other files with it.
    """
    gone = actions.where(F.col("action").isin("delete", "replace")).select("path")
    kept, left = delete_files(nodes, edges, gone)
    added = new_nodes.join(actions.where("action = 'replace'").select("path"), "path", "left_semi").select(*nodes.columns)
    written = new_edges.where(F.col("dst_id").isNotNull()).select("src_id", "dst_id", "kind").distinct().join(added.select(F.col("id").alias("src_id")), "src_id", "left_semi")
    return kept.unionByName(added), left.unionByName(written.select("src_id", "dst_id", "kind")).distinct()


def updated_hashes(hashes: DataFrame, runs: DataFrame, actions: DataFrame) -> DataFrame:
    """(path, content_hash) after an update: deleted files have none, replaced ones that of their run."""
    kept = hashes.join(actions.where(F.col("action").isin("delete", "replace")).select("path"), "path", "left_anti").select("path", "content_hash")
    return kept.unionByName(runs.join(actions.where("action = 'replace'").select("path"), "path", "left_semi").select("path", "content_hash"))
