"""Operators for keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborine.sources.scratch import Scratch

#: A key with more than this share of the rows is heavy, so at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.005
#: Below this many rows heavy keys are not looked for, as such a join fits one task: the rows are the same, only the plan differs.
HEAVY_ROWS = 200_000
#: The session setting that overrides ``HEAVY_ROWS``.
HEAVY_ROWS_SETTING = "spark.arborine.heavyRows"
SALTS = 64


def heavy_values(rows: DataFrame, key: str, n_rows: int, share: float = HEAVY_SHARE) -> list:
    """Values of ``key`` with more than ``share`` of ``n_rows``: fewer than 1 / share, whatever the input.

    None are looked for below ``HEAVY_ROWS`` rows, or the number that the session sets.
    """
    if n_rows < int(rows.sparkSession.conf.get(HEAVY_ROWS_SETTING, str(HEAVY_ROWS))):
        return []
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") > n_rows * share).select(key).collect()]


def join_skewed(rows: DataFrame, dim: DataFrame, key: str, n_rows: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``dim`` (unique on ``key``) though few keys may hold most rows.

    Rows of heavy keys meet their partners through a broadcast of fewer than 1 / HEAVY_SHARE
    rows of ``dim``; all others go through an ordinary shuffled join. Every row keeps its
    place in the result; null keys find no partner.
    """
    heavy = heavy_values(rows, key, n_rows)
    if not heavy:
        return rows.join(dim, key, how)
    hot = F.col(key).isin(heavy)
    return (
        rows.where(hot)
        .join(F.broadcast(dim.where(hot)), key, how)
        .unionByName(rows.where(~hot | F.col(key).isNull()).join(dim, key, how))
    )


def spread(rows: DataFrame, key: str, value: str, heavy: list, salts: int = SALTS) -> DataFrame:
    """``rows`` with ``_salt``: for keys in ``heavy`` a number that follows from ``value``, else 0."""
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", F.when(F.col(key).isin(heavy), salt).otherwise(F.lit(0)) if heavy else F.lit(0))


def meet_spread(rows: DataFrame, many: DataFrame, key: str, heavy: list, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` with ``many``, a result of ``spread``, where both may repeat a key.

    Rows of heavy keys are copied once per salt, so the partners of a heavy key are met in ``salts`` tasks.
    """
    if not heavy:
        return rows.join(many.drop("_salt"), key)
    hot = F.col(key).isin(heavy)
    salted = rows.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(many, [key, "_salt"]).drop("_salt")


def ranked(rows: DataFrame, group: str, order: list[str | Column], scratch: Scratch, cost: str | None = None) -> DataFrame:
    """``rows`` with ``rank``, their 1-based place in their group by ``order``, and ``total``, the running sum of ``cost``.

    A group may hold any share of the rows: they are sorted by range across all tasks, each range is ranked for
    itself, and what a group has in earlier ranges is added from a small table of one row per group and range. ``order``
    must tell rows apart, as equal rows stay in one range. Null groups form one group.
    """
    keys = [group, *order]
    placed = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism * 4, *keys).withColumn("_range", F.spark_partition_id())
    placed = scratch.save(placed, "ranges")
    within = Window.partitionBy(group, "_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    size = [F.count(F.lit(1)).alias("_n"), F.sum(cost if cost else F.lit(0)).alias("_c")]
    before = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(*size)
    parts = parts.select("_group", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"))
    local = placed.withColumn("rank", F.row_number().over(within).cast("long")).withColumn("total", F.sum(cost if cost else F.lit(0)).over(upto))
    met = local.join(parts, local[group].eqNullSafe(parts["_group"]) & (local["_range"] == parts["_at"]))
    out = met.withColumn("rank", F.col("rank") + F.col("_n")).withColumn("total", (F.col("total") + F.col("_c")).cast("long"))
    return out.drop("_group", "_at", "_n", "_c", "_range", *([] if cost else ["total"]))


def salted_distinct(rows: DataFrame, key: str, value: str, heavy: DataFrame | None, salts: int = SALTS) -> DataFrame:
    """Distinct ``value`` per ``key`` in two stages, as (key, n).

    Rows of heavy keys get a salt out of ``salts``; it follows from the value, so equal values
    meet under one salt and the partial counts of the salts add up exactly. Stage one drops
    repeated (key, salt, value) and counts per (key, salt), stage two sums the partials by the
    original key. The values are compared by 128 bits of hash, which keeps long ids out of
    the shuffle. Null keys and null values count nowhere.
    """
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")
    rows = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    if heavy is None:
        rows = rows.withColumn("_salt", F.lit(0))
    else:
        marked = F.broadcast(heavy.select(key, F.lit(True).alias("_heavy")))
        rows = rows.join(marked, key, "left").withColumn("_salt", F.when(F.col("_heavy"), salt).otherwise(F.lit(0)))
    return (
        rows.select(key, "_salt", F.xxhash64(value).alias("_a"), F.xxhash64(F.lit(7), value).alias("_b"))
        .groupBy(key, "_salt", "_a", "_b").agg(F.lit(1).alias("_one"))
        .groupBy(key, "_salt").agg(F.count("_one").alias("_n"))
        .groupBy(key).agg(F.sum("_n").alias("n"))
    )


def heavy_keys(rows: DataFrame, key: str, share: float, n_rows: int) -> DataFrame:
    """(key, rows) of the non-null keys with at least ``share`` of ``n_rows``: at most 1 / share rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") >= F.lit(n_rows) * F.lit(share))


def dependents(edges: DataFrame, share: float | None = None, salts: int = SALTS) -> DataFrame:
    """Distinct sources of every ``dst_id``, as (dst_id, dependents), without a straggling task.

    ``share``: only keys with at least this share of all rows (null keys count as rows).
    An empty table gives no rows; null ``dst_id`` is no key; null ``src_id`` is no dependent,
    so a key with null sources only has 0 dependents. Columns besides the two are ignored.
    """
    pairs = edges.select("dst_id", "src_id")
    n_rows = pairs.count()
    heavy = edges.sparkSession.createDataFrame(
        heavy_keys(pairs, "dst_id", HEAVY_SHARE if share is None else share, n_rows).collect(), "dst_id string, rows long"
    )
    keys = pairs.where(F.col("dst_id").isNotNull())
    if share is not None:
        kept = F.broadcast(heavy.select("dst_id"))
        counts = salted_distinct(keys.join(kept, "dst_id", "left_semi"), "dst_id", "src_id", heavy, salts)
        keys = heavy.select("dst_id")
        return keys.join(counts, "dst_id", "left").select("dst_id", _zero("n").alias("dependents"))
    counts = salted_distinct(keys, "dst_id", "src_id", heavy, salts)
    only_null = keys.groupBy("dst_id").agg(F.count("src_id").alias("_any")).where("_any = 0").select("dst_id", F.lit(0).cast("long").alias("dependents"))
    return counts.select("dst_id", F.col("n").alias("dependents")).unionByName(only_null)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def refreshed_hubs(edges: DataFrame, hubs: DataFrame, symbols: DataFrame) -> DataFrame:
    """What ``hub_files.dependents`` should hold beside what it holds.

    One row per known or stale path of ``hubs`` (repeats become one, null paths none), as
    (path, dependents, recorded, is_file): the distinct sources of edges to the path, the largest
    recorded count (-1 if none) and whether a file row of symbols has that id.
    """
    fresh = dependents(edges)
    known = symbols.where(F.col("kind") == "file").select(F.col("id").alias("path")).distinct().withColumn("_file", F.lit(True))
    stale = hubs.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("dependents").alias("recorded"))
    return (
        stale.join(fresh.withColumnRenamed("dst_id", "path"), "path", "left")
        .join(known, "path", "left")
        .select("path", _zero("dependents").alias("dependents"), F.coalesce("recorded", F.lit(-1)).alias("recorded"), F.coalesce("_file", F.lit(False)).alias("is_file"))
    )
