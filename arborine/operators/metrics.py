"""Aggregates over parse runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborine.operators.skew import ranked
from arborine.sources.scratch import Scratch


def index_stats(runs: DataFrame) -> DataFrame:
    """(files, nodes, edges, errors) of the newest run of each path; equal times count the greatest row."""
    last = runs.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("parsed_at", "content_hash", "n_nodes", "n_edges", "error")).alias("r")).select("r.*")
    return last.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("edges"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors")
    )


def percentiles(rows: DataFrame, group: str, value: str, digits: int = 6) -> DataFrame:
    """(group, p50, p95) with linear interpolation, rounded to ``digits``, 0 where a group has no value.

    Exact for groups of any size: values are ranked across tasks and only those beside the two places are kept.
    """
    scratch = Scratch(rows.sparkSession, "percentiles")
    values = rows.select(group, F.col(value).cast("double").alias("_v"))
    sizes = values.groupBy(group).agg(F.count("_v").alias("_n"))
    ties = values.where("_v is not null").groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_k"))
    upto = ranked(ties, group, ["_v"], scratch, "_k").select(F.col(group).alias("_g"), "_v", (F.col("total") - F.col("_k")).alias("_from"), F.col("total").alias("_to"))
    met = sizes.join(upto, sizes[group].eqNullSafe(upto["_g"]), "left")

    def at(p: float) -> Column:
        place = (F.col("_n") - 1) * p
        low, high = F.floor(place), F.ceil(place)
        inside = lambda k: F.max(F.when((F.col("_from") <= k) & (k < F.col("_to")), F.col("_v")))
        return inside(low) + (inside(high) - inside(low)) * F.max(place - low)

    return met.groupBy(group).agg(*(F.round(F.coalesce(at(p), F.lit(0.0)), digits).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))))


def token_reduction(rows: DataFrame) -> DataFrame:
    """(median, mean) of baseline / returned to one decimal, over the rows where both are above 0; 0 where there are none.

    The ratios are ranked across tasks, so no task holds them all.
    """
    ratio = rows.where("baseline > 0 and returned > 0").select(F.lit(0).alias("_all"), (F.col("baseline") / F.col("returned")).alias("r"))
    middle = percentiles(ratio, "_all", "r", 1).select(F.col("p50").alias("median"))
    mean = ratio.agg(F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 1).alias("mean"))
    return mean.join(middle, F.lit(True), "left").select(F.coalesce("median", F.lit(0.0)).alias("median"), "mean")


def stride_sample(rows: DataFrame, group: str, order: str, count: int) -> DataFrame:
    """Every group's rows at even strides in ``order``: ``count`` of them, or all where there are no more or ``count`` is not above 0."""
    scratch = Scratch(rows.sparkSession, "sample")
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows, group, [order], scratch)
    at = placed.join(sizes, placed[group].eqNullSafe(sizes["_g"])).drop("_g").withColumn("i", F.col("rank") - 1).drop("rank")
    if count <= 0:
        return at
    # row i is taken if it is floor(k * n / count) for some k
    k = F.ceil(F.col("i") * count / F.col("n"))
    return at.where((F.col("n") <= count) | ((F.floor(k * F.col("n") / count) == F.col("i")) & (k < count)))
