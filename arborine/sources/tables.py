"""Reading the test tables, which may be one parquet file or a folder of them, and spreading their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; pushdown and pruning are Catalyst's."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def for_all_cores(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, spread by the hash of ``key`` where they lie in fewer files than there are cores.

    For work in Python that costs far more than a shuffle of its input; rows of as many files as cores, or of none, stay where they are.
    """
    cores, files = rows.sparkSession.sparkContext.defaultParallelism, len(rows.inputFiles())
    return rows.repartition(2 * cores, key) if 0 < files < cores else rows
