"""The vector table: rows of (id, path, text, vector), kept per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborine.operators.retrieve import knn
from arborine.sources.versions import Versions


def upsert_vectors(known: DataFrame, rows: DataFrame) -> DataFrame:
    """``known`` with all rows of each path in ``rows`` replaced by those of ``rows``; repeated rows of an id become the greatest by text.

    Rows with a null id or path are left out.
    """
    new = rows.where(F.col("id").isNotNull() & F.col("path").isNotNull())
    new = new.groupBy("id").agg(F.max(F.struct("path", "text", "vector")).alias("r")).select("id", "r.path", "r.text", "r.vector")
    return known.join(new.select("path").distinct(), "path", "left_anti").select("id", "path", "text", "vector").unionByName(new)


def delete_vectors(known: DataFrame, paths: DataFrame) -> DataFrame:
    """``known`` without the rows of ``paths`` (path); paths are compared as values, so quotes in them do no harm."""
    return known.join(paths.select("path").distinct(), "path", "left_anti").select("id", "path", "text", "vector")


class VectorTable:
    """A vector table in a shared folder; a table that was never written has no rows and answers searches with none."""

    def __init__(self, spark: SparkSession, folder: str, dim: int) -> None:
        self.dim, self.versions = dim, Versions(spark, folder, "id string, path string, text string, vector array<double>")

    def read(self) -> DataFrame:
        return self.versions.read()

    def upsert(self, rows: DataFrame) -> None:
        """Replace the rows of each path; a vector that has not ``dim`` numbers raises."""
        checked = rows.withColumn("vector", F.when(F.col("vector").isNull() | (F.size("vector") == self.dim), F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.lit(f"a vector has not {self.dim} numbers"))))
        self.versions.write(upsert_vectors(self.read(), checked.select("id", "path", "text", "vector")))

    def delete(self, paths: DataFrame) -> None:
        self.versions.write(delete_vectors(self.read(), paths))

    def search(self, queries: DataFrame, k: int = 20, where: str | None = None) -> DataFrame:
        """The nearest rows of each query (id, vector) among those that satisfy ``where``, filtered before the search."""
        return knn(self.read(), queries, k, where)
