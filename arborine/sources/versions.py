"""A table that is written anew as a whole: one folder per version below a shared folder.

A version counts once Spark has marked it as complete, so a job that dies while it writes leaves the version before in
force, and a restarted session finds the newest one in the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEPT = 2


class Versions:
    """The versions below ``folder``; ``schema`` is that of the table, which is empty before its first version."""

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        found = self._fs.globStatus(self._path(f"{self.folder}/v-*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)

    def latest(self) -> int | None:
        return max(self.numbers(), default=None)

    def read(self, number: int | None = None) -> DataFrame:
        """The newest version, or that of ``number``; an empty table where there is none."""
        number = self.latest() if number is None else number
        if number is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._at(number))

    def write(self, table: DataFrame, number: int | None = None, keep: int | None = KEPT) -> int:
        """Write ``table`` as the next version, or as ``number``, and remove all but the ``keep`` newest."""
        known = self.numbers()
        number = (known[-1] + 1 if known else 0) if number is None else number
        table.write.mode("overwrite").parquet(self._at(number))
        if keep:
            self.remove(sorted({*known, number})[:-keep])
        return number

    def remove(self, numbers: list[int]) -> None:
        for n in numbers:
            self._fs.delete(self._path(self._at(n)), True)

    def _at(self, number: int) -> str:
        return f"{self.folder}/v-{number:09d}"
