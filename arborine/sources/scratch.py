"""Tables written between the steps of an iterative job.

A step that a later loop reads again is written as parquet below the folder that the
session names in ``spark.checkpoint.dir``. That cuts the lineage, survives the loss of
an executor and, unlike a checkpointed RDD, keeps column pruning and statistics. Only
a local session without the setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Temporary folders of local sessions without the setting, by application.
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="arborine-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


class Scratch:
    """One job's folder of intermediate tables."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/arborine/{job}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a frame that reads what was written."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
