"""Incremental upkeep of a snapshot from a stream of file changes.

A micro-batch takes the place of a debounced queue: its events are collapsed to the last per path by
``seq``. Files of a stream arrive in no fixed order, so batches are merged by ``seq`` too: an
older event never undoes a newer one, and a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborine.functions.text import discoverable, normal_path
from arborine.operators.snapshot import collapse_events
from arborine.sources.versions import Versions

STATE = "path string, removed boolean, seq long"
EVENTS = "path string, removed boolean, seq long, changed_at timestamp_ntz"


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    """The events in files below ``folder`` as a stream of normalised paths that discovery would take."""
    raw = spark.readStream.format(fmt).schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.withColumn("path", normal_path(F.col("path"))).where(discoverable(F.col("path")))


class ChangeState:
    """The last event per path, as a base table and one small table per batch since, all in the given folder.

    A batch writes its own events only; after ``every`` batches they are folded into a new base. As the last event is that of the
    greatest ``seq``, the order of batches does not matter and a batch that is replayed changes nothing. A restarted session finds
    base and batches in the folder.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 16) -> None:
        self.spark, self.every = spark, every
        self.base, self.log = Versions(spark, f"{folder}/base", STATE), Versions(spark, f"{folder}/log", STATE)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write(collapse_events(batch), batch_id, keep=None)
        known = self.log.numbers()
        if len(known) >= self.every:
            self.base.write(self.table())
            self.log.remove(known)

    def table(self) -> DataFrame:
        out = self.base.read()
        for n in self.log.numbers():
            out = out.unionByName(self.log.read(n))
        return collapse_events(out)


def run_available(stream: DataFrame, state: ChangeState, checkpoint: str) -> DataFrame:
    """Process all that has arrived and return the state."""
    query = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state.table()
