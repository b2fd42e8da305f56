"""Continuous ingestion: the batch operators over micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..operators import dedup


def once(files: DataFrame, memory: str = "1 hour") -> DataFrame:
    """Each path and time once within ``memory`` of processing time: the state of a stream of files, with its expiry."""
    seen = files.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", memory)
    return seen.dropDuplicatesWithinWatermark(["path", "mtime"]).drop("_seen")


def catalog_new_files(files: DataFrame, catalog: Catalog, to_records: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Record the files of each micro-batch that the catalog lacks.

    A batch that is repeated after a failure changes nothing: its files are known by
    then, and an upsert of equal rows is idempotent.
    """

    def step(batch: DataFrame, _: int) -> None:
        fresh = to_records(dedup.new_files(batch, catalog.read("file_paths")))
        catalog.put("file_records", fresh, "id")
        catalog.put("file_paths", fresh)

    writer = files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
