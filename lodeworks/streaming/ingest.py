"""Ingestion as a stream of files or rows: bounded runs, idempotent merges, event-time counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drained(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, merge: Callable[[DataFrame, int], None], *, listen: bool = False):
    """Runs ``merge`` on each batch of new Parquet files under ``path`` (a folder, or one file): until all are taken, or every minute.

    The checkpoint remembers what was taken. A batch may come twice after a crash,
    under the same number; a merge that writes by that number is then idempotent.
    """
    reader, (folder, _, name) = spark.readStream.schema(schema), path.rstrip("/").rpartition("/")
    files = spark.read.schema(schema).parquet(path).inputFiles()
    alone = len(files) == 1 and files[0].endswith(f"/{name}")
    stream = reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime="60 seconds") if listen else writer.trigger(availableNow=True)
    return writer.start()


def by_batch(target: str) -> Callable[[DataFrame, int], None]:
    """A merge that keeps every batch under its own number, so that writing it again changes nothing."""

    def merge(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return merge


def counted(events: DataFrame, *, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and type, with rows later than ``late`` left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
