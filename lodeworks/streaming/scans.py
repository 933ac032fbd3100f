"""Which files are there, as a stream of observations.

A scan observes files one by one; a file that is not observed again within a grace is taken to be
gone. Each file's state is the moment of its last observation and its document. A timer in
event time stands at that moment plus the grace: when the watermark passes it, the
file is given as gone, and a later observation gives it back. An observation older than the
last one changes nothing, so batches may come in any order within the watermark's delay, and
a run that was stopped goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "root_id string, relative_path string, doc_id string, at long, available boolean"
CHANGE = "root_id string, relative_path string, doc_id string, seen_at timestamp, available boolean"
#: Keeps each key's state on the executors' disks, not in their heaps (a setting of the session).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Availability(StatefulProcessor):
    """Moments are microseconds of the epoch, which mean the same in every task."""

    def __init__(self, grace: timedelta):
        self.grace = int(grace / timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, doc_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        known = tuple(self.last.get()) if self.last.exists() else None
        new = max(((r["_at"], r["doc_id"] or "") for r in rows), default=None)
        if new is None or (known is not None and new <= known):
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.last.update(new)
        # A timer has milliseconds; it must not go off before its time.
        self.handle.registerTimer(-(-(new[0] + self.grace) // 1000))
        yield Row(root_id=key[0], relative_path=key[1], doc_id=new[1], at=new[0], available=True)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        at, doc_id = self.last.get()
        yield Row(root_id=key[0], relative_path=key[1], doc_id=doc_id, at=at, available=False)

    def close(self) -> None:
        pass


def changes(observations: DataFrame, *, grace: timedelta, late: str = "0 seconds") -> DataFrame:
    """(root_id, relative_path, doc_id, seen_at, available) whenever a file is observed anew or taken to be gone.

    ``observations``: a stream of root_id, relative_path, doc_id, seen_at, in any order
    within ``late``. Rows without a root, a path or a moment observe nothing.
    """
    spark = observations.sparkSession
    if spark.conf.get(STATE_STORE[0]) != STATE_STORE[1]:
        spark.conf.set(*STATE_STORE)
    t = observations.filter("root_id IS NOT NULL AND relative_path IS NOT NULL AND seen_at IS NOT NULL").withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", late).withColumn("_at", F.unix_micros("seen_at"))
    out = t.groupBy("root_id", "relative_path").transformWithState(Availability(grace), STATE, "Update", "EventTime")
    return out.select("root_id", "relative_path", "doc_id", F.timestamp_micros("at").alias("seen_at"), "available")


def settled(told: DataFrame) -> DataFrame:
    """The last change of each file: by moment, and gone after there."""
    nth = F.row_number().over(W.partitionBy("root_id", "relative_path").orderBy(F.col("seen_at").desc(), F.col("available").asc(), F.col("doc_id").desc()))
    return told.withColumn("_n", nth).filter("_n = 1").drop("_n")
