"""Messages stored in page order, so that a page reads the files after its boundary and no others.

Files hold consecutive ranges of the order; a small table tells each file's first and last key
and its rows. A page begins in the file of its boundary and goes on, more files
at a time, until it is full, whatever filters leave out on the way. Undated messages have the
last files (of the newest-first order); reading oldest first goes through the files backwards.

Messages that tie in moment and id stand next to each other; an empty table has pages without
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.mailbox import page, page_order, past
from lodeworks.operators.tables import exists, shared_dir, version
from lodeworks.vocabulary import PAGE_DEFAULT

#: Messages of a file; files that are read at once at first, and at most.
ROWS, FIRST, MOST = 100_000, 1, 64


@dataclass(frozen=True)
class PageStore:
    """Messages (doc_id, sent_at and others) in ``{path}/rows`` and their files' ranges in ``{path}/ranges``."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(messages: DataFrame, path: str | None = None, rows: int = ROWS) -> PageStore:
        """Writes the store to ``path``, or under the ``version`` of the messages, where it is found again until a file changes."""
        spark = messages.sparkSession
        at = path or f"{shared_dir(spark)}/lodeworks/pages-{version(messages, rows)}"
        if path is None and exists(spark, f"{at}/ranges/_SUCCESS"):
            return PageStore(spark, at)
        parts = max(1, -(-messages.count() // rows))
        t = messages.repartitionByRange(parts, *page_order()).sortWithinPartitions(*page_order())
        t.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(f"{at}/rows")
        r = spark.read.schema(messages.schema).parquet(f"{at}/rows").select(F.input_file_name().alias("file"), F.struct("sent_at", "doc_id").alias("k"))
        # Undated ones stand below all others, as in the order.
        ends = r.groupBy("file").agg(F.count("*").alias("n"), F.max("k").alias("first"), F.min("k").alias("last"))
        ends.coalesce(1).write.mode("overwrite").parquet(f"{at}/ranges")
        return PageStore(spark, at)

    def files(self, after: tuple[datetime | None, object] | None, newest: bool) -> Iterator[list[str]]:
        """The files that may hold rows after the boundary, in order, in growing groups."""
        end = "last" if newest else "first"
        t = self.spark.read.parquet(f"{self.path}/ranges").select("file", F.col(f"{end}.sent_at").alias("sent_at"), F.col(f"{end}.doc_id").alias("doc_id"))
        t = t if after is None else t.filter(past(*after, newest))
        names, at, many = [r["file"] for r in t.orderBy(*page_order(newest)).collect()], 0, FIRST
        while at < len(names):
            yield names[at : at + many]
            at, many = at + many, min(2 * many, MOST)

    def frame(self, *, after: tuple[datetime | None, object] | None = None, newest: bool = True, limit: int = PAGE_DEFAULT, where: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
        """The next ``limit`` rows and one more, as ``mailbox.page`` gives them, of the messages that ``where`` leaves; from as few files as hold them."""
        schema, read = self.spark.read.parquet(f"{self.path}/rows").schema, []
        out = page(where(self.spark.createDataFrame([], schema)), newest=newest, after=after, limit=limit)
        for names in self.files(after, newest):
            read += names
            out = page(where(self.spark.read.schema(schema).parquet(*read)), newest=newest, after=after, limit=limit)
            if out.count() > limit:
                break
        return out

    def page(self, **how: object) -> list[Row]:
        return self.frame(**how).collect()
