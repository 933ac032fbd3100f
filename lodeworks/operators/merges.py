"""Tables that are changed in place of one folder at a time, and mail metadata kept in them.

A bucketed table lies in folders by a hash of its key. A merge reads and rewrites the
buckets that hold changed keys and leaves the files of all others where they are. Which
folder is a bucket's current one stands in a manifest, a small table of its own, that is
written last: until it is there, readers see the table as it was, and a merge that failed is
run again. Folders that no manifest names any more are swept when asked for.

Keys may be null (a null is equal to a null); of rows with one key in a batch the last by ``order``
counts, or any where they tie; an empty batch changes nothing; a table starts empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.operators.tables import exists, folders, remove


@dataclass(frozen=True)
class Bucketed:
    """A table at ``path`` of the columns ``schema``, in ``buckets`` folders by a hash of ``key``."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[1:]) for n in folders(spark, f"{self.path}/manifest") if exists(spark, f"{self.path}/manifest/{n}/_SUCCESS"))

    def current(self, spark: SparkSession, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows, by the last manifest or that of a version."""
        known = self._manifests(spark)
        at = known[-1] if version is None and known else version
        if at is None:
            return {}
        return {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{self.path}/manifest/v{at}").collect()}

    def read(self, spark: SparkSession, *, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        held = [f for b, f in sorted(self.current(spark, version).items()) if buckets is None or b in set(buckets)]
        empty = spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in held]) if held else empty

    def lookup(self, rows: DataFrame) -> DataFrame:
        """The table's rows with the keys of ``rows``; only their buckets are opened."""
        spark = rows.sparkSession
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
        t = self.read(spark, buckets=touched)
        asked = rows.select(*[F.col(c).alias(f"_{c}") for c in self.key]).distinct()
        return t.join(asked, self._same(t, asked), "left_semi")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, c: x & a[c].eqNullSafe(b[f"_{c}"]), self.key, F.lit(True))

    def merge(self, rows: DataFrame, *, keep: Sequence[str] = (), order: Sequence[str] = (), deleted: DataFrame | None = None, replaced: DataFrame | None = None) -> dict[int, str]:
        """Puts ``rows`` in place of those with their keys and drops those of ``deleted`` (key); returns the new folders.

        Columns in ``keep`` stay as they first were. ``replaced``: keys whose rows all go
        before ``rows`` come (``rows`` may then have several of one key).
        """
        spark = rows.sparkSession
        told = [x.select(*self.key) for x in (rows, deleted, replaced) if x is not None]
        touched = sorted(r[0] for r in reduce(DataFrame.unionByName, told).select(self._bucket()).distinct().collect())
        if not touched:
            return {}
        new = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        if replaced is None:
            last = [F.col(c).desc_nulls_last() for c in order] or [F.lit(0)]
            new = new.withColumn("_n", F.row_number().over(W.partitionBy(*self.key).orderBy(*last))).filter("_n = 1").drop("_n")
        old = self.read(spark, buckets=touched)
        out = reduce(lambda t, gone: self._without(t, gone), [x for x in (new if replaced is None else replaced, deleted) if x is not None], old)
        if keep and replaced is None:
            first = old.select(*[F.col(c).alias(f"_{c}") for c in (*self.key, *keep)])
            both = new.join(first, self._same(new, first), "left")
            new = both.select(*[F.coalesce(first[f"_{c}"], new[c]).alias(c) if c in keep else new[c] for c in new.columns])
        run = uuid.uuid4().hex
        both = out.unionByName(new).withColumn("bucket", self._bucket())
        # The rows of a bucket come together, and those of large buckets are dealt to as many tasks as their size asks for.
        both.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{run}")
        made = {int(n.removeprefix("bucket=")): f"{run}/{n}" for n in folders(spark, f"{self.path}/data/{run}")}
        manifest = {b: f for b, f in self.current(spark).items() if b not in touched} | made
        version = (self._manifests(spark) or [0])[-1] + 1
        spark.createDataFrame(list(manifest.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{self.path}/manifest/v{version}")
        return made

    def _without(self, t: DataFrame, gone: DataFrame) -> DataFrame:
        named = gone.select(*[F.col(c).alias(f"_{c}") for c in self.key]).distinct()
        return t.join(named, self._same(t, named), "left_anti")

    def swept(self, spark: SparkSession, versions: int = 1) -> int:
        """Deletes folders that none of the last ``versions`` manifests names, and older manifests; how many folders went."""
        known = self._manifests(spark)
        held = {f for v in known[-versions:] for f in self.current(spark, v).values()}
        gone = [f"{run}/{b}" for run in folders(spark, f"{self.path}/data") for b in folders(spark, f"{self.path}/data/{run}") if f"{run}/{b}" not in held]
        for f in gone:
            remove(spark, f"{self.path}/data/{f}")
        for v in known[:-versions]:
            remove(spark, f"{self.path}/manifest/v{v}")
        return len(gone)


MESSAGES = "doc_id long, message_id string, subject string, sent_at timestamp, automated_class string, list_id string, ingested_at timestamp"
ADDRESSES = "doc_id long, kind string, ordinal int, address string, display_name string, valid boolean"
REFERENCES = "doc_id long, ordinal int, message_id string"


@dataclass(frozen=True)
class MailStore:
    """Messages with their addresses and references, each in a bucketed table by document."""

    messages: Bucketed
    addresses: Bucketed
    references: Bucketed

    @staticmethod
    def at(path: str, buckets: int = 64) -> MailStore:
        made = [Bucketed(f"{path}/{name}", T.StructType.fromDDL(ddl), ("doc_id",), buckets) for name, ddl in (("messages", MESSAGES), ("addresses", ADDRESSES), ("references", REFERENCES))]
        return MailStore(*made)

    def save(self, parsed: DataFrame) -> None:
        """Stores parsed mail: doc_id, the message's columns, ``addresses`` and ``references`` as arrays.

        A message that comes again is changed, but keeps the moment of its first coming,
        which pages go by; its addresses and references are replaced as a whole, by none if it
        has none now. Each of the three tables is whole at any time, and saving again
        after a failure gives the same tables.
        """
        named = parsed.select("doc_id").distinct()
        one = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.xxhash64("message_id", "subject")))
        last = parsed.withColumn("_n", one).filter("_n = 1").drop("_n")
        boxes = last.select("doc_id", F.explode("addresses").alias("a")).select("doc_id", "a.*")
        refs = last.select("doc_id", F.posexplode("references").alias("ordinal", "message_id"))
        self.addresses.merge(boxes, replaced=named)
        self.references.merge(refs, replaced=named)
        self.messages.merge(last, keep=("ingested_at",))
