"""A stored term index for BM25 that is read only where it may matter.

Postings lie in folders by a hash of the term, so that a search opens the files of the
asked terms and no others. Passages are dealt to slots, each with passages of about
one length; a row is a block, the postings of one term in one slot, with the greatest
count and the least length among them. From these follows the most that the block can
add to a score, whatever the collection's totals are by then. The sum over a
question's terms bounds every passage of a slot: the slots of the greatest bounds are
scored first, and of the others only those whose bound reaches the k-th best score found.

Rows that repeat a key stand for passages of their own that share the slot; null keys and
texts without terms are not indexed (but counted in the totals); an empty table gives an
empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.text import terms
from lodeworks.operators.tables import discard, exists, shared_dir, stored, version
from lodeworks.vocabulary import BM25_B, BM25_K1

#: Passages of a slot; postings of a folder; the most folders.
SLOT, FOLDER, FOLDERS = 128, 500_000, 4096
#: What is asked goes into the plan up to so many rows, by name up to so many terms, and is broadcast up to so many rows (some 60 bytes each).
ASKED, NAMED, BROADCAST = 20_000, 200, 500_000
#: Up to so many postings of asked terms, all are scored without looking for a bound first.
UNBOUNDED = 50_000_000
#: Passages whose terms a worker counts at once.
COUNTED = 1024
#: Slots of a question that are scored for the first bound.
FIRST = 4


def bm25_part(idf: Column, tf: Column, dl: Column, mean: float | Column) -> Column:
    """What one term adds to a score; grows with ``tf`` and falls with ``dl``."""
    tf = tf.cast("double")
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / mean))


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def _length_class(length: Column) -> Column:
    return F.floor(F.log2(length + F.lit(1)) * 2).cast("int")


def slot_of(shape: Column, sizes: dict[int, int], slot: int) -> Column:
    """A slot among those of passages of the class ``shape``; ``sizes`` tells how many passages each class has."""
    parts = F.create_map(*[F.lit(x) for c, m in sizes.items() for x in (c, -(-m // slot))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    return F.shiftleft(shape.cast("long"), 40) + F.pmod(F.xxhash64("key"), F.try_element_at(parts, shape))


def counted(passages: DataFrame) -> DataFrame:
    """(term, slot, key, dl, tf): each different term of each row of ``passages`` (key, slot, t) and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, COUNTED) for x in batches for at in range(0, x.num_rows, COUNTED)):
            words = b.column(2)
            row = np.asarray(pc.list_parent_indices(words), np.int64)
            if not len(row):
                continue
            coded = pc.list_flatten(words).dictionary_encode()
            pair, tf = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(pair, len(coded.dictionary))
            at = pa.array(row)
            dl = pc.list_value_length(words).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word)), b.column(1).take(at), b.column(0).take(at), dl.take(at), pa.array(tf, pa.int32())], ["term", "slot", "key", "dl", "tf"])

    kind = passages.schema["key"].dataType.simpleString()
    return passages.select("key", "slot", "t").mapInArrow(run, f"term string, slot long, key {kind}, dl int, tf int")


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings (folder, term, slot, key, tf, dl) that come in the order of folder, term and slot; a block may begin in one batch and end in another."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        if not t.num_rows:
            continue
        coded, slot = t.column("term").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("slot").to_numpy()
        starts = np.flatnonzero(np.r_[True, (coded[1:] != coded[:-1]) | (slot[1:] != slot[:-1])])
        # The last block goes on with the next batch.
        held = t.slice(int(starts[-1])).combine_chunks().to_batches()[0]
        if len(starts) > 1:
            yield _blocks_of(t.slice(0, int(starts[-1])), starts[:-1])
    if held is not None:
        yield _blocks_of(pa.Table.from_batches([held]), np.zeros(1, int))


def _blocks_of(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    tf, dl, at = t.column("tf").to_numpy(), t.column("dl").to_numpy(), pa.array(starts)
    ends = np.r_[starts, t.num_rows].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), t.column(c).combine_chunks()) for c in ("key", "tf", "dl")]
    first = [t.column(c).combine_chunks().take(at) for c in ("folder", "term", "slot")]
    told = [pa.array(x, pa.int32()) for x in (np.diff(ends), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts))]
    return pa.RecordBatch.from_arrays([*first, *told, *lists], ["folder", "term", "slot", "n", "tf_most", "dl_least", "keys", "tfs", "dls"])


@dataclass(frozen=True)
class Asked:
    folders: list[int]
    terms: list[str]


@dataclass(frozen=True)
class TermIndex:
    """``blocks``: folder, term, slot, n, tf_most, dl_least, keys, tfs, dls. ``words``: folder, term, df. ``n`` passages of ``total`` terms together."""

    blocks: DataFrame
    words: DataFrame
    n: int
    total: int
    folders: int
    key: str

    @staticmethod
    def build(passages: DataFrame, *, key: str, text: str, path: str | None = None, slot: int = SLOT, folder: int = FOLDER) -> TermIndex:
        """Writes the index to ``path``; its totals come last, so that an index with totals is whole.

        Without a path it is kept under the ``version`` of the passages and found there again
        in this session until a file changes.
        """
        spark = passages.sparkSession
        at = path or f"{shared_dir(spark)}/lodeworks/terms-{version(passages, key, text, slot, folder)}"
        if path is None and exists(spark, f"{at}/totals/_SUCCESS"):
            return TermIndex.open(spark, at)
        t = passages.select(F.col(key).alias("key"), F.col(text).alias("text"))
        shape = _length_class(F.octet_length(F.coalesce("text", F.lit(""))))
        sizes = {r["c"]: r["n"] for r in t.groupBy(shape.alias("c")).agg(F.count("*").alias("n")).collect()}
        named = t.filter("key IS NOT NULL AND text IS NOT NULL")
        one = counted(named.select("key", slot_of(shape, sizes, slot).alias("slot"), terms(F.col("text")).alias("t")))
        if not named.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            # Rows of one key and length count as one passage.
            one = one.groupBy("term", "slot", "key", "dl").agg(F.sum("tf").cast("int").alias("tf"))
        return TermIndex.write(one, sum(sizes.values()), at, key=key, folder=folder)

    @staticmethod
    def write(one: DataFrame, n: int, at: str, *, key: str, folder: int = FOLDER) -> TermIndex:
        """An index of ``n`` passages from their postings (term, slot, key, dl, tf)."""
        spark = one.sparkSession
        kind = one.schema["key"].dataType.simpleString()
        one = stored(one.select("term", "slot", "key", "tf", "dl"), "postings")
        size = one.agg(F.count("*").alias("n"), F.sum("tf").alias("total")).first()
        folders = max(1, min(FOLDERS, -(-size["n"] // folder)))
        # Postings move once. Those of a common term are dealt to several tasks, by ranges of slots; a block stays in one.
        filed = one.withColumn("folder", _folder(F.col("term"), folders)).repartitionByRange("folder", "term", "slot").sortWithinPartitions("folder", "term", "slot", "key", "tf", "dl")
        told = f"folder int, term string, slot long, n int, tf_most int, dl_least int, keys array<{kind}>, tfs array<int>, dls array<int>"
        # Order within the tasks holds; the writer is not told of it and would sort the blocks by folder alone.
        filed.select("folder", "term", "slot", "key", "tf", "dl").mapInArrow(in_blocks, told).write.mode("overwrite").partitionBy("folder").parquet(f"{at}/blocks")
        word = spark.read.schema("term string, n int, folder int").parquet(f"{at}/blocks").groupBy("folder", "term").agg(F.sum("n").alias("df"))
        word.repartitionByRange("folder", "term").sortWithinPartitions("folder", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{at}/words")
        told = F.struct(F.lit(n).cast("long").alias("n"), F.lit(size["total"] or 0).cast("long").alias("total"), F.lit(folders).alias("folders"), F.lit(key).alias("key"), F.lit(kind).alias("kind"))
        spark.range(1).select(told.alias("x")).select("x.*").coalesce(1).write.mode("overwrite").parquet(f"{at}/totals")
        discard(one)
        return TermIndex.open(spark, at)

    @staticmethod
    def open(spark: SparkSession, path: str) -> TermIndex:
        r = spark.read.parquet(f"{path}/totals").first()
        blocks = spark.read.schema(f"term string, slot long, n int, tf_most int, dl_least int, keys array<{r['kind']}>, tfs array<int>, dls array<int>, folder int").parquet(f"{path}/blocks")
        words = spark.read.schema("term string, df long, folder int").parquet(f"{path}/words")
        return TermIndex(blocks, words, r["n"], r["total"], r["folders"], r["key"])

    # -- search ---------------------------------------------------------------------------

    def _told(self, queries: DataFrame, query: str, text: str) -> tuple[DataFrame, Asked | None, int]:
        """(_q, folder, term, df, idf) of what is asked and indexed, folders and terms to name in the plan if all that fits in it, and how many postings these have."""
        asked, few = self._asked(queries, query, text)
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        told = self._narrow(self.words, few).join(self._small(asked, few), ["folder", "term"]).select("_q", "folder", "term", "df", idf.alias("idf"))
        if few is None:
            told = stored(told, "told")
            return told, None, told.agg(F.sum("df")).first()[0] or 0
        got = told.toArrow()
        return queries.sparkSession.createDataFrame(got) if got.num_rows else told.limit(0), few, pc.sum(got["df"]).as_py() or 0

    def _asked(self, queries: DataFrame, query: str, text: str) -> tuple[DataFrame, Asked | None]:
        """(_q, folder, term), and what to name in the plan if it is few enough."""
        spark = queries.sparkSession
        asked = queries.select(F.col(query).alias("_q"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).withColumn("folder", _folder(F.col("term"), self.folders))
        rows = asked.limit(ASKED + 1).toArrow()
        few = None
        if rows.num_rows <= ASKED:
            few = Asked(pc.unique(rows["folder"]).to_pylist(), pc.unique(rows["term"]).to_pylist())
            asked = spark.createDataFrame(rows)
        else:
            asked = stored(asked, "asked")
        return asked, few

    @staticmethod
    def _narrow(df: DataFrame, few: Asked | None) -> DataFrame:
        """Only the folders, and within their files the terms, that are asked for."""
        if few is None:
            return df
        df = df.filter(F.col("folder").isin(few.folders)) if few.folders else df.limit(0)
        return df.filter(F.col("term").isin(few.terms)) if len(few.terms) <= NAMED else df

    @staticmethod
    def _small(df: DataFrame, few: Asked | None) -> DataFrame:
        return F.broadcast(df) if few is not None or df.limit(BROADCAST + 1).count() <= BROADCAST else df

    def _sums(self, hits: DataFrame, query: str) -> DataFrame:
        """Scores of the passages in ``hits``, blocks with _q and idf."""
        t = hits.select("_q", "idf", "tfs", "dls", F.posexplode("keys").alias("_i", "_k"))
        part = bm25_part(F.col("idf"), F.get("tfs", F.col("_i")), F.get("dls", F.col("_i")), self._mean())
        return t.groupBy(F.col("_q").alias(query), F.col("_k").alias(self.key)).agg(F.sum(part).alias("score"))

    def _mean(self) -> float:
        return self.total / self.n if self.total else 1.0

    def scores(self, queries: DataFrame, *, query: str = "query_id", text: str = "query") -> DataFrame:
        """(query, key, score) of all passages with a term of the query; each different term counts once."""
        told, few, _ = self._told(queries, query, text)
        return self._sums(self._narrow(self.blocks, few).join(self._small(told, few), ["folder", "term"]), query)

    def best(self, queries: DataFrame, k: int, *, query: str = "query_id", text: str = "query", digits: int = 6) -> DataFrame:
        """(query, key, score) of each query's best ``k`` passages, and of all that tie with the last of them; scores are rounded."""
        told, few, postings = self._told(queries, query, text)
        hits = self._narrow(self.blocks, few).join(self._small(told, few), ["folder", "term"])
        if postings > UNBOUNDED:
            slots = stored(self.slots(hits, k, query, digits), "slots").filter("_floor IS NULL OR _bound >= _floor").select("_q", "slot", "_floor")
            sums = self._sums(hits.join(self._small(slots, None), ["_q", "slot"]), query)
            # The floor also leaves few rows to rank.
            floor = slots.filter("_floor IS NOT NULL").groupBy(F.col("_q").alias(query)).agg(F.max("_floor").alias("_floor"))
            sums = sums.join(self._small(floor, None), query, "left").filter("_floor IS NULL OR score >= _floor").drop("_floor")
        else:
            sums = self._sums(hits, query)
        rounded = sums.withColumn("score", F.round("score", digits))
        place = F.rank().over(W.partitionBy(query).orderBy(F.col("score").desc()))
        return rounded.withColumn("_p", place).filter(F.col("_p") <= k).drop("_p")

    def slots(self, hits: DataFrame, k: int, query: str, digits: int) -> DataFrame:
        """(_q, slot, _bound, _floor): what a passage of a slot can score at most, and what one must score to be among the best ``k``."""
        most = bm25_part(F.col("idf"), F.col("tf_most"), F.col("dl_least"), self._mean())
        bounds = stored(hits.groupBy("_q", "slot").agg(F.sum(most).alias("_bound")), "bounds")
        nth = F.row_number().over(W.partitionBy("_q").orderBy(F.col("_bound").desc(), "slot"))
        first = bounds.withColumn("_n", nth).filter(F.col("_n") <= max(FIRST, -(-2 * k // SLOT))).select("_q", "slot")
        some = self._sums(hits.join(self._small(first, None), ["_q", "slot"]), query)
        place = F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc()))
        floor = some.withColumn("_p", place).filter(F.col("_p") == k).select(F.col(query).alias("_q"), (F.col("score") - 10.0**-digits).alias("_floor"))
        return bounds.join(floor, "_q", "left")
