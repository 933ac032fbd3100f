"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of white-space separated text.
TOKEN = r"[^\x20\x09-\x0D]+"
#: What stands between words of letters and digits, character by character: a class of single characters is
#: a table look-up to the regular-expression engine, ten times as fast as one of ranges.
_BREAKS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: Words of lower-cased texts; every character from U+0080 on counts as a letter.
WORD = f"[^{_BREAKS}{UPPER}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; a folder of our own stands in
    only where that is unset and all runs on one machine, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


#: The tables stored within each open ``Scratch``, innermost last.
_open: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder, in a folder for each value of ``by``, and read back.

    Cuts lineage: a lost executor rereads the files instead of recomputing, and
    plans that use the table several times do not run it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _open:
        _open[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """A stretch of work whose stored tables are deleted at its end, but for its ``result``.

    A job that fails leaves its tables to whoever looks into it.
    """

    def __enter__(self) -> Scratch:
        self.kept: list[DataFrame] = []
        _open.append([])
        return self

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        self.kept.append(out)
        return out

    def __exit__(self, kind: object, *_: object) -> None:
        tables = _open.pop()
        if kind is None:
            discard(*(t for t in tables if not any(t is k for k in self.kept)))
            if _open:
                _open[-1].extend(self.kept)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for tasks that give freed memory back to the system at their end: workers wait for later stages, and would hold it meanwhile."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only. Texts of ASCII alone, where octets and characters
    are as many, take the faster built-in, which agrees there."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row.

    A lambda that refers to an outer expression evaluates it again for every
    element; a lambda variable does not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(x: Column, add: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array, ``add`` over all before it; ``add`` must be associative.

    Appending within ``aggregate`` copies what stands there already, so this runs
    through blocks of about the root of the size, and then over the blocks.
    """
    grow = lambda a, v: F.concat(a, F.array(add(F.element_at(a, -1), v)))
    each = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / each).cast("int") - 1), lambda k: F.aggregate(F.slice(x, k * each + 1, each), F.array(zero), grow))
    starts = lambda blocks: F.aggregate(blocks, F.array(zero), lambda a, b: grow(a, F.element_at(b, -1)))
    moved = lambda blocks, at: F.transform(blocks, lambda b, k: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: add(F.get(at, k), v)))
    found = let(cut, lambda blocks: let(starts(blocks), lambda at: F.flatten(moved(blocks, at))))
    return F.when(F.size(x) > 0, found).otherwise(F.slice(F.array(zero), 1, 0))


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to."""
    return df.limit(rows + 1).count() <= rows


def block_join(rows: DataFrame, facts: DataFrame, on: str | list[str], most: int) -> DataFrame:
    """The inner join of ``rows`` with a table of any size: broadcast in blocks of about ``most`` rows.

    ``rows`` are never dealt by the key, so a hot key costs no task more than another;
    they are read once for each block, so both sides should be stored tables.
    """
    blocks = max(1, -(-facts.count() // most))
    if blocks == 1:
        return rows.join(F.broadcast(facts), on)
    own = F.pmod(F.xxhash64(*facts.columns, F.lit(17)), F.lit(blocks))
    out = [rows.join(F.broadcast(facts.filter(own == i)), on) for i in range(blocks)]
    while len(out) > 1:
        out = [out[i].union(out[i + 1]) if i + 1 < len(out) else out[i] for i in range(0, len(out), 2)]
    return out[0]


#: A key with more rows than this is dealt to several tasks.
HOT_ROWS = 512


class Spread:
    """Joins on a key with known numbers of rows, in which the rows of hot keys are dealt to several tasks.

    ``sizes`` has the key and ``n``, how many rows it has on the larger side. The hot
    keys travel with the plan; where over ``BROADCAST_KEYS`` keys are hot, only hotter
    ones count as such.
    """

    def __init__(self, sizes: DataFrame, key: str, n: str, name: str):
        self.key, most = key, HOT_ROWS
        hot = stored(sizes.filter(F.col(n) > most).select(F.col(key).alias("_hot"), F.col(n).alias("_rows")), name)
        while not within(hot.filter(F.col("_rows") > most), BROADCAST_KEYS):
            most *= 4
        self.hot = hot.filter(F.col("_rows") > most).select("_hot", F.ceil(F.col("_rows") / most).cast("int").alias("_parts"))
        self.any = not self.hot.isEmpty()

    def _with(self, df: DataFrame, part: Column) -> DataFrame:
        return df.join(F.broadcast(self.hot), df[self.key] == self.hot["_hot"], "left").withColumn("_part", part).drop("_hot", "_parts")

    def rows(self, df: DataFrame) -> DataFrame:
        """The larger side, with the part that each row is dealt to."""
        return self._with(df, F.coalesce(F.pmod(F.xxhash64(*df.columns, F.lit(5)), F.col("_parts")), F.lit(0)).cast("int")) if self.any else df.withColumn("_part", F.lit(0))

    def facts(self, df: DataFrame) -> DataFrame:
        """The side with a row for each key, in every part."""
        return self._with(df, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))) if self.any else df.withColumn("_part", F.lit(0))

    def join(self, rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        if not self.any:
            return rows.join(facts, self.key, how)
        return self.rows(rows).join(self.facts(facts), [self.key, "_part"], how).drop("_part")


#: Rows of keys are broadcast up to this many (some 30 bytes each); beyond it both sides are shuffled.
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, rows: DataFrame, key: str, text: str, how: str = "left_anti") -> DataFrame:
    """``docs`` without the rows (or with ``left_semi`` only the rows) that ``rows`` names by _key and _id.

    ``_id`` is the hash of the text, which tells apart rows that share a key. No
    column is added on the way, so the columns of ``docs`` may have any names.
    """
    named = stored(rows.select(F.col("_key").alias("__key"), F.col("_id").alias("__id")).distinct(), "named")
    named = F.broadcast(named) if within(named, BROADCAST_KEYS) else named
    same = docs[key].eqNullSafe(named["__key"]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == named["__id"])
    return docs.join(named, same, how)
