"""Literal search by stored signatures of three characters.

Texts, with white space collapsed, are dealt to places by a hash of their key, 64 places to a
slot and 16 slots to a block. For every gram of three characters (and of one and two, for needles that short) a
row has the block's places with the gram as the bits of a number for each slot. A needle's rarest
grams fetch their rows, from the files of those grams and no others; the bits that all
have in common are the places where it may stand, and only texts of these are read and searched. Grams
are taken of both the text with A to Z lower-cased and the text lower-cased by Unicode, so that
one signature serves searches with and without regard to case.

Texts are stored in the order of their places first, so that a block's texts stand together and
their grams become rows of the block in the task that reads them; what is shuffled are these rows, not the
grams of each text. Where a block ends up in two tasks it has two rows of a gram, of which a
search takes the bits together. A gram is a number: its characters, each plus 1, in 21 bits each.

Texts that share a place share its bit, which costs a look into each and loses none. Null
texts hold nothing; blank needles are not searched; repeated keys are rows of their own; an
empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.text import around, collapsed
from lodeworks.operators.mailbox import MAX_NEEDLES
from lodeworks.operators.tables import discard, exists, shared_dir, stored, version

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Places of a slot (the bits of a long), slots of a block, rows of a folder, the most folders, and texts of a part.
SLOT, BLOCK, FOLDER, FOLDERS, PART = 64, 16, 100_000, 1024, 4096
#: The grams that are looked up for a needle.
RAREST = 6
#: Bits of a character in a gram; characters of a text that are looked at together, and about how many grams a worker holds.
CHAR, PIECE, HELD = 21, 1 << 20, 1 << 22
#: Candidates are broadcast up to so many bytes (a place takes about 64 and each of its needles 4), and named in the plan up to so many parts.
BROADCAST, NAMED = 1 << 27, 1000


def _grams(t: Column) -> Column:
    """The different grams that begin at any character, of three characters but for the last two."""
    return F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)(?=(.{1,3}))."), F.lit(1)))


def _ascii_lower(t: Column) -> Column:
    return F.translate(t, UPPER, LOWER)


def coded(gram: Column) -> Column:
    """A gram as a number; characters that it lacks are 0."""
    chars = [F.substr(gram, F.lit(i), F.lit(1)) for i in (1, 2, 3)]
    return reduce(lambda n, c: F.shiftleft(n, CHAR) + F.when(c == "", 0).otherwise(F.ascii(c) + 1), chars, F.lit(0).cast("long"))


def _grams_of(t: str) -> Iterator[np.ndarray]:
    """The different numbers of the grams that begin at the characters of a text, by pieces of it; at its end those of two characters and of one."""
    for at in range(0, len(t), PIECE):
        n = min(PIECE, len(t) - at)
        c = np.zeros(n + 2, np.int64)
        found = np.frombuffer(t[at : at + n + 2].encode("utf-32-le"), np.uint32)
        c[: len(found)] = found
        c[: len(found)] += 1
        g = np.sort(c[:n] << 2 * CHAR | c[1 : n + 1] << CHAR | c[2:])
        yield g[np.r_[True, g[1:] != g[:-1]]]


def _joined(gram: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams in order, each once, with all their bits."""
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[starts], np.bitwise_or.reduceat(mask, starts)


def _of_slot(grams: list[np.ndarray], bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Grams and bits of the texts of one slot: of their grams, and of the first two characters and the first one of each."""
    gram = np.concatenate(grams)
    mask = np.repeat(np.left_shift(np.uint64(1), np.array(bits, np.uint64)), [len(g) for g in grams])
    order = np.argsort(gram, kind="stable")
    found = [_joined(gram[order], mask[order])]
    for cut in (CHAR, 2 * CHAR):
        gram, mask = found[-1]
        found.append(_joined(gram >> cut << cut, mask))
    # A gram without a last character is among those of one character less too, with all bits.
    kept = [g & ((1 << at) - 1) != 0 for (g, _), at in zip(found, (CHAR, 2 * CHAR), strict=False)] + [slice(None)]
    return tuple(np.concatenate([x[i][k] for x, k in zip(found, kept, strict=True)]) for i in (0, 1))


def _of_block(slots: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(gram, block, n, masks) of slots (slot, grams, bits) of one block; a slot may come in several parts."""
    gram, row = np.unique(np.concatenate([g for _, g, _ in slots]), return_inverse=True)
    masks, at = np.zeros((len(gram), BLOCK), np.uint64), 0
    for slot, g, m in slots:
        masks[row[at : at + len(g)], slot % BLOCK] |= m
        at += len(g)
    ends = np.arange(0, BLOCK * len(gram) + 1, BLOCK, dtype=np.int32)
    n = np.bitwise_count(masks).sum(axis=1, dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(masks.view(np.int64).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), slots[0][0] // BLOCK, np.int64)), pa.array(n), lists], ["gram", "block", "n", "masks"])


def signed(texts: DataFrame) -> DataFrame:
    """(gram, block, n, masks): all grams that a needle may ask for, of ``texts`` (place, t), whose rows come in the order of places; ``n`` places have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams, bits, held, slots = None, [], [], 0, []
        for b in batches:
            for place, t, low in zip(*b.columns, strict=True):
                slot, bit = divmod(place.as_py(), SLOT)
                if grams and (slot != now or held > HELD):
                    slots.append((now, *_of_slot(grams, bits)))
                    grams, bits, held = [], [], 0
                if slots and (slot // BLOCK != now // BLOCK or sum(len(g) for _, g, _ in slots) > HELD):
                    yield _of_block(slots)
                    slots = []
                now, raw, low = slot, t.as_py().encode().lower(), low.as_py()
                for x in (raw.decode(), *([low] if low is not None and low.encode() != raw else [])):
                    for g in _grams_of(x):
                        grams.append(g)
                        bits.append(bit)
                        held += len(g)
        if grams:
            slots.append((now, *_of_slot(grams, bits)))
        if slots:
            yield _of_block(slots)

    low = F.when(F.octet_length("t") != F.length("t"), F.lower("t"))
    return texts.select("place", "t", low.alias("low")).mapInArrow(run, "gram long, block long, n long, masks array<long>")


def wanted(n: Column) -> Column:
    """The grams that any text with the needle has: all of three characters, or the needle itself."""
    return F.when(F.length(n) < 3, F.array(n)).otherwise(F.filter(_grams(n), lambda g: F.length(g) == 3))


def _folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


@dataclass(frozen=True)
class SpanIndex:
    """``masks``: folder, gram, block, masks. ``grams``: folder, gram, n. ``texts``: part, place, key, t."""

    masks: DataFrame
    grams: DataFrame
    texts: DataFrame
    folders: int
    per_part: int
    key: str

    @staticmethod
    def build(documents: DataFrame, *, key: str, text: str, path: str | None = None, folder: int = FOLDER, part: int = PART) -> SpanIndex:
        """Writes the index to ``path``, or under the ``version`` of the documents, where it is found again until a file changes."""
        spark = documents.sparkSession
        at = path or f"{shared_dir(spark)}/lodeworks/spans-{version(documents, key, text, folder, part)}"
        if path is None and exists(spark, f"{at}/totals/_SUCCESS"):
            return SpanIndex.open(spark, at)
        n = documents.count()
        slots = -(-max(1, n) // SLOT)
        places = slots * SLOT
        per_part = max(part, -(-places // FOLDERS))
        place = F.pmod(F.xxhash64(F.col(key)), F.lit(places))
        t = documents.filter(F.col(text).isNotNull()).select(place.alias("place"), F.col(key).alias("key"), collapsed(F.col(text)).alias("t"))
        # Places are even by their hash, so that ranges of slots need no sample, for which all texts would be read and collapsed once more.
        ranges = min(slots, max(-(-places // part), 3 * spark.sparkContext.defaultParallelism))
        dealt = t.repartitionById(ranges, F.floor(F.floor(F.col("place") / SLOT) * ranges / slots).cast("int"))
        dealt.withColumn("part", F.floor(F.col("place") / per_part).cast("int")).sortWithinPartitions("part", "place").write.mode("overwrite").partitionBy("part").parquet(f"{at}/texts")
        masks = made = stored(signed(spark.read.schema("place long, t string").parquet(f"{at}/texts")), "masks")
        folders = max(1, min(FOLDERS, -(-masks.count() // folder)))
        masks = masks.withColumn("folder", _folder(F.col("gram"), folders))
        masks.drop("n").repartitionByRange("folder", "gram", "block").sortWithinPartitions("folder", "gram", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{at}/masks")
        grams = masks.groupBy("folder", "gram").agg(F.sum("n").alias("n"))
        grams.repartition("folder").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{at}/grams")
        discard(made)
        spark.range(1).select(F.lit(folders).alias("folders"), F.lit(per_part).alias("per_part"), F.lit(key).alias("key"), F.lit(documents.schema[key].dataType.simpleString()).alias("kind")).coalesce(1).write.mode("overwrite").parquet(f"{at}/totals")
        return SpanIndex.open(spark, at)

    @staticmethod
    def open(spark: SparkSession, path: str) -> SpanIndex:
        r = spark.read.parquet(f"{path}/totals").first()
        masks = spark.read.schema("gram long, block long, masks array<long>, folder int").parquet(f"{path}/masks")
        grams = spark.read.schema("gram long, n long, folder int").parquet(f"{path}/grams")
        texts = spark.read.schema(f"place long, key {r['kind']}, t string, part int").parquet(f"{path}/texts")
        return SpanIndex(masks, grams, texts, r["folders"], r["per_part"], r["key"])

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(needle_id, _n, _f, place) where a needle may stand. ``needles``: needle_id, _n (its text), _f (the text its grams are taken of)."""
        n = _numbered(needles)
        return self._places(n).join(F.broadcast(n), "_q").select("needle_id", "_n", "_f", "place")

    def _places(self, needles: DataFrame) -> DataFrame:
        """(_q, place) where a needle may stand. ``needles``: _q (its number), _f."""
        asked = needles.select("_q", F.explode(wanted(F.col("_f"))).alias("gram")).withColumn("gram", coded(F.col("gram"))).withColumn("folder", _folder(F.col("gram"), self.folders))
        # Grams of at most MAX_NEEDLES needles: the request, not the corpus.
        asked = stored(asked, "asked")
        told = F.broadcast(asked.select("folder", "gram").distinct())
        known = self.grams.join(told, ["folder", "gram"], "left_semi")
        t = asked.join(F.broadcast(known), ["folder", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        chosen = t.withColumn("_nth", F.row_number().over(W.partitionBy("_q").orderBy("n", "gram"))).filter(F.col("_nth") <= RAREST)
        # A gram that no text has ends the search for its needle.
        own = W.partitionBy("_q")
        chosen = stored(chosen.withColumn("_least", F.min("n").over(own)).filter("_least > 0").withColumn("_of", F.count("*").over(own)).select("_q", "folder", "gram", "_nth", "_of"), "chosen")
        folders = [r[0] for r in chosen.select("folder").distinct().collect()]
        grams = [r[0] for r in chosen.select("gram").distinct().limit(NAMED + 1).collect()]
        masks = self.masks.filter(F.col("folder").isin(folders))
        masks = masks.filter(F.col("gram").isin(grams)) if len(grams) <= NAMED else masks
        # All bits of a gram in a slot, which may come from two rows, and of these the bits that all grams of the needle have.
        each = [F.bit_or(F.when(F.col("_nth") == i, F.col("mask"))).alias(f"_m{i}") for i in range(1, RAREST + 1)]
        rows = masks.join(F.broadcast(chosen), ["folder", "gram"]).select("_q", "_nth", "_of", "block", F.posexplode("masks").alias("_at", "mask")).filter("mask <> 0")
        hit = rows.groupBy("_q", "_of", (F.col("block") * BLOCK + F.col("_at")).alias("slot")).agg(*each)
        common = reduce(Column.bitwiseAND, [F.when(F.col("_of") < i, F.lit(-1).cast("long")).otherwise(F.coalesce(f"_m{i}", F.lit(0).cast("long"))) for i in range(1, RAREST + 1)])
        bits = hit.select("_q", "slot", common.alias("_common")).filter("_common <> 0").select("_q", "slot", "_common", F.explode(F.sequence(F.lit(0), F.lit(SLOT - 1))).alias("_bit"))
        return bits.filter(F.getbit("_common", F.col("_bit")) == 1).select("_q", (F.col("slot") * SLOT + F.col("_bit")).alias("place"))

    def find(self, needles: DataFrame, *, fold: bool = False, context: int = 240) -> DataFrame:
        """(needle_id, key, position, context) of the first literal occurrence of each needle in each text, white space collapsed on both sides."""
        if needles.limit(MAX_NEEDLES + 1).count() > MAX_NEEDLES:
            raise ValueError(f"at most {MAX_NEEDLES} needles in one request")
        n = needles.select("needle_id", F.trim(collapsed(F.col("needle"))).alias("_n")).filter("_n != ''")
        n = _numbered(n.withColumn("_f", F.lower("_n") if fold else _ascii_lower(F.col("_n"))))
        found = stored(self._places(n).groupBy("place").agg(F.collect_list("_q").alias("_qs")), "places")
        few = found.agg(F.coalesce(F.sum(F.size("_qs") * 4 + 64), F.lit(0))).first()[0] <= BROADCAST
        texts = self.texts
        parts = [r[0] for r in found.select(F.floor(F.col("place") / self.per_part).cast("int").alias("part")).distinct().limit(NAMED + 1).collect()]
        if len(parts) <= NAMED:
            texts = texts.filter(F.col("part").isin(parts))
        # A text moves once at most, and only where the numbers of all texts' needles are too many to go to the texts; the needles' own texts are the request's.
        t = texts.join(F.broadcast(found) if few else found, "place").select("key", "t", F.explode("_qs").alias("_q")).join(F.broadcast(n), "_q")
        hay, pin = (F.lower("t"), F.lower("_n")) if fold else (F.col("t"), F.col("_n"))
        # Most candidates are none, which contains() tells by bytes; locate() counts characters.
        t = t.filter(F.contains(hay, pin)).withColumn("position", F.expr("locate(lower(_n), lower(t))" if fold else "locate(_n, t)"))
        return t.select("needle_id", F.col("key").alias(self.key), "position", around(F.col("t"), F.col("position"), context).alias("context"))


def _numbered(needles: DataFrame) -> DataFrame:
    """``needles``, a request's, with a number ``_q`` of each row."""
    return stored(needles.coalesce(1).withColumn("_q", F.monotonically_increasing_id().cast("int")), "needles")
