"""Exact dedup by recipes of content-defined chunks.

A normalised text (A to Z lower-cased) is cut where its own bytes say so, so that
texts that share a passage share the chunks in its midst wherever it stands. Its
recipe is the ordered list of its chunks' identifiers, and two texts are equal
exactly if their recipes are. Documents whose recipe of hashes nobody shares are alone
and are done after one reading. Only of the others do chunks travel, every different
content once from each task: a hash with one content is the identifier of that
content, and contents that share a hash are told apart by the first place where
each stands. So equality never rests on a hash, and no document travels as a whole.

Defined results: null text is the empty text, whose recipe is empty; of equal texts the
row with the largest key stays (null is the least), of rows that tie one; every row,
repeated ones too, gives a row; an empty table gives an empty one; very long texts are
cut like others (some 8 bytes of recipe stand for a kilobyte of text); other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import BROADCAST_KEYS, Spread, ascii_lower, stored, text_of, within

#: A chunk has so many bytes at least (but for the last) and at most.
LEAST, MOST = 256, 4096
#: A chunk ends after three bytes of these remainders by 8: about one place in 300 of a text, in any script.
ENDS = (3, 1, 4)


def _bytes_of(remainder: int) -> str:
    return "[" + "".join(f"\\x{c:02X}" for c in range(256) if c % 8 == remainder) + "]"


#: The shortest chunk, then as far as the next end or, without one in reach, as far as a chunk may go.
CHUNK = rf"(?s).{{1,{LEAST}}}(?:.{{0,{MOST - LEAST - len(ENDS)}}}?{''.join(map(_bytes_of, ENDS))}|.{{0,{MOST - LEAST}}})"


def normalised(text: str = "text") -> Column:
    return ascii_lower(text_of(text))


def chunks(t: Column) -> Column:
    """The chunks of a text in order, a character for each byte of it."""
    each = F.when(F.octet_length(t) == F.length(t), t).otherwise(F.decode(t.cast("binary"), "ISO-8859-1"))
    return F.regexp_extract_all(each, F.lit(CHUNK), F.lit(0))


def hashes(parts: Column, bits: int = 64) -> Column:
    """A chunk's hash of ``bits`` bits (fewer only to try what happens when they clash)."""
    return F.transform(parts, lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - bits) if bits < 64 else F.xxhash64(x))


def shared(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """(_whole, _list, _n, _one): how many rows have a recipe of hashes, and key and digest of the greatest of them.

    ``_whole``, a hash of the text, finds the rows again in a second reading without cutting all texts anew.
    """
    t = docs.select(F.col(key).alias("_key"), normalised(text).alias("_text"))
    t = t.select(F.struct("_key", F.sha2("_text", 256).alias("_sha")).alias("_one"), F.xxhash64("_text").alias("_whole"), F.xxhash64(hashes(chunks(F.col("_text")), bits)).alias("_list"))
    return t.groupBy("_whole", "_list").agg(F.count("*").alias("_n"), F.max("_one").alias("_one"))


def held(docs: DataFrame, again: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """(_row, _key, _sha, _whole, _ids, _chunks) of the rows whose recipe others may share, once stored."""
    t = docs.select(F.col(key).alias("_key"), normalised(text).alias("_text")).withColumn("_whole", F.xxhash64("_text"))
    facts = again.groupBy("_whole").agg(F.sum("_n").alias("_n"))
    if within(facts, BROADCAST_KEYS):
        t = t.join(F.broadcast(facts.select("_whole")), "_whole", "left_semi")
    else:
        # Beyond that these texts travel to their hash, once, those of hot ones dealt to several tasks.
        t = Spread(facts, "_whole", "_n", "hot-texts").join(t, facts.select("_whole"))
    t = t.select("_key", F.sha2("_text", 256).alias("_sha"), "_whole", chunks(F.col("_text")).alias("_chunks"))
    return stored(t.select(F.monotonically_increasing_id().alias("_row"), "_key", "_sha", "_whole", hashes(F.col("_chunks"), bits).alias("_ids"), "_chunks"), "held")


def clashes(rows: DataFrame) -> DataFrame:
    """(_id, _chunk, _first) of the contents that share their hash with another: the first place (row and number) of each."""
    at = F.posexplode(F.arrays_zip("_ids", "_chunks"))
    t = rows.select("_row", at.alias("_nth", "_x")).select(F.col("_x._ids").alias("_id"), F.col("_x._chunks").alias("_chunk"), F.struct("_row", "_nth").alias("_at"))
    contents = stored(t.groupBy("_id", "_chunk").agg(F.min("_at").alias("_first")).select("_id", F.xxhash64("_chunk", F.lit(3)).alias("_other"), "_chunk", "_first"), "contents")
    several = stored(contents.groupBy("_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("_id"), "clashing")
    return contents.join(F.broadcast(several) if within(several, BROADCAST_KEYS) else several, "_id", "left_semi").select("_id", "_chunk", "_first")


def verified(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_told``: for each of its chunks whose hash others share, in order, where its content stands first.

    Together with ``_ids`` this is the recipe of verified identifiers.
    """
    named = stored(clashes(rows), "clashes")
    nothing = F.array().cast("array<struct<_nth:int,_first:struct<_row:bigint,_nth:int>>>")
    if named.isEmpty():
        return rows.select("_row", "_key", "_sha", "_whole", "_ids", nothing.alias("_told"))
    at = F.posexplode(F.arrays_zip("_ids", "_chunks"))
    t = rows.select("_row", at.alias("_nth", "_x")).select("_row", "_nth", F.col("_x._ids").alias("_id"), F.col("_x._chunks").alias("_chunk"))
    t = t.join(F.broadcast(named) if within(named, BROADCAST_KEYS // 50) else named, ["_id", "_chunk"])
    told = t.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_nth", "_first"))).alias("_told"))
    return stored(rows.join(told, "_row", "left").select("_row", "_key", "_sha", "_whole", "_ids", F.coalesce("_told", nothing).alias("_told")), "recipes")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the first two keep the key's name and type."""
    lists = stored(shared(docs, key, text, bits), "recipes-shared")
    one = lists.filter("_n = 1").select(F.col("_one._key").alias("_key"), F.col("_one._key").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"), F.col("_one._sha").alias("_sha"))
    again = lists.filter("_n > 1")
    rows = verified(held(docs, again, key, text, bits))
    groups = rows.groupBy("_whole", "_ids", "_told").agg(F.count("*").alias("_size"), F.max(F.struct("_key", "_row")).alias("_best"))
    groups = stored(groups.select("_whole", F.col("_ids").alias("_same"), F.col("_told").alias("_alike"), "_size", "_best"), "groups")
    # All rows of a group have its hash, so rows of hot groups are dealt by it and meet the group in every part.
    spread = Spread(again.groupBy("_whole").agg(F.sum("_n").alias("_n")), "_whole", "_n", "hot-groups")
    both = spread.rows(rows).join(spread.facts(groups), ["_whole", "_part"]).filter("_ids = _same AND _told = _alike")
    several = both.select("_key", F.col("_best._key").alias("_keep"), "_size", (F.col("_best._row") == F.col("_row")).alias("_kept"), "_sha")
    out = one.unionByName(several)
    return out.select(F.col("_key").alias(key), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))
