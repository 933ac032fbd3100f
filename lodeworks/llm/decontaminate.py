"""Benchmark decontamination with a positional inverted index.

A window is ``length`` consecutive words of an item; an item of fewer words is one
window. One pass over the corpus stores the postings of the test terms: for each
document the hash of the word at every position, 0 where it is no test term. They
tell how often each test term stands in the corpus.

With ``length - near`` of ``length`` words missing at most, and some perhaps wanting
in the whole corpus, a window's other terms are dealt to one group more than may
still be missing, so that one group of any match is whole. The rarest terms lead a
group each, the next ones follow. Leaders fetch their positions; a follower must
stand at its offset from there, which intersects the offset-adjusted lists. The
windows around a place that passes are compared position by position.

Two kinds of match come back: exact phrases (all words of a window in place) and
proximity matches (at least ``near`` of a window's words in place).

Words are compared by 64 bits of hash. Null text has no words; items without words
match nothing; items of the same words are searched for once and all reported; a
null item id counts as an item and is left out of id lists; empty tables give no
hits; repeated document rows are answered alike; a very long text is searched whole,
8 bytes of posting for each of its words together; other columns are neither read nor
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import WORD, Scratch, ascii_lower, block_join, let, stored, text_of, within, without

#: Anchors (some 300 bytes each) and items are broadcast in blocks of so many; keys of hit documents up to BROADCAST_ROWS.
BLOCK_ANCHORS, BLOCK_ITEMS, BROADCAST_ROWS = 200_000, 200_000, 500_000
#: Bits of the filter that tells test terms from other words before postings are stored. A fuller filter stores more words, and no fewer.
FILTER_BITS = 1 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def test_items(items: DataFrame, item: str, text: str) -> DataFrame:
    """_item, _ids, _times and _terms (hashes) of the items of different words."""
    t = items.select(F.col(item).cast("string").alias("_one"), words_of(text_of(text)).alias("_words"))
    t = t.filter(F.size("_words") > 0).groupBy("_words").agg(F.collect_set("_one").alias("_ids"), F.max(F.col("_one").isNull().cast("int")).alias("_no_id"))
    return t.select(F.xxhash64("_words").alias("_item"), "_ids", (F.size("_ids") + F.col("_no_id")).cast("long").alias("_times"), hashed(F.col("_words")).alias("_terms"))


def term_filter(tests: DataFrame) -> Column:
    """A literal array of ``FILTER_BITS`` bits in which those of all test terms are set; that many bits come to the driver at most."""
    bit = F.col("_t").bitwiseAND(F.lit(FILTER_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    rows = tests.select(F.explode("_terms").alias("_t")).groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    bits = ["0"] * (FILTER_BITS // 64)
    for r in rows.collect():
        bits[r["at"]] = str(r["bits"])
    return F.split(F.lit(",".join(bits)), ",").cast("array<bigint>")


def postings(docs: DataFrame, tests: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _id (a hash that tells rows of one key apart), n_words and _at: the hash of the term at each position, 0 for other words."""
    held = term_filter(tests)

    def term(h: Column) -> Column:
        bit = h.bitwiseAND(F.lit(FILTER_BITS - 1))
        found = F.getbit(F.get(held, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int"))
        return F.when(found == 1, h).otherwise(F.lit(0).cast("long"))

    kept = let(hashed(words_of(F.col("_text"))), lambda hs: F.struct(F.size(hs).cast("long").alias("n"), F.transform(hs, term).alias("at")))
    t = docs.select(F.col(key).alias("_key"), F.xxhash64(text_of(text)).alias("_id"), text_of(text).alias("_text"))
    return t.select("_key", "_id", kept.alias("_k")).select("_key", "_id", F.col("_k.n").alias("n_words"), F.col("_k.at").alias("_at"))


def anchors(tests: DataFrame, counts: DataFrame, length: int, near: int) -> DataFrame:
    """The leaders of each window that can match, with the offsets of their followers and what stands around them.

    ``_term`` leads at ``_place`` of ``_item``; ``_d1`` and ``_d2`` are the offsets of the
    followers ``_t1`` and ``_t2`` (null: none). ``_around`` holds the item's terms
    from ``_place - _lead`` on, as far as windows of ``_size`` terms with the place reach.
    """
    placed = tests.select("_item", F.posexplode("_terms").alias("_place", "_term"))
    placed = placed.join(counts, "_term", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = placed.groupBy("_item").agg(F.sort_array(F.collect_list(F.struct("_place", "_term", "_n"))).alias("_t"))
    size = F.least(F.size("_t"), F.lit(length))
    by_count = lambda w: F.sort_array(F.transform(w, lambda x: F.struct(x["_n"].alias("n"), x["_place"].alias("place"), x["_term"].alias("term"))))
    one = rows.select("_item", size.alias("_size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_t") - size + 1), lambda s: by_count(F.slice("_t", s, size)))).alias("_w"))
    # Terms that the corpus lacks are missing in any case; what may be missing besides can be any of the others.
    one = one.withColumn("_w", F.filter("_w", lambda x: x["n"] > 0)).withColumn("_absent", F.col("_size") - F.size("_w"))
    one = one.withColumn("_groups", F.floor(F.col("_size") * (length - near) / length).cast("int") - F.col("_absent") + 1).filter("_groups > 0 AND _absent < _size")
    follower = lambda x, i, k: F.get("_w", i + F.col("_groups") * k)

    def group(x: Column, i: Column) -> Column:
        a, b = follower(x, i, 1), follower(x, i, 2)
        return F.struct(
            x["place"].alias("place"), x["term"].alias("term"), (a["place"] - x["place"]).alias("d1"), a["term"].alias("t1"), (b["place"] - x["place"]).alias("d2"), b["term"].alias("t2")
        )

    led = one.select("_item", "_size", F.explode(F.transform(F.slice("_w", F.lit(1), F.col("_groups")), group)).alias("_g"))
    led = led.select("_item", "_size", *[F.col(f"_g.{c}").alias(f"_{c}") for c in ("place", "term", "d1", "t1", "d2", "t2")]).distinct()
    lead = F.least("_place", F.col("_size") - 1)
    return led.join(tests.select("_item", "_terms"), "_item").select(
        "_item", "_size", "_place", "_term", "_d1", "_t1", "_d2", "_t2", lead.alias("_lead"), F.slice("_terms", F.col("_place") - lead + 1, lead + F.col("_size")).alias("_around")
    )


def matches(posted: DataFrame, tests: DataFrame, length: int, near: int) -> DataFrame:
    """_key, _id, _item, _starts (positions of exact windows) and _near (whether a window is near), from each leader that is followed."""
    spoken = posted.select(F.explode("_at").alias("_term")).filter("_term <> 0")
    counts = stored(spoken.groupBy("_term").agg(F.count("*").alias("_n")), "term-counts")
    led = stored(anchors(tests, counts, length, near), "anchors")
    at = posted.select("_key", "_id", "n_words", "_at", F.posexplode("_at").alias("_p", "_term")).filter("_term <> 0")
    follows = lambda d, t: F.col(d).isNull() | (F.get("_at", F.col("_p") + F.col(d)) == F.col(t))
    met = block_join(at, led, "_term", BLOCK_ANCHORS).filter(follows("_d1", "_t1") & follows("_d2", "_t2"))
    start = F.col("_p") - F.col("_lead")
    met = stored(
        met.select("_key", "_id", "_item", "n_words", "_size", "_around", start.alias("_from"), F.slice("_at", F.greatest(start, F.lit(0)) + 1, F.size("_around")).alias("_part")), "candidates"
    )
    hidden = F.least(F.col("_from"), F.lit(0))
    agree = F.transform("_around", lambda x, i: F.coalesce(F.get("_part", i + hidden) == x, F.lit(False)).cast("int"))
    inside = lambda s: (s + F.col("_from") >= 0) & (s + F.col("_from") + F.col("_size") <= F.col("n_words"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_around") - F.col("_size")), inside)
    counted = let(agree, lambda a: F.transform(starts, lambda s: F.struct((s + F.col("_from")).alias("s"), F.size(F.array_remove(F.slice(a, s + 1, F.col("_size")), 0)).alias("n"))))
    seen = met.select("_key", "_id", "_item", "_size", counted.alias("_c"))
    exact = F.transform(F.filter("_c", lambda x: x["n"] == F.col("_size")), lambda x: x["s"])
    close = F.exists("_c", lambda x: x["n"] * length >= F.col("_size") * near)
    return seen.select("_key", "_id", "_item", "_size", exact.alias("_starts"), close.alias("_near")).filter("_near")


def find(posted: DataFrame, tests: DataFrame, *, length: int = 10, near: int = 8) -> DataFrame:
    """_key, _id, n_hit, n_items, items (ids of exact matches, sorted) and n_near (items with near windows and no exact one) of the documents with matches."""
    one = stored(matches(posted, tests, length, near), "matches")
    words = one.select("_key", "_id", F.explode("_starts").alias("_s"), "_size").distinct()
    words = words.select("_key", "_id", F.explode(F.sequence("_s", F.col("_s") + F.col("_size") - 1)).alias("_p")).distinct().groupBy("_key", "_id").agg(F.count("*").alias("n_hit"))
    items = stored(one.groupBy("_key", "_id", "_item").agg(F.max(F.size("_starts") > 0).alias("_exact")), "matched-items")
    items = block_join(items, tests.select("_item", "_ids", "_times"), "_item", BLOCK_ITEMS)
    told = items.groupBy("_key", "_id").agg(
        F.sum(F.when(F.col("_exact"), F.col("_times")).otherwise(0)).alias("n_items"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("_exact"), F.col("_ids"))))).alias("items"),
        F.sum(F.when(~F.col("_exact"), F.col("_times")).otherwise(0)).alias("n_near"),
    )
    told, words = told.withColumnsRenamed({"_key": "_k", "_id": "_i"}), words
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_id") == F.col("_i"))
    out = told.join(words, same, "left")
    return out.select(F.col("_k").alias("_key"), F.col("_i").alias("_id"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "n_items", "items", "n_near")


def decontaminate(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = 10, near: int = 8
) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items, contaminated and n_near."""
    with Scratch() as scratch:
        tests = stored(test_items(items, item, item_text), "items")
        posted = stored(postings(docs, tests, key, text), "postings")
        found = stored(find(posted, tests, length=length, near=near).withColumnsRenamed({"_key": "_k", "_id": "_i"}), "found")
        found = F.broadcast(found) if within(found, BROADCAST_ROWS) else found
        out = posted.select("_key", "_id", "n_words").join(found, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_id") == F.col("_i")), "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        out = out.select(
            F.col("_key").alias(key), "n_words", zero("n_hit"), zero("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"),
        )
        return scratch.result(out, "decontaminated")


def clean(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = 10, near: int = 8) -> DataFrame:
    """The documents in which no window of an item stands, as they are; a proximity match alone removes none."""
    with Scratch() as scratch:
        tests = stored(test_items(items, item, item_text), "items")
        hit = scratch.result(find(stored(postings(docs, tests, key, text), "postings"), tests, length=length, near=near).filter("n_hit > 0"), "hit")
    return without(docs, hit, key, text)
