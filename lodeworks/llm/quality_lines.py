"""Quality rules: per-document measures and cross-document line frequency.

Lines are normalised (trimmed, lower-cased, runs of white space and of digits
made one), hashed, and counted: in how many distinct documents of a host does a
line stand? Copies must not count as documents of their own, or every copied text
would be called boilerplate, so documents are told apart by the whole set of
their line hashes, which only copies share. A line is frequent in a host, and
removed there, where it stands in over ``line_limit`` distinct documents and in over
``host_percent`` of a hundred of the host's; a document of which less than ``min_left`` of the
words or fewer than ``min_words`` remain is rejected as depleted.

Base rules reject documents under ``min_words`` words or with over
``max_repeat_percent`` of their words in repeated windows of five.

Defined results: null text is the empty text; null host is a host of its own; an
empty table gives an empty result; repeated rows stand each and count once as
documents; a very long text is judged whole, its words and lines in one task; other
columns are neither read nor returned by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import TOKEN, Scratch, block_join, let, stored, text_of, within, without

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent lines are broadcast in blocks of so many (50 bytes each).
BROADCAST_LINES = 200_000
#: Documents that lose lines are broadcast up to this many, with the hashes of the lines.
BROADCAST_DOCS = 50_000


def repeat_words(words: Column) -> Column:
    """How many words stand in windows of five words that come twice or more."""

    def covered(hits: Column) -> Column:
        steps = F.transform(hits, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(hits, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(marks: Column) -> Column:
        same = lambda x, i, j: F.coalesce(F.get(marks, i + j)["h"] == x["h"], F.lit(False))
        found = F.filter(marks, lambda x, i: same(x, i, -1) | same(x, i, 1))
        return let(F.sort_array(F.transform(found, lambda x: x["at"])), covered)

    def windows(h: Column) -> Column:
        key = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        hashes = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), key)
        marked = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(hashes, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(marked(w), repeated)).otherwise(F.lit(0).cast("long")))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(hashed, windows)).otherwise(F.lit(0).cast("long"))


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    spoken = F.filter(lines, lambda x: F.rlike(x, F.lit(TOKEN)))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": let(spoken, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(words),
    }


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), f"{SPACE}+", " "), "[0-9]+", "0"))


def line_hash(line: Column) -> Column:
    return F.substring(F.md5(normal_line(line)), 1, 16)


def host_of(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def judged(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    line_limit: int = 5,
    host_percent: int = 10,
    min_left: float = 0.3,
) -> DataFrame:
    """As ``judge``, with the key as _key, the hash of the text as _id, the host as _host and the hashes of removed lines as _gone_lines."""
    with Scratch() as scratch:
        host_key = host_of(F.col(host))
        t = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"), host_key.alias("_host"))
        t = t.withColumn("_words", F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0))).withColumn("_lines", F.split("_text", "\n", -1))
        m = measures(F.col("_text"), F.col("_words"), F.col("_lines"))
        spoken = F.filter("_lines", lambda x: F.rlike(x, F.lit(TOKEN)))
        hashed = F.transform(spoken, lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(TOKEN)).alias("n")))
        rows = t.select("_key", F.xxhash64("_text").alias("_id"), "_host", *[c.cast("long").alias(k) for k, c in m.items()], hashed.alias("_lined"))
        rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
        rows = stored(rows, "quality-rows")

        # Distinct documents a line: groups of copies share the set of hashes.
        hashes = F.sort_array(F.array_distinct(F.transform("_lined", lambda x: x["h"])))
        spread = rows.select("_host", F.xxhash64(hashes).alias("_doc"), F.explode(hashes).alias("_h"))
        docs_of = spread.groupBy("_host", "_h", "_doc").agg(F.lit(1).alias("_one")).groupBy("_host", "_h").agg(F.count("*").alias("_n"))
        often = stored(docs_of.filter(F.col("_n") > line_limit), "quality-counts")
        different = rows.filter(F.size("_lined") > 0).groupBy("_host", F.xxhash64(hashes).alias("_doc")).agg(F.lit(1).alias("_one"))
        hosts = stored(different.groupBy("_host").agg(F.count("*").alias("_docs")), "quality-hosts")
        frequent = block_join(often, hosts, "_host", BROADCAST_LINES).filter(F.col("_n") * 100 > F.col("_docs") * host_percent)
        frequent = stored(frequent.select("_host", "_h"), "quality-lines")

        lines = rows.select("_key", "_id", "_host", F.posexplode("_lined").alias("_at", "_l"))
        lines = lines.select("_key", "_id", "_host", "_at", F.col("_l.h").alias("_h"), F.col("_l.n").alias("_n"))
        hit = block_join(lines, frequent, ["_host", "_h"], BROADCAST_LINES)
        # Repeated rows have the same lines at the same places, which count once.
        hit = hit.groupBy("_key", "_id", "_host", "_at").agg(F.max("_n").alias("_n"), F.max("_h").alias("_h"))
        removed = hit.groupBy(F.col("_key").alias("_k"), F.col("_id").alias("_i"), F.col("_host").alias("_o")).agg(F.sum("_n").alias("_gone"), F.collect_set("_h").alias("_gone_lines"))
        own = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_id") == F.col("_i")) & (F.col("_host") == F.col("_o"))
        out = rows.join(removed, own, "left").withColumn("removed_words", F.coalesce("_gone", F.lit(0)).cast("long"))
        left = F.col("n_words") - F.col("removed_words")
        depleted = (F.col("removed_words") > 0) & ((left < min_words) | (left < F.col("n_words") * min_left))
        return scratch.result(out.select("_key", "_id", "_host", "_gone_lines", *m, "base_failed", "removed_words", (~F.col("base_failed") & ~depleted).alias("kept")), "judgements")


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **rules: object) -> DataFrame:
    """One row per document: key, the measures, base_failed, removed_words and kept."""
    return judged(docs, key=key, text=text, **rules).drop("_id", "_host", "_gone_lines").withColumnRenamed("_key", key)


def accepted(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", **rules: object) -> DataFrame:
    """The documents that the rules keep, without their frequent lines; other columns as they are."""
    rows = judged(docs, key=key, text=text, host=host, **rules).filter("NOT kept OR removed_words > 0")
    rows = stored(rows.select("_key", "_id", "_host", "_gone_lines", "kept"), "judged")
    left = without(docs, rows.filter("NOT kept"), key, text)
    # Repeated rows have the same lines, so one of them tells.
    gone = rows.filter("kept").groupBy(F.col("_key").alias("__key"), F.col("_id").alias("__id"), F.col("_host").alias("__host")).agg(F.first("_gone_lines").alias("__gone"))
    gone = stored(gone, "gone-lines")
    gone = F.broadcast(gone) if within(gone, BROADCAST_DOCS) else gone
    old = left[text].cast("string")
    same = left[key].eqNullSafe(gone["__key"]) & (F.xxhash64(F.coalesce(old, F.lit(""))) == gone["__id"]) & (host_of(left[host]) == gone["__host"])
    rest = F.filter(F.split(old, "\n", -1), lambda x: ~(F.rlike(x, F.lit(TOKEN)) & F.array_contains(gone["__gone"], line_hash(x))))
    new = F.when(gone["__gone"].isNull(), left[text]).otherwise(F.array_join(rest, "\n")).alias(text)
    return left.join(gone, same, "left").select(*[new if c == text else left[c] for c in left.columns])
