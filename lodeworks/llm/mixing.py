"""Mixing sources to target weights along a time-varying curriculum.

Targets: every source asks for its weight's share of all words; a source gives at
most ``max_repeat`` times what it has, and the excess goes to the others by
weight. The shares that satisfy this are ``min(cap, level * weight)`` for one
level, found by sorting the sources by ``cap / weight``.

Curriculum: each source has a weight schedule over training time 0 to 1, a line
from ``start`` to ``end``. Its integral is the source's cumulative demand. The
documents of a source stand in a fixed pseudo-random order, which is passed over
up to ``max_repeat`` times; inverting the demand at the words before a document in
a pass gives its time there. The demand of all sources up to that time, as a share of
all that is asked for, is its training position, and the result is range-sorted by it.

Prefix sums run within (source, slice of the order) and then over the slices'
totals, so that a source with a third of all rows is shared by many tasks.

Defined results: null text has size 0; null source is a source of its own, last
in order; an empty table gives an empty result; sources without words get target
0; repeated rows stand beside each other and are counted each; a very long text is
counted whole, and no more than three times its words are taken of it; other columns
are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import TOKEN, let, stored, text_of

#: Rows in a slice of a source's order, on average.
SLICE_ROWS = 2048


def water_level(sources: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """``target`` for each row of ``sources`` (source, source_size); a row for each source, so a small table."""
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    t = sources.withColumn("_nth", nth).withColumn("_weight", weight)
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    full = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_nth").asc()).rowsBetween(W.unboundedPreceding, -1)
    t = (
        t.withColumn("_all", F.sum("source_size").over(full))
        .withColumn("_weights", F.sum("_weight").over(full))
        .withColumn("_filled", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    )
    # The level if just the sources before this one are full. It holds where it leaves this one unfilled;
    # filling sources that need not be only lowers it, so the highest such level is the one.
    level = (F.col("_all") - F.col("_filled")) / (F.col("_weights") - F.col("_used"))
    t = t.withColumn("_level", F.when(level <= F.col("_cap") / F.col("_weight"), level))
    t = t.withColumn("_level", F.max("_level").over(full))
    return t.withColumn("target", F.least("_cap", F.col("_level") * F.col("_weight")))


def position(share: Column, start: Column, end: Column) -> Column:
    """The time at which a demand whose rate runs in a line from ``start`` to ``end`` has met ``share`` of its integral."""
    slope = (end - start) / 2
    need = share * (start + slope)
    root = F.sqrt(F.greatest(start * start + slope * need * 4, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise(need * 2 / (start + root))


def curriculum(sources: DataFrame, schedules: Sequence[tuple[float, float]]) -> DataFrame:
    """``sources`` with _line, the ends of each one's schedule, and _even and _tilt: all sources ask for ``even * t + tilt * t^2`` of their words up to time t."""
    lines = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in schedules])
    t = sources.withColumn("_line", F.element_at(lines, (F.col("_nth") % len(schedules) + 1).cast("int")))
    full = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    a, b = F.col("_line.a"), F.col("_line.b")
    every = F.sum("target").over(full)
    share = lambda c: F.when(every > 0, F.sum(F.col("target") * c / (a + b)).over(full) / every)
    return t.withColumn("_even", share(a * 2)).withColumn("_tilt", share(b - a))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    schedules: Sequence[tuple[float, float]] = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5)),
    max_repeat: float = 3,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
    by_pass: bool = False,
) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, position, source and ``keep``, sorted by position.

    ``weights`` and ``schedules`` repeat over the sources in code-point order. The
    words taken from a source are its target rounded down; its last document may
    give only a part. Documents with ``taken`` 0 keep a row with null position.
    The position is that of the first pass and ``taken`` the sum of all; ``passes``
    tells both for each pass, as ``taken:position`` with positions in parts of 10^9,
    comma-joined. With ``by_pass`` there is a row for each pass that takes words, with its number in
    ``nth_pass`` (null where none does), its own words and its own position.
    """
    own = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    sized = stored(
        docs.select(
            F.col(key).alias("_key"),
            # Never null, so that joins and windows on it share one partitioning.
            F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"),
            F.regexp_count(text_of(text), F.lit(TOKEN)).cast("long").alias("size"),
            # With the text, so that rows without or with one id are spread too.
            F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(text_of(text)))).alias("_order"),
            own.alias("_own"),
        ),
        "mix-sizes",
    )
    rows = sized.count()
    digits = 1
    while 16**digits * SLICE_ROWS < rows:
        digits += 1
    sized = sized.withColumn("_slice", F.substring("_order", 1, digits))
    slices = stored(sized.groupBy("_source", "_slice").agg(F.sum("size").alias("_words")), "mix-slices")
    sources = slices.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    sources = sources.withColumn("source", F.when(F.col("_source") != "", F.substr("_source", F.lit(2))))
    sources = water_level(sources, weights, max_repeat)
    sources = curriculum(sources, schedules).select("_source", "source_size", "target", "_line", "_even", "_tilt")
    # Words before each slice: those of earlier groups of slices, and of earlier slices in the group.
    slices = slices.withColumn("_group", F.substring("_slice", 1, digits // 2))
    upto = W.unboundedPreceding, 0
    groups = slices.groupBy("_source", "_group").agg(F.sum("_words").alias("_all"))
    groups = groups.withColumn("_start", F.sum("_all").over(W.partitionBy("_source").orderBy("_group").rowsBetween(*upto)) - F.col("_all"))
    slices = slices.withColumn("_offset", F.sum("_words").over(W.partitionBy("_source", "_group").orderBy("_slice").rowsBetween(*upto)) - F.col("_words"))
    slices = slices.join(groups.drop("_all"), ["_source", "_group"]).join(sources, "_source")
    slices = slices.select("_source", "_slice", (F.col("_offset") + F.col("_start")).alias("_offset"), "source_size", "target", "_line", "_even", "_tilt")
    inner = W.partitionBy("_source", "_slice").orderBy("_order", "_key", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("_before", F.sum("size").over(inner) - F.col("size"))
    placed = placed.join(slices, ["_source", "_slice"])
    placed = placed.withColumn("_before", F.col("_before") + F.col("_offset"))
    passes = int(max_repeat) + (max_repeat != int(max_repeat))
    whole = F.floor("target")
    took = [F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") * p - F.col("_before"))).cast("long") for p in range(passes)]

    def trained(p: int) -> Column:
        time = position((F.col("_before") + F.col("source_size") * p) / F.col("target"), F.col("_line.a"), F.col("_line.b"))
        return F.round(let(time, lambda t: F.col("_even") * t + F.col("_tilt") * t * t), 9)

    every = F.array(*[F.when(x > 0, F.struct(F.lit(p + 1).alias("nth"), x.alias("taken"), trained(p).alias("at"))) for p, x in enumerate(took)])
    placed = placed.withColumn("_passes", F.filter(every, lambda x: x.isNotNull()))
    if by_pass:
        placed = placed.withColumn("_pass", F.explode_outer("_passes"))
        placed = placed.withColumn("nth_pass", F.col("_pass.nth")).withColumn("taken", F.coalesce("_pass.taken", F.lit(0).cast("long"))).withColumn("position", F.col("_pass.at"))
    else:
        placed = placed.withColumn("taken", F.aggregate("_passes", F.lit(0).cast("long"), lambda a, x: a + x["taken"])).withColumn("position", F.get("_passes", F.lit(0))["at"])
        told = lambda x: F.concat_ws(":", x["taken"], F.round(x["at"] * 1e9).cast("long"))
        placed = placed.withColumn("passes", F.array_join(F.transform("_passes", told), ","))
    ordered = placed.orderBy(F.col("position").asc_nulls_last(), "_order")
    return ordered.select(
        F.col("_key").alias(key), "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "position",
        "nth_pass" if by_pass else "passes", *([F.col(f"_own.{c}").alias(c) for c in keep]),
    )
