"""Exact nearest-rank percentiles of groups of any size.

A wanted rank is narrowed down: the values between two bounds are counted in bins of equal
width, the bin that holds the rank gives the next bounds, and how many values lie below
them is known exactly. No task ever holds the values of a group, only counts of bins; a few
rounds leave values that are few or all alike, and among these the rank is picked.
Values are binned as doubles and picked as what they are, so that decimals and large
whole numbers keep every digit.

Null values do not count; not-a-number is the greatest value; a null key is a group of its own; groups
without values have no row; an empty table gives an empty one (or, without keys, one row of
nulls from ``distribution``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.operators.tables import discard, stored

#: Bins of a round; values between bounds that are picked among at once; rows of bounds that are broadcast.
BINS, FEW, BROADCAST = 1024, 100_000, 500_000


def _double(value: Column) -> Column:
    d = value.cast("double")
    return F.when(F.isnan(d), F.lit(float("inf"))).otherwise(d)


def _bin(d: Column, lo: Column, hi: Column) -> Column:
    """0 to ``BINS`` - 1, growing with ``d``; the bounds themselves lie in different bins."""
    far = (hi == float("inf")) | (lo == float("-inf"))
    share = (d / 2 - lo / 2) / (hi / 2 - lo / 2)
    near = F.least(F.floor(share * BINS).cast("int"), F.lit(BINS - 1))
    return F.when(lo == hi, 0).when(far & (d == hi), BINS - 1).when(far & (d == lo), 0).when(far, 1).otherwise(near)


def _same(by: Sequence[str], t: DataFrame, bounds: DataFrame) -> Column:
    return reduce(lambda a, c: a & t[c].eqNullSafe(bounds[f"_{c}"]), by, F.lit(True))


def percentiles(df: DataFrame, value: str, wanted: Sequence[float], *, by: Sequence[str] = ()) -> DataFrame:
    """(by, p, value): the least value that a part ``p`` of the group's values does not pass."""
    t = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value"), _double(F.col(value)).alias("_d"))
    keys = [f"_{c}" for c in by]
    size = t.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("_inside"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).filter("_inside > 0")
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_inside"))).alias("r")) for p in wanted])
    bounds = size.select(*keys, F.explode(ranks).alias("x"), "_inside", "_lo", "_hi").select(*keys, F.col("x.p").alias("_p"), F.col("x.r").alias("_rank"), F.lit(0).cast("long").alias("_below"), "_inside", "_lo", "_hi")
    bounds = stored(bounds, "bounds")
    wide = "_inside > {} AND _lo < _hi"
    while not (todo := bounds.filter(wide.format(FEW))).isEmpty():
        few = todo.limit(BROADCAST + 1).count() <= BROADCAST
        within = t.join(F.broadcast(todo) if few else todo, _same(by, t, todo) & F.col("_d").between(F.col("_lo"), F.col("_hi")))
        key = [*keys, "_p", "_rank", "_below"]
        bins = within.groupBy(*key, _bin(F.col("_d"), F.col("_lo"), F.col("_hi")).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
        upto = F.sum("_n").over(W.partitionBy(*key).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
        bins = bins.withColumn("_to", F.col("_below") + upto).filter("_to >= _rank AND _to - _n < _rank")
        next_ = bins.select(*keys, "_p", "_rank", (F.col("_to") - F.col("_n")).alias("_below"), F.col("_n").alias("_inside"), "_lo", "_hi")
        narrowed = stored(bounds.filter(f"NOT ({wide.format(FEW)})").unionByName(next_), "bounds")
        discard(bounds)
        bounds = narrowed
    few = bounds.limit(BROADCAST + 1).count() <= BROADCAST
    left = t.join(F.broadcast(bounds) if few else bounds, _same(by, t, bounds) & F.col("_d").between(F.col("_lo"), F.col("_hi")))
    counts = left.groupBy(*keys, "_p", "_rank", "_below", "_value").agg(F.count("*").alias("_n"))
    upto = F.col("_below") + F.sum("_n").over(W.partitionBy(*keys, "_p").orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    out = counts.withColumn("_to", upto).filter("_to >= _rank AND _to - _n < _rank")
    return out.select(*[F.col(f"_{c}").alias(c) for c in by], F.col("_p").alias("p"), F.col("_value").alias("value"))


#: Groups of at most so many values are sorted where they meet.
SORTED = 1_000_000


def distribution(df: DataFrame, value: str, *, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, min, max, mean, p50, p95, p99): n and nearest-rank percentiles of each group, however large it is."""
    c = F.col(value)
    told = [F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean")]
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    largest = df.groupBy(*by).agg(F.count(c).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= SORTED:
        pick = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(name) for name, p in names.items()]
        return df.groupBy(*by).agg(*told, *pick)
    t = df.groupBy(*by).agg(*told)
    found = percentiles(df, value, list(names.values()), by=by)
    wide = found.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for name, p in names.items()])
    wide = stored(wide, "percentiles")
    return t.join(wide, _same(by, t, wide), "left").select(*by, "n", "min", "max", "mean", *names)
