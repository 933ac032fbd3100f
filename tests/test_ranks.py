"""Nearest-rank percentiles against sorting."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import ranks


def plain(rows, wanted):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    key = lambda v: (isinstance(v, float) and math.isnan(v), v)
    return {(g, p): sorted(vs, key=key)[max(1, math.ceil(p * len(vs))) - 1] for g, vs in groups.items() for p in wanted}


WANTED = [0.0, 0.001, 0.5, 0.95, 0.999, 1.0]


@pytest.mark.parametrize(("bins", "few", "broadcast"), [(1024, 100_000, 1000), (4, 3, 1000), (2, 1, 0)])
def test_percentiles(spark, monkeypatch, bins, few, broadcast):
    for name, value in (("BINS", bins), ("FEW", few), ("BROADCAST", broadcast)):
        monkeypatch.setattr(ranks, name, value)
    rng = random.Random(6)
    rows = [("a", rng.gauss(0, 1)) for _ in range(200)] + [("same", 5.0)] * 50 + [("ties", float(rng.randrange(4))) for _ in range(90)] + [("one", -1.5), ("none", None), (None, 2.0), (None, 3.0)]
    rows += [("wide", x) for x in (1e308, -1e308, 1e-300, 0.0, float("inf"), float("-inf"), 5e-324, 7.0, 7.0)] + [("odd", x) for x in (float("nan"), float("inf"), 1.0, float("nan"))]
    got = {(r["g"], r["p"]): r["v2"] for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", WANTED, by=["g"]).withColumnRenamed("value", "v2").collect()}
    want = plain(rows, WANTED)
    assert set(got) == set(want) and all(got[k] == want[k] or math.isnan(got[k]) and math.isnan(want[k]) for k in want)


def test_every_digit_is_kept(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 2)
    rows = [(None, Decimal("90071992547409920") + Decimal(i)) for i in range(64)]
    df = spark.createDataFrame(rows, "g string, v decimal(20,0)")
    got = {r["p"]: r["value"] for r in ranks.percentiles(df, "v", [0.25, 0.5]).collect()}
    assert got == {p: v for (_, p), v in plain(rows, [0.25, 0.5]).items()}
    assert ranks.percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_one_group_of_all_rows(spark, monkeypatch):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("g", F.lit("all"))
    want = [tuple(r) for r in ranks.distribution(li, "l_extendedprice", by=["g"]).collect()]
    monkeypatch.setattr(ranks, "SORTED", 0)
    monkeypatch.setattr(ranks, "FEW", 10)
    for by in (["g"], []):
        got = [tuple(r) for r in ranks.distribution(li, "l_extendedprice", by=by).collect()]
        assert [r[-7:] for r in got] == [pytest.approx(r[-7:]) for r in want]
    assert [r["n"] for r in ranks.distribution(li.limit(0), "l_extendedprice").collect()] == [0]
