"""Mined negatives against scoring all pairs, the bounds, and hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, _row long, rank string"


def plain(rows, scale=256, every=100, positives=5, negatives=5, percent=80):
    """All pairs in whole numbers."""
    x = [np.floor(np.array(v, np.float32).astype(float) * scale).astype(int) for _, v, _ in rows]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        scored = sorted(((-int(x[a] @ x[b]), last(i), b) for b, (i, _, _) in enumerate(rows) if b != a))
        for s, _, p in [t for t in scored if rows[t[2]][2] == label][:positives]:
            near = [(n, i) for n, _, i in scored if rows[i][2] != label and percent * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(anchor, rows[p][0], rank, rows[i][0], -s, -n) for rank, (n, i) in enumerate(near, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)


def vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) * 0.2).astype(np.float32)
    x[n // 3 : n // 2] = x[1]
    return [(i, x[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "every", "cells"), [(600, 64, 20, 64), (300, 5, 10, 4), (300, 16, 7, 1), (90, 1, 3, 512)])
def test_equal_to_all_pairs(spark, monkeypatch, n, d, every, cells):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 17)
    monkeypatch.setattr(hard_negatives, "ROWS", 41)
    rows = vectors(n, d)
    want = plain(rows, every=every)
    assert want and got(hard_negatives.mine(frame(spark, rows).repartition(3), every=every, cells=cells)) == want


def test_bounds_hold_the_score():
    rng = np.random.default_rng(4)
    x, cells = rng.integers(-500, 900, (400, 12)), 16
    least = x.min(0)
    g = hard_negatives.Grid(least, (x.max(0) - least) // cells + 1)
    assert g.cells(x).max() < cells and g.cells(x).min() == 0
    for a in x[:50]:
        table, more = g.table(a, cells)
        low = table[np.arange(12), g.cells(x)].sum(1)
        assert (low <= x @ a).all() and (x @ a <= low + more).all() and more > 0


def test_hard_rows(spark):
    good = [(0, [0.5, 0.5], 1), (1, [0.4, 0.5], 1), (1, [0.4, 0.5], 1), (2, [0.4, 0.5], 2), (None, [0.4, 0.5], 2), (3, [0.4, 0.45], 2), (100, [-1.0, 0.0], 1), (200, [0.0, 0.0], 3), (200, [0.0, 0.0], 3), (4, [0.3, 0.3], 1)]
    bad = [(5, None, 1), (300, None, 1), (6, [0.5, None], 2), (7, [float("nan"), 1.0], 2), (8, [float("inf"), 0.0], 2), (9, [0.5, 0.5], None), (400, [0.5, 0.5], None)]
    want = plain(good)
    assert any(r[3] is None for r in want) and got(hard_negatives.mine(frame(spark, good + bad))) == want
    assert hard_negatives.mine(frame(spark, bad)).count() == 0 and hard_negatives.mine(frame(spark, good).limit(0)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        hard_negatives.mine(frame(spark, [(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)]))
    assert hard_negatives.mine(frame(spark, [(100, [], 1), (1, [], 1), (2, [], 2)])).count() == 1


def test_other_names(spark):
    rows = vectors(80, 4)
    d = frame(spark, rows).select(F.col("vec_id").cast("int").alias("k"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("l"))
    assert got(hard_negatives.mine(d, key="k", vector="v", label="l", scale=100, every=9, positives=3, negatives=2, percent=50)) == plain(rows, 100, 9, 3, 2, 50)
