"""Codes against plain k-means in whole numbers, the bounds against distances, and hard rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _x int"


def plain(rows, scale=1024, parts=4, entries=256, rounds=4):
    """{(id, label): (code, error)}, label errors and the digest; ``rows`` in order of id."""
    x = [np.floor(np.array(v, np.float32).astype(float) * scale).astype(int) for _, v, _ in rows]
    cut = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for v in x] for p in range(parts)]
    books = [[v.copy() for v in c[:entries]] for c in cut]
    assign = lambda p: [min((int(((v - e) ** 2).sum()), n) for n, e in enumerate(books[p])) for v in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            own = assign(p)
            for n in range(len(books[p])):
                if mine := [v for v, (_, m) in zip(cut[p], own, strict=True) if m == n]:
                    books[p][n] = sum(mine) // len(mine)
    last = [assign(p) for p in range(parts)]
    codes = ["".join(f"{last[p][i][1]:02x}" for p in range(parts)) for i in range(len(x))]
    errors = [sum(last[p][i][0] for p in range(parts)) for i in range(len(x))]
    total = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] = total.get(label, 0) + e
    said = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e.tolist()).encode()).hexdigest()
    return sorted((str(i), c, e, total[label], said) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))


def got(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def vectors(n, d, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) * spread).astype(np.float32)
    x[n // 3 : n // 2] = x[0]
    return [(i, x[i].tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize(("n", "d", "entries"), [(500, 64, 256), (300, 8, 16), (40, 4, 256), (200, 12, 7)])
def test_equal_to_plain_means(spark, monkeypatch, n, d, entries):
    rows = vectors(n, d)
    monkeypatch.setattr(vector_codes, "BLOCK", 33)
    assert got(vector_codes.compress(frame(spark, rows).repartition(3), entries=entries)) == plain(rows, entries=entries)


def test_bounds_never_drop_the_nearest():
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 4, 6, 16, 20):
        for size in (3, 1000, 1 << 26):
            v, book = rng.integers(-size, size + 1, (300, d)), rng.integers(-size, size + 1, (90, d))
            book[50:60], v[:20] = book[:10], book[30:50]
            dist = ((v[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
            j, best, measured = vector_codes.nearest(v, book)
            assert (best == dist.min(1)).all() and (j == dist.argmin(1)).all() and measured <= dist.size
    groups = rng.integers(-500, 500, (64, 16))
    near = np.repeat(groups, 20, axis=0) + rng.integers(-20, 20, (1280, 16))
    assert vector_codes.nearest(near, groups)[2] < 2 * len(near)


def test_hard_rows(spark, monkeypatch):
    good = [(3, [0.5, -0.25, 0.1, 0.0], None), (7, [1.0, 1.0, 1.0, 1.0], 2), (7, [1.0, 1.0, 1.0, 1.0], 2), (9, [-1.0, 0.0, 0.0, 3.0], None), (None, [0.0, 0.0, 0.0, 0.1], 2)]
    bad = [(1, None, 1), (2, [0.1, None, 0.1, 0.1], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1), (6, [0.0, 0.0, 0.0, float("-inf")], None)]
    want = plain(good)
    assert got(vector_codes.compress(frame(spark, bad + good))) == want
    monkeypatch.setattr(vector_codes, "BROADCAST_KEYS", 0)
    assert got(vector_codes.compress(frame(spark, good[::-1] + bad))) == want
    assert vector_codes.compress(frame(spark, bad)).count() == 0 and vector_codes.compress(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame(spark, [(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)]))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(frame(spark, [(1, [1e9] * 4, 1)])).count()


def test_text_labels_and_other_names(spark):
    rows = vectors(30, 8)
    d = frame(spark, rows).select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("label") > 0, F.col("label").cast("string")).alias("l"))
    out = vector_codes.compress(d, key="k", vector="v", label="l", parts=2, entries=4, rounds=1).withColumnRenamed("k", "vec_id")
    assert got(out) == plain([(i, v, label or None) for i, v, label in rows], parts=2, entries=4, rounds=1)
