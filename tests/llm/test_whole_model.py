"""The language model: its size, its exact head, its steps, and the same scores on any cluster."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import maxent_lm as m

SF = "/root/testdata/sf0.001"


def test_classes_features_and_head():
    assert (m.CLASSES, m.DIMS, m.HEAD) == (64, 256, 1 << 20)
    rows = [m.contexts([np.array([first, 7, 8, 9], np.uint32).tobytes()], np.zeros(16, np.uint8), m.ROWS)[0] for first in (5, 6, m.HEAD + 64, m.HEAD + 128)]
    assert rows[0].shape == (4, 5)
    for a, b in ((0, 1), (2, 3)):
        assert (rows[a][3] != rows[b][3]).sum() == 1, "the last word sees the word three before it, one outside the head too"


def test_classes_of_codes():
    code = np.array([0, 1, 2, m.HEAD + (5 << 6 | 41), m.HEAD + (((1 << 25) - 1) << 6 | 63)], np.uint32)
    assert m.contexts([code.tobytes()], np.array([7, 8, 9], np.uint8), m.ROWS)[1].tolist() == [7, 8, 9, 41, 63]


def test_step_is_the_gradient():
    rng = np.random.default_rng(1)
    w, seen, bias = rng.normal(size=(32, m.CLASSES)).astype(np.float32), np.arange(32), rng.normal(size=m.CLASSES).astype(np.float32)
    rows, c = rng.integers(0, 32, (100, 5)), rng.integers(0, m.CLASSES, 100)
    z = w[rows].sum(1) + bias
    p = np.exp(z - z.max(1, keepdims=True))
    g = p / p.sum(1, keepdims=True) - np.eye(m.CLASSES)[c]
    n = np.bincount(rows.ravel(), minlength=32) + seen
    want = w.astype(float)
    # Features are added one after another, each with the rate of all that was seen.
    for r, x in zip(rows, g, strict=True):
        for k in r:
            want[k] -= x * m.RATE / (m.CALM + n[k])
    m.step(w, seen, bias, rows, c)
    assert np.abs(w - want).max() < 1e-4 and (seen == n).all()


def test_words(spark):
    texts = [None, "", " \n\t ", "A bC\x0bd\x0c É", "\x1cx\x85y\xa0z ", "x"]
    words, size = m.words_of(pa.array(texts))
    assert [w.as_py().encode() for w in words] == [w for t in texts for w in (t or "").encode().lower().split()]
    assert size.tolist() == [len((t or "").encode().split()) for t in texts]


@pytest.mark.parametrize("most", (0, 1, 37, 500, 999, 1000, 5000))
def test_commonest_is_exact(spark, most):
    rows = [(n * 7919 % 1009, 100_000 if n < 600 else 70_000 + n if n < 800 else n % 50 + 1, n % 64) for n in range(1000)]
    t = m.commonest(spark.createDataFrame(rows, "hash long, c long, cls int"), most, "hash")
    assert sorted(t.column("hash").to_pylist()) == sorted(r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))[:most])


def test_model_grows():
    sizes = [m.grown(n) for n in (0, 1 << 25, 1 << 27, 1 << 29, 1 << 31, 1 << 45)]
    assert sizes == sorted(sizes) and sizes[0] == (m.ROWS, 1) and sizes[2][0] == 2 * m.ROWS and sizes[-1] == (m.MAX_ROWS, m.MAX_SHARDS)


def test_same_scores_on_any_cluster(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tables = [{r["doc_id"]: r for r in m.score(x).collect()} for x in (d.coalesce(1), d.repartition(7, F.col("text")).orderBy(F.col("doc_id").desc()))]
    for i, r in tables[0].items():
        assert r["score"] == pytest.approx(tables[1][i]["score"], rel=1e-6) and r["base_score"] == pytest.approx(tables[1][i]["base_score"])
