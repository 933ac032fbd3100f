"""Rows that may be near by their codes are measured where they lie: a search moves k rows of each query and task, no lists of rows to be measured."""

import numpy as np
from pyspark.sql import functions as F

from lodeworks.operators import ann, retrieval
from tests.sizes import most_rows


def test_a_search_moves_no_short_lists(spark):
    x = np.random.default_rng(4).standard_normal((4000, 24)).astype(np.float32)
    v = spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(x)] + [(None, [1.0] * 24), (9000, None), (9001, [0.0] * 24)], "k long, embedding array<float>")
    q = v.filter("k % 50 = 0 AND k < 4000").select(F.col("k").alias("q"), "embedding")
    cells = ann.Cells.build(v, key="k")
    assert cells.rows.count() == 4000 and cells.rows.schema["v"].dataType.elementType.typeName() == "float"
    # 80 queries; without structure each has hundreds of rows that may be near.
    assert most_rows(spark, lambda: cells.nearest(q, query="q", k=5)) < 8000
    exact = {(r["q"], r["k"]): r["distance"] for r in retrieval.dense_many(v, q, key="k", query="q", k=5).collect()}
    near = {(r["q"], r["k"]): r["distance"] for r in cells.nearest(q, query="q", k=5).collect()}
    assert len(near) == len(exact) == 400
    assert sum(abs(near.get(pair, 9.0) - d) < 1e-8 for pair, d in exact.items()) >= 360
