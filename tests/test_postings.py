"""Postings counted where their passage is, and blocks cut from them in order."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodeworks.operators import terms


def test_blocks_go_over_the_ends_of_batches():
    rows = [(0, "a", 1, 5, 2, 9), (0, "a", 1, 6, 1, 3), (0, "a", 2, 5, 1, 9), (0, "b", 2, 7, 4, 4), (1, "c", 0, 1, 1, 1), (1, "c", 0, 2, 3, 8), (1, "c", 0, 9, 2, 5)]
    names = ["folder", "term", "slot", "key", "tf", "dl"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    want = [
        (0, "a", 1, 2, 2, 3, [5, 6], [2, 1], [9, 3]), (0, "a", 2, 1, 1, 9, [5], [1], [9]), (0, "b", 2, 1, 4, 4, [7], [4], [4]), (1, "c", 0, 3, 3, 1, [1, 2, 9], [1, 3, 2], [1, 8, 5]),
    ]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[n : n + size], strict=True), types, strict=True)], names) for n in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in terms.in_blocks(iter(batches)) for r in b.to_pylist()]
        assert got == want
    assert list(terms.in_blocks(iter([]))) == []


def test_terms_are_counted_without_moving_them(spark):
    t = spark.createDataFrame([(1, 7, ["a", "b", "a"]), (2, 7, []), (3, 8, ["b"])], "key long, slot long, t array<string>")
    out = terms.counted(t)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 7, 1, 3, 2), ("b", 7, 1, 3, 1), ("b", 8, 3, 1, 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_passages_that_share_key_and_length_count_as_one(spark, tmp_path):
    t = spark.createDataFrame([(1, "x y"), (1, "x z"), (1, "x"), (2, "y")], "id long, text string")
    index = terms.TermIndex.build(t, key="id", text="text", path=f"file://{tmp_path}/i")
    held = {(r["term"], k, tf, dl) for r in index.blocks.collect() for k, tf, dl in zip(r["keys"], r["tfs"], r["dls"], strict=True)}
    assert held == {("x", 1, 2, 2), ("y", 1, 1, 2), ("z", 1, 1, 2), ("x", 1, 1, 1), ("y", 2, 1, 1)}
    assert {r["term"]: r["df"] for r in index.words.collect()} == {"x": 2, "y": 2, "z": 1} and index.n == 4 and index.total == 6
    assert index.blocks.filter(F.size("keys") != F.col("n")).isEmpty()
