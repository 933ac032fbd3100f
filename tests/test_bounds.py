"""What a task holds while it works: passages and decoded texts by their bytes, nearest rows by their number, buckets by their size."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions import chunking
from lodeworks.operators import evaluate, merges, retrieval
from lodeworks.sources import containers
from tests.sizes import most_rows


def test_what_many_cases_expect_stands_once_for_their_group(spark):
    n = 3000
    docs = spark.range(n).select((F.col("id") % 3).alias("label"), F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("grade"))
    cases = spark.range(300).select(F.col("id").alias("case_id"), F.when(F.col("id") % 4 < 3, F.col("id") % 4).alias("label"))
    runs = cases.select("case_id", F.explode(F.array(*map(F.lit, range(6)))).alias("doc_id")).withColumn("rank", F.col("doc_id") + 1)
    run = lambda: evaluate.scores(cases, runs, docs, 4, by="label")
    pairs = cases.join(docs, "label").select("case_id", "doc_id", "grade")
    want = evaluate.scores(cases, runs, pairs, 4)
    as_rows = lambda t: sorted(tuple(round(x, 9) for x in r) for r in t.collect())
    assert as_rows(run()) == as_rows(want)
    assert as_rows(evaluate.scores(cases, runs, docs, 0, by="label")) == as_rows(evaluate.scores(cases, runs, pairs, 0))
    # 225 cases times 1,000 documents would be 225,000.
    assert most_rows(spark, run) <= 2 * n


def test_the_query_of_case_scores_makes_no_pairs(spark, tmp_path):
    from lodeworks.plans import retrieval as plan

    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=4)], k % 2) for k in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    # 80 queries times 2,000 vectors of their label would be 160,000.
    assert most_rows(spark, lambda: plan.case_scores(spark, str(tmp_path))) <= 20_000


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_task_hands_on_k_rows_of_a_query(spark, kind):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(6000, 3)), 1)
    v[::2] = [1.0, 2.0, 3.0]  # ties by the thousand
    v[7] = 0.0
    keys = rng.permutation(6000)
    t = spark.createDataFrame([(int(k), [float(x) for x in r]) for k, r in zip(keys, v, strict=True)], "id long, embedding array<double>").select(F.col("id").cast(kind).alias("id"), "embedding").coalesce(2)
    q = t.filter("id IN (3, 10, 77, 1234)").select(F.col("id").alias("q"), "embedding")
    run = lambda: retrieval.dense_many(t, q, key="id", query="q", k=9)
    got, vector = {}, {k: x for k, x in zip(keys.tolist(), v, strict=True)}
    for r in run().collect():
        got.setdefault(int(r["q"]), []).append((r["dense_rank"], str(r["id"]), r["distance"]))
    for k, found in got.items():
        with np.errstate(invalid="ignore"):
            d = np.round(np.maximum(0, 1 - retrieval.unit(v) @ retrieval.unit(vector[k][None])[0]), 9)
        order = sorted((x, str(i) if kind == "string" else int(i)) for x, i in zip(d, keys, strict=True) if x == x)[:9]
        assert [(n, str(i)) for n, (_, i) in enumerate(order, 1)] == [(n, i) for n, i, _ in sorted(found)]
    assert len(got) == 4
    best = retrieval.Nearest(retrieval.unit(v[:50]), 9)
    for at in range(0, 6000, 1000):
        best.meet(retrieval.unit(v[at : at + 1000]), keys[at : at + 1000])
        assert len(best.at) <= 50 * 9


def test_rows_without_a_key_are_ranked_first(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0]), (None, None)], "id long, embedding array<double>")
    got = retrieval.dense_many(t, t.filter("id = 1").select(F.lit(5).alias("q"), "embedding"), key="id", query="q", k=2).orderBy("dense_rank").collect()
    assert [r["id"] for r in got] == [None, 1]


def test_passages_are_handed_on_in_pieces(spark):
    text = "word " * 20_000
    t = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string").coalesce(1)
    out = chunking.chunk(t)
    assert out.count() == 60 * out.filter("doc_id = 7").count() and out.filter("doc_id = 7").count() == len(list(chunking.split(text)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([text] * 60)], ["k", "t"])
    pieces = [sum(map(len, b.column(4).to_pylist())) for b in chunking.passages(iter([batch]), pa.int64())]
    assert len(pieces) > 5 and max(pieces) < chunking.HELD_CHARS + 2048
    odd = spark.createDataFrame([(1, None), (2, "  "), (None, "x"), (4, "é ")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["start_byte"], r["end_byte"], r["chunk_text"]) for r in chunking.chunk(odd).collect()) == [(0, 0, 1, "x"), (4, 0, 2, "é")]


def test_decoded_texts_are_handed_on_in_pieces(spark):
    made = containers.decoded.func(iter([(pa.array([b"x" * 300_000] * 40), pa.nulls(40, pa.string()))]))
    pieces = list(made)
    assert sum(map(len, pieces)) == 40 and max(map(len, pieces)) <= 4
    t = spark.createDataFrame([(1, b"a"), (2, None), (3, b"a\0"), (4, b"\xff\xfea\0")], "k long, raw binary")
    got = {r["k"]: tuple(r["r"]) for r in t.select("k", containers.decoded(F.col("raw"), F.lit(None).cast("string")).alias("r")).collect()}
    assert got == {1: ("a", "", None), 2: (None, None, None), 3: (None, None, "NUL_BYTES"), 4: ("a", "bom:utf-16-le", None)}


def test_delivery_meets_each_document_of_a_case_once(spark):
    runs = spark.createDataFrame([(1, 1, True, []), (1, 2, False, [1, 3]), (1, None, True, [None]), (2, 9, True, None)], "case_id long, doc_id long, own_text boolean, related array<long>")
    expected = spark.createDataFrame([(1, 1), (1, 1), (1, 3), (1, None), (2, 8), (3, 1)], "case_id long, doc_id long")
    got = {r["case_id"]: tuple(r)[1:] for r in evaluate.delivery(runs, expected).collect()}
    assert got == {1: (1 / 3, 2 / 3, 2 / 3), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert "Join" not in evaluate.delivery(runs, expected)._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_not_sent_to_all_to_resolve_hashes(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    got = evaluate.resolved(docs.select(F.col("doc_id").alias("case_id"), "sha"), docs)
    assert got.filter("case_id <> doc_id").count() == 0 and got.count() == 10
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_large_bucket_is_dealt_to_several_tasks(spark, tmp_path):
    held = merges.Bucketed(f"file://{tmp_path}/t", T.StructType.fromDDL("k long, x string"), ("k",), 2)
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        held.merge(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert held.read(spark).count() == 20_000 and len(held.current(spark)) == 2
    assert len(list(tmp_path.glob("t/data/*/bucket=0/*.parquet"))) > 1
