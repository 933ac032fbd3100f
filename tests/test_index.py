"""The stored term index, the exact search in blocks, and the approximate index against it."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions.text import cosine_distance
from lodeworks.operators import ann, evaluate, retrieval, terms
from lodeworks.operators.terms import TermIndex

SF = "/root/testdata/sf0.01"


SPLIT = re.compile(r"[^\w]+|_")


def plain_bm25(docs, asked, k=None):
    """{(query, key): score}, of the best ``k`` and what ties with the last of them."""
    cut = [(i, Counter(w for w in SPLIT.split((t or "").lower()) if w)) for i, t in docs]
    mean, df = sum(sum(c.values()) for _, c in cut) / len(cut), Counter(w for _, c in cut for w in c)
    out = {}
    for q, text in asked.items():
        ws, own = {w for w in SPLIT.split(text.lower()) if w}, {}
        for i, c in cut:
            if found := [w for w in ws if c[w]]:
                own[i] = round(sum(math.log(1 + (len(cut) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in found), 6)
        last = sorted(own.values(), reverse=True)[: k or len(own)]
        out |= {(q, i): s for i, s in own.items() if s >= last[-1]}
    return out


def told(df):
    rows = df.collect()
    out = {(r["query_id"], r["doc_id"]): round(r["score"], 6) for r in rows}
    assert len(out) == len(rows)
    return out


def frames(spark, docs, asked):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(asked.items()), "query_id int, query string")


def test_index_scores_by_plain_bm25(spark, monkeypatch):
    docs = [(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, "delta alpha alpha alpha"), (5, None)]
    asked = {7: "Alpha, beta beta!", 8: "nothing here", 9: "gamma"}
    d, q = frames(spark, docs, asked)
    index = TermIndex.build(d, key="doc_id", text="text")
    for limit in (20_000, 0):
        monkeypatch.setattr(terms, "ASKED", limit)
        assert told(index.scores(q)) == pytest.approx(plain_bm25(docs, asked))
        assert told(index.best(q, 1)) == pytest.approx(plain_bm25(docs, asked, 1))
    empty = TermIndex.build(d.limit(0), key="doc_id", text="text")
    assert empty.scores(q).count() == 0 and empty.best(q, 3).count() == 0
    assert index.best(q.limit(0), 3).count() == 0


def corpus(n=900):
    rng = random.Random(2)
    words, odds = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, odds, k=rng.choice([3, 8, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize("most", [20_000, 0])
def test_bounds_lose_nothing(spark, monkeypatch, most):
    """The best of each question with slots passed over, against all scores; rare, common and unknown terms, ties at the end."""
    docs = corpus() + [(5000 + i, "w390 w391") for i in range(9)]
    asked = {0: "w0 w1", 1: "w399", 2: "w390", 3: "w5 w77 w300", 4: "none", 5: " ".join(f"w{i}" for i in range(60))}
    d, q = frames(spark, docs, asked)
    for name, value in (("ASKED", most), ("UNBOUNDED", 0), ("FIRST", 1)):
        monkeypatch.setattr(terms, name, value)
    index = TermIndex.build(d, key="doc_id", text="text", slot=16, folder=300)
    for k in (1, 5, 40):
        assert told(index.best(q, k)) == pytest.approx(plain_bm25(docs, asked, k))
    t, few, _ = index._told(q, "query_id", "query")
    hits = index._narrow(index.blocks, few).join(t, ["folder", "term"])
    monkeypatch.setattr(terms, "FIRST", 6)
    short = [r for r in index.slots(hits, 5, "query_id", 6).collect() if r["_q"] in (0, 3)]
    assert sum(r["_floor"] is not None and r["_bound"] < r["_floor"] for r in short) > len(short) / 4


def test_only_asked_folders_are_opened(spark):
    d, q = frames(spark, corpus(), {0: "w7"})
    index = TermIndex.build(d, key="doc_id", text="text", slot=16, folder=300)
    t, few, _ = index._told(q, "query_id", "query")
    narrow = index._narrow(index.blocks, few)
    plan = narrow._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and re.search(r"PushedFilters: \[[^\]]*term,w7", plan)
    read = {r[0] for r in narrow.select(F.input_file_name()).distinct().collect()}
    assert index.folders > 20 and len(read) < len(index.blocks.inputFiles()) / 10


def test_an_index_is_found_again_until_its_files_change(spark, tmp_path):
    at = f"{tmp_path}/docs.parquet"
    spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string").write.parquet(at)
    read = lambda: spark.read.parquet(at).select("doc_id", "text")
    first = TermIndex.build(read(), key="doc_id", text="text")
    assert TermIndex.build(read(), key="doc_id", text="text").blocks.inputFiles() == first.blocks.inputFiles()
    assert TermIndex.build(read().filter("doc_id = 1"), key="doc_id", text="text").n == 1
    spark.createDataFrame([(3, "alpha beta")], "doc_id long, text string").write.mode("append").parquet(at)
    assert TermIndex.build(read(), key="doc_id", text="text").n == 3
    kept = TermIndex.build(read(), key="doc_id", text="text", path=f"{tmp_path}/index")
    again = TermIndex.open(spark, f"{tmp_path}/index")
    assert (again.n, again.total, again.key) == (kept.n, kept.total, "doc_id") == (3, 4, "doc_id")


def test_exact_search_in_blocks(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").union(spark.createDataFrame([(-1, [0.0] * 64), (-2, None)], "vec_id long, embedding array<float>"))
    v = v.union(v.filter("vec_id BETWEEN 0 AND 19").withColumn("vec_id", F.col("vec_id") + 10_000))
    q = v.filter("vec_id % 90 = 0").select(F.col("vec_id").cast("int").alias("q"), "embedding")
    x = v.crossJoin(q.withColumnRenamed("embedding", "e")).filter("vec_id > -1").select("q", "vec_id", F.round(cosine_distance(F.col("embedding"), F.col("e")), 9).alias("distance"))
    want = sorted(map(tuple, retrieval.ranked(x, [F.col("distance"), F.col("vec_id")], 7, by="q").select("q", "vec_id", "rank").collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 50)
    got = retrieval.dense_many(v, q, key="vec_id", query="q", k=7)
    assert sorted(map(tuple, got.select("q", "vec_id", "dense_rank").collect())) == want
    assert retrieval.dense_many(v, q.limit(0), key="vec_id", query="q").count() == 0 and retrieval.dense_many(v.limit(0), q, key="vec_id", query="q").count() == 0


def recall(spark, v, q, key, k=50):
    cells = ann.Cells.build(v, key=key)
    exact = retrieval.dense_many(v, q, key=key, query="q", k=k)
    return evaluate.overlap(exact, cells.nearest(q, query="q", k=k), by="q", key=key).agg(F.avg("overlap")).first()[0], cells.measured(q, query="q")


def test_approximate_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    found, (_, exact) = recall(spark, v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding"), "vec_id")
    assert found >= 0.9 and exact < 0.7


def test_vectors_in_groups_need_few_cells(spark):
    rng = np.random.default_rng(3)
    groups = rng.standard_normal((60, 32))
    rows = [(n, (groups[n % 60] + 0.3 * rng.standard_normal(32)).tolist()) for n in range(6000)]
    v = spark.createDataFrame(rows, "k long, embedding array<double>")
    q = v.filter("k % 50 = 0").select(F.col("k").alias("q"), "embedding")
    found, (looked, exact) = recall(spark, v, q, "k")
    assert found >= 0.9 and looked < 0.2 and exact < 0.05
    # One query opens the folders of its cells only.
    cells = ann.Cells.build(v, key="k")
    one = q.filter("q = 100")
    asked = set(cells.model.nearest_cells(retrieval.unit(np.array([one.first()["embedding"]])))[0].tolist())
    plan = cells.codes.filter(F.col("cell").isin(sorted(asked)))
    read = {r[0] for r in plan.select(F.input_file_name()).distinct().collect()}
    assert len(read) < 0.2 * len(cells.codes.inputFiles()) and {int(f.split("cell=")[1].split("/")[0]) for f in read} <= asked


def test_nothing_to_search(spark):
    v = spark.createDataFrame([], "k long, embedding array<double>")
    cells = ann.Cells.build(v, key="k")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, embedding array<double>")
    assert cells.nearest(q.limit(0), query="q").count() == 0 and cells.measured(q.limit(0), query="q") == (0.0, 0.0)
    assert cells.nearest(q, query="q").count() == 0
