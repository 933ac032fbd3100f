import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import chunking
from lodeworks.operators import service, store
from lodeworks.sources import cases, models, names


def test_breaker():
    now = [0.0]
    b = models.Breaker(2, 30, lambda: now[0])
    for _ in range(2):
        with pytest.raises(models.Unavailable):
            b.call(lambda: 1 / 0)
    with pytest.raises(models.Unavailable, match="open"):
        b.call(lambda: 1)
    now[0] = 31
    assert b.call(lambda: 1) == 1


def test_names():
    raw = ["Отчёт за март.pdf".encode("cp866"), "Договор аренды.doc".encode("cp866")]
    assert names.decode_names(raw) == (["Отчёт за март.pdf", "Договор аренды.doc"], "cp866")
    assert names.decode_names([b"a.txt"]) == (["a.txt"], "")
    assert names.decode_names([b"\xff\xfe\x81\x8d.x"])[1] == "replaced"


def _stored(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "alpha  beta gamma"), (4, "zeta")], "doc_id long, text string").withColumn("status", F.lit("COMPLETED"))
    cut = chunking.chunk(docs)
    chunks, placements = store.replace_chunks(
        spark.createDataFrame([], "chunk_id string, embed_model string, raw_sha256 string, chunk_text string"),
        spark.createDataFrame([], "placement_id string, doc_id long, chunk_id string, chunk_index int, start_byte int, end_byte int, slice_sha256 string"), cut, "m",
    )
    return docs, cut, chunks, placements


def test_passages_are_shared_and_replaced(spark):
    docs, cut, chunks, placements = _stored(spark)
    assert chunks.count() == 3 and placements.count() == 4 and store.new_passages(cut, chunks, "m").count() == 0 and store.new_passages(cut, chunks, "other").count() == 3
    new = chunking.chunk(spark.createDataFrame([(2, "eta theta")], "doc_id long, text string"))
    c2, p2 = store.replace_chunks(chunks, placements, new, "m")
    assert p2.count() == 4 and {r["chunk_text"] for r in c2.collect()} == {"alpha beta gamma", "eta theta", "zeta"}
    edges = spark.createDataFrame([(1, 3, datetime(2024, 1, 1)), (2, 3, datetime(2024, 1, 2))], "container_id long, contained_id long, first_seen_at timestamp")
    d = docs.withColumn("parent_doc_id", F.when(F.col("doc_id") == 3, F.lit(1).cast("long")))
    got = store.delete_documents(d, edges, placements, chunks, spark.createDataFrame([(1,)], "doc_id long"))
    assert {r["doc_id"]: r["parent_doc_id"] for r in got[0].collect()} == {2: None, 3: 2, 4: None} and got[1].count() == 1 and got[3].count() == 3
    assert store.link(edges, edges).count() == 2
    with pytest.raises(RuntimeError):
        store.prune_plan(docs, edges, spark.createDataFrame([], "sha string"), None, backfilled=True)
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, first int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k int, v string, first int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], keep=("first",)).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 9)]


def test_search(spark):
    docs, _, chunks, placements = _stored(spark)
    vectors = models.embed(chunks, models.hashed_embedding, key="chunk_id", text="chunk_text", dim=64)
    edges = spark.createDataFrame([(1, 2), (4, 1)], "container_id long, contained_id long")
    t = service.Tables(placements, chunks.join(vectors, "chunk_id"), docs, edges)
    got = service.search("alpha beta", t, embed=models.hashed_embedding, scorer=lambda q, ts: [float("alpha" in x) - 0.5 for x in ts])
    assert [p.match.doc for p in got.packets] in (["1"], ["3"]) and "dense_leg_underfill" in got.warnings
    if got.packets[0].match.doc == "1":
        assert {(r["doc"], r["relation"]) for r in got.packets[0].related} == {("2", "attachment"), ("4", "parent")}
    got = service.search("alpha beta", t, embed=models.hashed_embedding, top_k=2, budget=10)
    assert "rerank_unavailable" in got.warnings and "budget_truncated" in got.warnings
    with pytest.raises(ValueError):
        service.search(" ", t, embed=models.hashed_embedding)


def test_snapshots():
    now = [0.0]
    s = service.Snapshots(2, 100, 10, lambda: now[0])
    a, b = s.put(["a" * 40]), s.put(["b" * 40])
    assert s.page(a, 0, 0, 30) == ("a" * 30, 30)
    s.put(["c" * 40])
    with pytest.raises(KeyError):
        s.page(b, 0)
    now[0] = 11
    with pytest.raises(KeyError):
        s.page(a, 0)


def test_cases(spark, tmp_path):
    one = {"id": "a", "question": "q", "expected_documents": [{"match": {"raw_sha256": "s"}, "grade": 2}]}
    path = tmp_path / "c.json"
    for body, ok in (([one], True), ([one, one], False), ([one | {"expected_empty": True}], False), ([one | {"question": ""}], False)):
        path.write_text(json.dumps({"version": 6, "cases": body}))
        if ok:
            assert [tuple(r) for r in cases.expected(cases.load(spark, str(path))).collect()] == [("a", "s", 2)]
        else:
            with pytest.raises(ValueError):
                cases.load(spark, str(path))
    report = spark.createDataFrame([(1,)], "x int")
    cases.archive(report, str(tmp_path / "r"), "1")
    with pytest.raises(Exception):
        cases.archive(report, str(tmp_path / "r"), "1")
