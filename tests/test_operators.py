from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import evaluate, graph, jobs, mailbox, ranks, retrieval
from lodeworks.operators.retrieval import Candidate


def c(i, doc, text, score=1.0, **more):
    return Candidate(str(i), doc, text, score=score, **more)


def test_select_is_greedy_in_order():
    a, b, d = c(1, "d1", "t1"), c(2, "d2", "t1"), c(3, "d2", "t2")
    assert [x.placement for x in retrieval.select([a, b, d])[0]] == ["1", "3"]
    assert retrieval.select([c(i, str(i), str(i), s) for i, s in enumerate((-0.03, -0.092, -0.213))]) == ([], 3)
    picked, under = retrieval.select([c(i, str(i), str(i), s) for i, s in enumerate((0.5, 0.4, -0.1))])
    assert len(picked) == 2 and under == 1
    assert len(retrieval.select([c(1, "a", "x 1"), c(2, "b", "x 2")])[0]) == 2
    assert len(retrieval.select([c(1, "a", "x\n y"), c(2, "b", "x y")])[0]) == 1
    assert retrieval.select([c(1, "a", "x", 0.0)])[1] == 0


def test_pool_reserves_places():
    g = [[c(100 * q + i, f"{q}{i}", "t", rrf=1 / (q + i + 1), dense_rank=i + 1, lex_rank=1 if i < 3 else None) for i in range(12)] for q in range(2)]
    got, reserved = retrieval.pool(g)
    assert len(got) == 24 and reserved and len({x.placement for x in got}) == 24
    got, reserved = retrieval.pool(g[:1])
    assert len(got) == 12 and not reserved


def test_rerank_falls_back():
    rows, warning = retrieval.rerank("q", [c(1, "a", "x"), c(2, "b", "y")], lambda q, t: [0.1, 0.9])
    assert [r.placement for r in rows] == ["2", "1"] and not warning
    rows, warning = retrieval.rerank("q", [c(1, "a", "x")], lambda q, t: [])
    assert rows[0].score == 0 and warning == "rerank_unavailable"


def test_budget_takes_texts_whole():
    p, b = retrieval.packets([c(1, "a", "x"), c(2, "b", "y")], {"a": "u" * 60, "b": "v" * 60}, [], 100)
    assert [len(x.text) for x in p] == [60, 0] and b.used == 60 and b.truncated
    b = retrieval.Budget(0)
    assert b.admit("") == "" and not b.truncated
    p, _ = retrieval.packets([c(1, "a", "x")], {"a": "1", "r": "2"}, [{"anchor": "a", "doc": "r", "relation": "sibling"}, {"anchor": "a", "doc": "r", "relation": "parent"}])
    assert [r["relation"] for r in p[0].related] == ["parent"]


def test_sub_queries():
    assert retrieval.sub_queries(["1. closing balance", "- solicitor parenting", "* cruise"]) == ["closing balance", "solicitor parenting", "cruise"]
    assert len(retrieval.sub_queries(["A  b", "a B", "c"])) == 2 and len(retrieval.sub_queries(map(str, "abcdef"))) == 4
    assert retrieval.decompose("q", lambda q: 1 / 0) == (["q"], "decompose_unavailable")


def _box(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [("a", day(2)), ("b", day(2)), ("c", day(1)), ("d", None), ("e", None)]
    return spark.createDataFrame([(i, t, day(3), f"m{i}") for i, t in rows], "doc_id string, sent_at timestamp, ingested_at timestamp, message_id string")


def test_orders_are_reverses_and_pages_partition(spark):
    m = _box(spark)
    new = [r["doc_id"] for r in m.orderBy(*mailbox.page_order()).collect()]
    old = [r["doc_id"] for r in m.orderBy(*mailbox.page_order(False)).collect()]
    assert new == ["b", "a", "c", "e", "d"] == old[::-1]
    none = spark.createDataFrame([], "doc_id string, kind string, ordinal int, address string, valid boolean")
    for newest, want in ((True, new), (False, old)):
        got, at = [], None
        while True:
            page = mailbox.list_messages(m, none, now=datetime(2024, 1, 4), limit=2, newest=newest, at=at)
            got += [r["doc_id"] for r in page.rows]
            if not page.more:
                break
            at = page.cursor
        assert got == want


def test_cursor_belongs_to_its_request(spark):
    at = mailbox.cursor({"a": 1}, True, None, "d", datetime(2024, 1, 1))
    assert mailbox.read_cursor(at, {"a": 1}, True) == (None, "d", datetime(2024, 1, 1))
    for filters, newest in (({"a": 2}, True), ({"a": 1}, False)):
        with pytest.raises(ValueError):
            mailbox.read_cursor(at, filters, newest)
    with pytest.raises(ValueError):
        mailbox.read_cursor("!!", {}, True)


def test_page_bytes_rejoin():
    t = "абв\n\n" * 100
    got, at = "", 0
    while at is not None:
        part, at = mailbox.page_bytes(t, 101, at)
        assert len(part.encode()) <= 101
        got += part
    assert got == t


def test_shared_members_survive(spark):
    e = spark.createDataFrame([("A", "p"), ("A", "q"), ("A", "r"), ("B", "p"), ("B", "q"), ("B", "s"), ("s", "B")], "src string, dst string")
    docs = spark.createDataFrame([(x, x, "") for x in "ABpqrs"], "doc_id string, sha string, source_path string")
    staged = spark.createDataFrame([("A",)], "sha string")
    assert {r["doc_id"] for r in graph.unreachable(docs, e, staged).collect()} == {"B", "s"}
    gone = graph.forget_plan(docs, e, spark.createDataFrame([("B",)], "doc_id string"))
    assert "p" not in {r["doc_id"] for r in gone.collect()}


def test_routes_pass_cycles(spark):
    m = spark.createDataFrame([("f", "zip-v1:1", "x"), ("x", "mime-v1:1", "f")], "parent_id string, selector string, child_id string")
    o = spark.createDataFrame([("f", "/a/f", True), ("x", "/a/x", False)], "doc_id string, path string, available boolean")
    got = graph.routes(spark.createDataFrame([("x",)], "doc_id string"), m, o).orderBy("nth").collect()
    assert [(r["path"], list(r["selectors"])) for r in got] == [("/a/f", ["zip-v1:1"]), ("/a/x", [])]


def test_metrics(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    runs = spark.createDataFrame([("a", d, r) for r, d in enumerate(("1", "1", "2", "3"), 1)], "case_id string, doc_id string, rank int")
    want = spark.createDataFrame([("a", "1", 3), ("a", "x", 1)], "case_id string, doc_id string, grade int")
    got = {r["case_id"]: r for r in evaluate.scores(cases, runs, want, 2).collect()}
    assert got["a"]["recall"] == 0.5 and got["a"]["rr"] == 1 and 0 < got["a"]["ndcg"] < 1 and got["b"]["recall"] == 1
    d = ranks.distribution(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "v double"), "v").first()
    assert (d["n"], d["min"], d["max"], d["mean"], d["p50"], d["p95"]) == (5, 10, 50, 30, 30, 50)
    with pytest.raises(ValueError):
        evaluate.resolved(spark.createDataFrame([("s",)], "sha string"), spark.createDataFrame([("t", "d")], "sha string, doc_id string"))


def test_fences(spark):
    now = datetime(2024, 1, 1)
    row = ("j", "d", "RUNNING", 2, 3, now, now + timedelta(minutes=1), None, None)
    t = spark.createDataFrame([row], "job_id string, doc_id string, state string, generation long, attempts int, available_at timestamp, lease_until timestamp, finished_at timestamp, reason string")
    say = lambda g, o: spark.createDataFrame([("j", g, o, "OCR_FAILED")], "job_id string, generation long, outcome string, reason string")
    assert jobs.settle(t, say(1, "error"), now).first()["state"] == "RUNNING"
    assert jobs.settle(t, say(2, "error"), now).first()["state"] == "FAILED"
    got = jobs.settle(t, say(2, "busy"), now).first()
    assert (got["state"], got["attempts"], got["available_at"]) == ("READY", 2, now + timedelta(seconds=30))
    assert jobs.settle(t, say(2, "pruned"), now).count() == 0
    with pytest.raises(RuntimeError):
        jobs.recovered(t, t.select("doc_id", "job_id", "state", "generation"), now)
    later = now + timedelta(minutes=2)
    assert jobs.recovered(t, t.select("doc_id", "job_id", "state", "generation"), later).first()["state"] == "READY"


def test_claim_takes_one_expired_first(spark):
    now = datetime(2024, 1, 1)
    rows = [(f"r{i}", "s", "READY", now - timedelta(hours=i), now, None) for i in range(3)] + [("x", "s", "RUNNING", now, now, now - timedelta(hours=1)), ("y", "s", "RUNNING", now, now, now)]
    t = spark.createDataFrame(rows, "job_id string, subject string, state string, available_at timestamp, created_at timestamp, lease_until timestamp")
    assert [r["job_id"] for r in jobs.claimable(t, "s", 2, now).collect()] == ["x", "r2"]
    assert [r["job_id"] for r in jobs.claimable(t, "s", 1, now).collect()] == ["r2"]


def test_spans_with_folding(spark):
    docs = spark.createDataFrame([(1, "One  Two\nthree"), (2, None)], "doc_id int, text string")
    pins = spark.createDataFrame([(1, "two THREE"), (2, "")], "needle_id int, needle string")
    got = mailbox.needles_in(docs, pins, text=F.col("text"), key=["doc_id"], fold=True).collect()
    assert [(r["needle_id"], r["doc_id"], r["position"]) for r in got] == [(1, 1, 5)]
