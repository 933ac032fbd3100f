"""Tables that are made once and read as they are: new documents of a scan, edges of a closure that is kept."""

from datetime import datetime

from lodeworks.operators import admission, graph


def test_new_documents_of_a_scan_are_found_once(spark):
    docs = spark.createDataFrame([], "doc_id string, raw_sha256 string, source_filename string, doc_type string, status string, reason string, updated_at timestamp")
    jobs = spark.createDataFrame([], "job_id string, doc_id string, subject string, revision string, state string, generation long, attempts int, available_at timestamp, created_at timestamp")
    seen = spark.createDataFrame([], "root_id string, relative_path string, doc_id string, available boolean")
    files = spark.createDataFrame([("b/x", "x.txt", b"words", "s"), ("a/x", "x.log", b"words", "s"), ("c", "c.txt", b"%PDF-1.7", "t")], "relative_path string, filename string, content binary, sha256 string")
    out = admission.admit(docs, jobs, seen, files, root_id="r", now=datetime(2026, 1, 1), complete=True)
    for t in out:
        assert "Window" not in t._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["raw_sha256"], r["source_filename"], r["doc_type"]) for r in out[0].collect()} == {("s", "x.log", "unsupported"), ("t", "c.txt", "pdf")}
    assert out[1].count() == 1 and out[2].count() == 3


def test_kept_edges_are_not_stored_again(spark, monkeypatch):
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    edge = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    held = graph.HeldClosure.of(seeds, edge(("a", "b"), ("b", "c"), ("x", "y"), ("a", "b")))
    assert "edges" not in names
    # What is both taken and given stays, what is given again is there once.
    out = held.changed(added=edge(("c", "x"), ("a", "b"), ("x", "y")), removed=edge(("a", "b"), ("b", "c"), ("q", "q")), seeded=spark.createDataFrame([("c",)], "node string"))
    assert {r[0] for r in out.reached.collect()} == {"a", "b", "c", "x", "y"}
    assert sorted(map(tuple, out.edges.collect())) == [("a", "b"), ("c", "x"), ("x", "y")]
    again = out.changed(removed=edge(("c", "x")))
    assert {r[0] for r in again.reached.collect()} == {"a", "b", "c"}
