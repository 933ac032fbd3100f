from datetime import datetime

from lodeworks.operators import admission
from lodeworks.sources import files


def test_scan_and_admit(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.txt").write_text("some words")
    (root / "b.txt").write_text("some words")
    (root / "c.pdf").write_bytes(b"%PDF-1.7 x")
    (root / "d.py").write_text("x = 1")
    (root / ".DS_Store").write_text("no")
    found = files.scan(spark, str(root)).cache()
    assert {r["relative_path"] for r in found.collect()} == {"a/x.txt", "b.txt", "c.pdf", "d.py"}
    assert admission.preview(found).first()["files"] == 4 and [r["folder"] for r in admission.top_folders(found).collect()] == ["a"]
    assert files.unstable(found, found).isEmpty()
    now = datetime(2024, 1, 1)
    docs = spark.createDataFrame([], "doc_id string, raw_sha256 string, source_filename string, doc_type string, status string, reason string, updated_at timestamp")
    jobs = spark.createDataFrame([], "job_id string, doc_id string, subject string, revision string, state string, generation long, attempts int, available_at timestamp, created_at timestamp")
    occ = spark.createDataFrame([("r", "gone.txt", "old", True)], "root_id string, relative_path string, doc_id string, available boolean")
    docs, jobs, occ = admission.admit(docs, jobs, occ, found, root_id="r", now=now, complete=True)
    assert {r["doc_type"]: r["status"] for r in docs.collect()} == {"text": "PENDING", "pdf": "PENDING", "unsupported": "SKIPPED"}
    assert sorted(r["subject"] for r in jobs.collect()) == ["embed", "pdfs"]
    assert {r["relative_path"]: r["available"] for r in occ.collect()} == {"a/x.txt": True, "b.txt": True, "c.pdf": True, "d.py": True, "gone.txt": False}
    again = admission.admit(docs, jobs, occ, found, root_id="r", now=now, complete=True)
    assert again[0].count() == 3 and again[1].count() == 2 and again[2].count() == 5
    back = admission.reset(docs, jobs.limit(0), docs.filter("status = 'SKIPPED'").select("doc_id"), now)
    assert back.filter("status = 'PENDING'").count() == 3
