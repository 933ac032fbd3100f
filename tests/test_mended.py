"""Bodies line by line, paths below a root, claims of one job, doubled outcomes, thresholds, locks, rounds of a closure."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text
from lodeworks.operators import evaluate, graph, guards, jobs
from lodeworks.sources import files

NOW = datetime(2026, 1, 1)


def bodies(spark, values):
    t = spark.createDataFrame(list(enumerate(values)), "n int, t string")
    return [r["x"] for r in t.orderBy("n").select(text.compact(F.col("t")).alias("x")).collect()]


def test_bodies(spark):
    link = "https://x.org/"
    cases = {
        "own\n----- Original Message -----\nold": "own", "own\n  --original message--\nold": "own", "own\n______\nold": "own", "own\n____\nkept": "own\n____\nkept",
        "own\nFrom: a@b.c\nSent: today\nold": "own", "own\nFrom: a@b.c\nTo: today": "own\nFrom: a@b.c\nTo: today", "On it wrote:\nkept": "On it wrote:\nkept",
        "own\non " + "x" * 120 + " wrote:": "own\non " + "x" * 120 + " wrote:", "own\nON monday someone WROTE:  \n> old": "own", "On he rewrote:\nthat text which is here": "On he rewrote:\nthat text which is here",
        "a\n--\nsig": "a", "a\n-- x\nb": "a\n-- x\nb", "> > quoted\n>mine\nfree": "> quoted\nmine\nfree", "a\n\n\n\n\nb": "a\n\nb", "a  \t b\tc   \n  d": "a b\tc\n d",
        "x " + link + "q" * 120 + " y": "x y", "x (" + link + "q" * 200 + ") y": "x () y", f"x {link}short y {link}" + "z" * 150: f"x {link}short y", "": "", "\r\n \r\n": "", "Привет, мир": "Привет, мир",
        "." * 90: "." * 90, "  a  ": "a",
    }
    assert bodies(spark, list(cases)) == list(cases.values())
    assert bodies(spark, [None]) == [None]


def test_paths_below_a_root_whose_name_comes_again(spark, tmp_path):
    root = tmp_path / "mail" / "x" / "mail"
    (root / "mail" / "in mail").mkdir(parents=True)
    for name in ("a.eml", "mail/b%20c.eml", "mail/in mail/é d.eml"):
        (root / name).write_text(name)
    got = {r["relative_path"]: bytes(r["content"]).decode() for r in files.scan(spark, str(root)).collect()}
    assert got == {k: k for k in ("a.eml", "mail/b%20c.eml", "mail/in mail/é d.eml")}
    assert set(got) == {r["relative_path"] for r in files.scan(spark, f"file://{root}/").collect()}


def queue(spark):
    at = lambda d: NOW + timedelta(days=d)
    rows = [(1, "READY", at(-2), None, 1, 0), (2, "READY", at(-1), None, 1, 0), (3, "RUNNING", at(-3), at(-1), 4, 1), (4, "RUNNING", at(-3), at(1), 4, 1)]
    t = spark.createDataFrame(rows, "job_id long, state string, available_at timestamp, lease_until timestamp, generation long, attempts int")
    return t.select("*", F.lit("emails").alias("subject"), F.col("available_at").alias("created_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("reason"))


def test_claims_of_one_job_come_to_both_kinds(spark):
    ids = lambda limit, turn=0: [r["job_id"] for r in jobs.claimable(queue(spark), "emails", limit, NOW, turn).collect()]
    assert [ids(1, n) for n in range(3)] == [[1], [3], [1]] and ids(3) == [3, 1, 2] and ids(2) == [3, 1]
    only = queue(spark).filter("state <> 'READY'")
    assert [r["job_id"] for r in jobs.claimable(only, "emails", 1, NOW, 0).collect()] == [3]


def test_outcomes_told_twice_settle_once(spark):
    told = spark.createDataFrame([(4, 4, "ok", None), (4, 4, "error", "OCR_FAILED"), (4, 3, "terminal", "X"), (3, 4, "ok", None)], "job_id long, generation long, outcome string, reason string")
    got = {r["job_id"]: r["state"] for r in jobs.settle(queue(spark), told, NOW).collect()}
    assert got == {1: "READY", 2: "READY", 3: "RUNNING", 4: "READY"} and jobs.settle(queue(spark), told, NOW).count() == 4


def test_backoff_is_spread(spark):
    r = spark.range(1).select(*[text.backoff_seconds(F.lit(2), x).alias(f"b{i}") for i, x in enumerate((1.0, 0.0, 0.5, F.rand(3)))]).first()
    assert (r["b0"], r["b1"], r["b2"]) == (120.0, 60.0, 90.0) and 60 <= r["b3"] <= 120


def test_all_thresholds_count(spark):
    case = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0), (2, 0, 1.0, 0.0, 0.0)], "case_id int, n_expected long, recall double, rr double, ndcg double")
    empty = lambda *x: spark.createDataFrame([(b,) for b in x], "passed boolean")
    near = lambda *x: spark.createDataFrame([(b,) for b in x], "overlap double")
    ok = lambda *a: evaluate.summary(case, *a).first()["passed"]
    assert ok() and ok(empty(True), near(0.9, 0.8)) and not ok(empty(True, False)) and not ok(None, near(0.9, 0.7))
    assert evaluate.summary(case).first()["empty"] is None


def test_a_dead_owners_lock_expires(spark):
    clock = [1000.0]
    dead = guards.exclusive(spark, "mended", owner="first", hours=1, now=lambda: clock[0])
    dead.__enter__()
    with pytest.raises(RuntimeError, match="by first"), guards.exclusive(spark, "mended", now=lambda: clock[0]):
        pass
    clock[0] += 3601
    with guards.exclusive(spark, "mended", owner="second", now=lambda: clock[0]):
        dead.__exit__(None, None, None)  # the first owner comes back and leaves the second's lock alone
        with pytest.raises(RuntimeError, match="by second"), guards.exclusive(spark, "mended", now=lambda: clock[0]):
            pass
    with guards.exclusive(spark, "mended"):
        pass


def test_closure_over_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")] * 2, "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r["node"] for r in graph.closure(seeds, e).collect()} == set("abcde")
    stop = spark.createDataFrame([("d",)], "node string")
    assert sorted(r["node"] for r in graph.closure(seeds, e, stop=stop).collect()) == list("abc")
