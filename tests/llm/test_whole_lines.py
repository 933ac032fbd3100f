"""A line counts once for every different document that holds it, whatever its hash."""

import hashlib

from pyspark.sql import functions as F

from lodeworks.llm import quality_lines


def test_line_with_least_hash_is_counted_in_every_document(spark):
    own = lambda n: f"document {'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]} says ten good words of its own on this line here"
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    least = min(digest(own(n)) for n in range(40))
    boiler = next(x for k in range(10_000) if digest(x := f"boiler plate {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]} line") < least)
    rows = [(n, f"{boiler}\n{own(n)}") for n in range(40)] + [(100 + n, f"{own(0)}\nonly copies hold this line") for n in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("h"))
    got = {r["doc_id"]: r["removed_words"] for r in quality_lines.judge(d, line_limit=30).collect()}
    assert all(got[n] == 4 for n in range(40)) and all(got[100 + n] == 0 for n in range(40))


def test_accepted_documents_lose_their_frequent_lines(spark):
    own = lambda n: f"document {'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]} says eleven or so good words of its own on this line here"
    boiler = "Subscribe  to our 12 letters"
    rows = [(n, f"{boiler}\n\n{own(n)}\nsubscribe to our 7 letters", "h", "k") for n in range(40)]
    rows += [(200, f"{boiler}\n{own(0)}", "other", "k"), (0, f"{boiler}\n\n{own(0)}\nsubscribe to our 7 letters", "h", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string")
    got = quality_lines.accepted(d, line_limit=30).collect()
    assert got[0].asDict().keys() == set(d.columns)
    want = [(n, f"\n{own(n)}", "h", "k") for n in range(40)] + [rows[40], (0, f"\n{own(0)}", "h", "k")]
    assert sorted(map(tuple, got)) == sorted(want)
