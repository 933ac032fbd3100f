"""Large groups around matched documents."""

from pyspark.sql import functions as F

from lodeworks.operators import retrieval
from tests.sizes import most_rows


def test_siblings_in_a_large_container_are_met_once(spark):
    n = 3000
    edges = spark.range(n).select(F.lit("n").alias("container_id"), F.format_string("c%05d", "id").alias("contained_id"))
    docs = edges.select(F.col("contained_id").alias("doc_id"), F.lit("COMPLETED").alias("status")).union(spark.createDataFrame([("n", "COMPLETED")], "doc_id string, status string"))
    matched = edges.filter(F.substr("contained_id", F.lit(-1)) == "7").select(F.col("contained_id").alias("doc_id"))
    run = lambda: retrieval.neighbours(edges, docs, matched)
    got = {(r["doc_id"], r["relation"], r["anchor_id"]) for r in run().collect()}
    assert got == {("n", "parent", "c00007")} | {(f"c{k:05}", "sibling", "c00007") for k in range(n) if k % 10 != 7}
    # 300 matched ones times 3,000 would be 900,000 pairs.
    assert most_rows(spark, run) <= 4 * n


def test_a_sibling_of_several_containers_has_the_least_anchor_of_all(spark):
    edges = spark.createDataFrame([("a", "m2"), ("a", "x"), ("b", "m1"), ("b", "x"), ("b", "y"), ("m2", "y")], "container_id string, contained_id string")
    docs = spark.createDataFrame([(k, "COMPLETED") for k in ("a", "b", "x", "y", "m1", "m2")], "doc_id string, status string")
    got = retrieval.neighbours(edges, docs, spark.createDataFrame([("m1",), ("m2",)], "doc_id string"))
    assert {tuple(r) for r in got.collect()} == {("a", "parent", "m2"), ("b", "parent", "m1"), ("x", "sibling", "m1"), ("y", "attachment", "m2")}
