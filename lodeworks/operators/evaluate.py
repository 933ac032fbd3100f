"""Measures of retrieval quality over runs of cases.

``runs``: case_id, doc_id, rank (from 1), and for delivery own_text, related. A
document counts once in a run, at its best rank. ``expected``: case_id, doc_id,
grade. Cases without expected documents have recall 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.vocabulary import THRESHOLDS


def first_places(runs: DataFrame) -> DataFrame:
    """Each document of a run once, with its place among the different documents."""
    best = runs.groupBy("case_id", "doc_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("case_id").orderBy("rank", "doc_id")))


def scores(cases: DataFrame, runs: DataFrame, expected: DataFrame, k: int, *, by: str = "case_id") -> DataFrame:
    """(case_id, n_expected, recall, rr, ndcg) of every case.

    Where many cases expect the same, ``by`` names a column of ``cases`` that ``expected`` has in
    place of case_id: what a group expects stands there once, not for each of its cases.
    """
    found = first_places(runs)
    cases = cases.select(*dict.fromkeys(["case_id", by])).distinct()
    e = expected.groupBy(by, "doc_id").agg(F.max("grade").alias("grade"))
    hit = (found if by == "case_id" else found.join(cases, "case_id")).join(e, [by, "doc_id"])
    inside = F.lit(True) if k <= 0 else F.col("place") <= k
    gain = lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 1.0)
    got = hit.groupBy("case_id").agg(
        F.count_if(inside).alias("_in"), F.min("place").alias("_first"), F.sum(F.when(inside, gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("_dcg")
    )
    ideal = e.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(F.col("grade").desc(), "doc_id")))
    # Cut to k before all else, so that no group is sorted whole where k bounds what counts.
    ideal = (ideal if k <= 0 else ideal.filter(F.col("_i") <= k)).groupBy(by).agg(F.sum(gain(F.col("grade"), F.col("_i"))).alias("_ideal"))
    ideal = e.groupBy(by).agg(F.count("*").alias("_n")).join(ideal, by)
    t = cases.join(ideal, by, "left").join(got, "case_id", "left")
    zero = lambda c, z=0.0: F.coalesce(F.col(c), F.lit(z))
    return t.select(
        "case_id", zero("_n", 0).cast("long").alias("n_expected"),
        F.when(F.col("_n").isNull(), 1.0).otherwise(zero("_in", 0) / F.col("_n")).alias("recall"),
        F.when(F.col("_first").isNull(), 0.0).otherwise(F.lit(1.0) / F.col("_first")).alias("rr"),
        F.when(zero("_ideal") == 0, 0.0).otherwise(zero("_dcg") / F.col("_ideal")).alias("ndcg"),
    )


def delivery(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, delivered, supplementary, together): parts of the expected documents whose text came as a match, as a relation, or either."""
    told = lambda t, *of: t.select("case_id", "doc_id", *[F.lit(c in of).alias(c) for c in ("_e", "_own", "_rel")])
    came = told(runs.filter("own_text"), "_own").unionByName(told(runs.select("case_id", F.explode("related").alias("doc_id")), "_rel"))
    # A document of a case comes to one place once, whatever is told of it. What has no name is not what was expected.
    every = told(expected, "_e").unionByName(came.filter("case_id IS NOT NULL AND doc_id IS NOT NULL"))
    t = every.groupBy("case_id", "doc_id").agg(*[F.bool_or(c).alias(c) for c in ("_e", "_own", "_rel")]).filter("_e")
    own_, rel_ = F.col("_own"), F.col("_rel")
    share = lambda c: F.count_if(c) / F.count("*")
    return t.groupBy("case_id").agg(share(own_).alias("delivered"), share(rel_).alias("supplementary"), share(own_ | rel_).alias("together"))


def delivered_ranks(cases: DataFrame, runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, first_expected, first_delivered, rr_delivered): the ranks at which an expected document came first, and first with its text (0: never).

    Cases that expect nothing have a reciprocal rank of 1.
    """
    e = expected.select("case_id", "doc_id").distinct()
    hit = runs.join(e, ["case_id", "doc_id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("_e"), F.min(F.when(F.col("own_text"), F.col("rank"))).alias("_d"))
    t = cases.select("case_id").distinct().join(e.groupBy("case_id").agg(F.count("*").alias("_n")), "case_id", "left").join(hit, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rr = F.when(F.col("_d").isNotNull(), F.lit(1.0) / F.col("_d")).otherwise(F.when(F.col("_n").isNull(), 1.0).otherwise(0.0))
    return t.select("case_id", zero("_e").alias("first_expected"), zero("_d").alias("first_delivered"), rr.alias("rr_delivered"))


def verdicts(cases: DataFrame) -> DataFrame:
    """(case_id, passed, failures) by each case's own contract, without any threshold of quality.

    ``cases``: case_id, expected_empty, require_all, packets, n_expected, recall and
    delivered (the parts of the expected documents found, and found with their text).
    """
    found = F.round(F.col("recall") * F.col("n_expected")).cast("long")
    failures = F.array_compact(
        F.array(
            F.when(F.col("expected_empty") & (F.col("packets") > 0), F.concat(F.lit("expected nothing, got "), F.col("packets"), F.lit(" packets"))),
            F.when(~F.col("expected_empty") & F.col("require_all") & (F.col("recall") < 1), F.concat(F.lit("found "), found, F.lit(" of "), F.col("n_expected"), F.lit(" expected documents"))),
            F.when(~F.col("expected_empty") & ~F.col("require_all") & (F.col("recall") == 0), F.lit("found no expected document")),
            F.when(~F.col("expected_empty") & (F.col("recall") > 0) & (F.col("delivered") == 0), F.lit("found an expected document without its text")),
        )
    )
    return cases.select("case_id", (F.size(failures) == 0).alias("passed"), failures.alias("failures"))


def summary(per_case: DataFrame, empty: DataFrame | None = None, overlaps: DataFrame | None = None) -> DataFrame:
    """One row of means over the cases that expect something, and whether all thresholds hold.

    ``empty``: passed of each case that expects nothing. ``overlaps``: overlap of
    each query's approximate neighbours with the exact ones. What was not measured
    does not fail.
    """
    some = F.col("n_expected") > 0
    t = per_case.agg(
        F.count("*").alias("cases"), F.count_if(some).alias("ranked"), F.avg(F.when(some, F.col("recall"))).alias("recall"),
        F.avg(F.when(some, F.col("rr"))).alias("mrr"), F.avg(F.when(some, F.col("ndcg"))).alias("ndcg"),
    )
    nothing = per_case.sparkSession.range(1).select(F.lit(None).cast("double").alias("x"))
    one = lambda df, c, name: (nothing.select(F.col("x").alias(name)) if df is None else df.agg(F.avg(F.col(c).cast("double")).alias(name)))
    # Rows of one each.
    t = t.crossJoin(F.broadcast(one(empty, "passed", "empty"))).crossJoin(F.broadcast(one(overlaps, "overlap", "ann")))
    ok = F.lit(True)
    for c in ("recall", "mrr", "ndcg", "empty", "ann"):
        ok = ok & (F.coalesce(F.col(c), F.lit(1.0)) >= THRESHOLDS[c])
    return t.withColumn("passed", ok)


def overlap(exact: DataFrame, approximate: DataFrame, *, by: str, key: str) -> DataFrame:
    """(by, overlap): the part of the exact neighbours that the approximate search found."""
    both = exact.select(by, key).distinct().join(approximate.select(by, key).distinct().withColumn("_f", F.lit(1)), [by, key], "left")
    return both.groupBy(by).agg((F.count("_f") / F.count("*")).alias("overlap"))


def comparable(before: dict[str, str], after: dict[str, str]) -> None:
    """Refuses to compare runs over other cases (``digest``) or other measures (``version``)."""
    for name in ("digest", "version"):
        if before[name] != after[name]:
            raise ValueError(f"the runs differ in {name}: {before[name]} and {after[name]}")


def case_digest(cases: DataFrame) -> str:
    """One digest of the cases' ids, questions and expectations, in whatever order they stand: 64 bits of each case added up."""
    r = cases.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(cases.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h'] or 0}"


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, change) of two runs with a passed flag: fixed, regressed, same, added or removed."""
    a, b = before.select("case_id", F.col("passed").alias("_a")), after.select("case_id", F.col("passed").alias("_b"))
    change: Column = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a") & F.col("_b"), "fixed")
        .when(F.col("_a") & ~F.col("_b"), "regressed").otherwise("same")
    )
    return a.join(b, "case_id", "full").select("case_id", change.alias("change"))


def resolved(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected documents by their content hash: all of them, or an error that counts the unknown."""
    # Hashes are longer than a table's size on disk lets expect: documents are not sent to all.
    t = expected.join(documents.select("sha", F.col("doc_id").alias("_d")).hint("merge"), "sha", "left")
    unknown = t.filter("_d IS NULL").count()
    if unknown:
        raise ValueError(f"{unknown} expected documents are not in the corpus")
    return t.withColumnRenamed("_d", "doc_id")
