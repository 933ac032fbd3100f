"""Evaluation cases from JSON, and reports that are added but never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 6
SCHEMA = (
    "version int, cases array<struct<id:string,question:string,expected_documents:array<struct<match:struct<raw_sha256:string>,grade:int>>,"
    "require_all_expected_documents:boolean,expected_empty:boolean>>"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row per case; a wrong version, a repeated or empty id or question, a grade outside 0 to 3, or a case that expects both nothing and something is an error."""
    t = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    if t.filter(F.coalesce("version", F.lit(0)) != VERSION).count():
        raise ValueError(f"a case set of version {VERSION} is wanted")
    cases = t.select(F.explode("cases").alias("c")).select("c.*")
    some = F.size(F.coalesce("expected_documents", F.array().cast("array<struct<match:struct<raw_sha256:string>,grade:int>>"))) > 0
    bad = (F.coalesce("id", F.lit("")) == "") | (F.coalesce("question", F.lit("")) == "") | (F.coalesce("expected_empty", F.lit(False)) == some)
    bad = bad | F.coalesce(F.exists("expected_documents", lambda x: ~x["grade"].between(0, 3)), F.lit(False))
    wrong = cases.filter(bad).count() + cases.groupBy("id").count().filter("count > 1").count()
    if wrong:
        raise ValueError(f"{wrong} cases are not valid")
    return cases


def expected(cases: DataFrame) -> DataFrame:
    """(case_id, sha, grade)."""
    t = cases.select(F.col("id").alias("case_id"), F.explode("expected_documents").alias("e"))
    return t.select("case_id", F.col("e.match.raw_sha256").alias("sha"), F.col("e.grade").alias("grade"))


def archive(report: DataFrame, path: str, run_id: str) -> None:
    """A run's report in a folder of its own; names sort by time if run ids do. An existing run is an error."""
    report.write.mode("errorifexists").json(f"{path}/run_id={run_id}")
