"""Admission of scanned files: one document for each content, routed to a stage, with its job and occurrence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.text import component_id
from lodeworks.operators.jobs import observed, publish
from lodeworks.operators.tables import stored
from lodeworks.sources.files import classify


def stage_of(doc_type: Column) -> Column:
    """The queue that a type of document goes to; null for types that no handler reads."""
    return (
        F.when(doc_type.isin("email", "archive"), "emails").when(doc_type == "pdf", "pdfs").when(doc_type == "image", "images")
        .when(doc_type == "office", "docx").when(doc_type == "text", "embed")
    )


def new_documents(documents: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """Rows for contents that are not known yet; of files with one content the first path names it.

    ``files``: sha256, relative_path, filename, content. ``documents``: raw_sha256.
    """
    first = F.row_number().over(W.partitionBy("sha256").orderBy("relative_path"))
    # Told where the file is read, so that contents do not move.
    t = files.select("sha256", "relative_path", "filename", classify(F.col("content"), F.col("filename")).alias("_r"))
    t = t.withColumn("_n", first).filter("_n = 1").join(documents.select(F.col("raw_sha256").alias("sha256")), "sha256", "left_anti")
    declined = F.col("_r.declined")
    return t.select(
        component_id(F.lit("content"), F.col("sha256")).alias("doc_id"), F.col("sha256").alias("raw_sha256"), F.col("filename").alias("source_filename"),
        F.col("_r.doc_type").alias("doc_type"), F.when(declined, "SKIPPED").otherwise("PENDING").alias("status"),
        F.when(declined, "UNSUPPORTED_FORMAT").alias("reason"), F.lit(now).alias("updated_at"),
    )


def admit(documents: DataFrame, jobs: DataFrame, occurrences: DataFrame, files: DataFrame, *, root_id: str, now: datetime, complete: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, jobs, occurrences) after a scan. Running it again on the same files changes nothing but the observation."""
    # Three tables follow from the new documents, which are found once.
    fresh = stored(new_documents(documents, files, now), "new-documents")
    docs = documents.unionByName(fresh, allowMissingColumns=True)
    due = docs.filter("status = 'PENDING'").withColumn("subject", stage_of(F.col("doc_type"))).filter("subject IS NOT NULL")
    work = due.select(
        F.sha2(F.concat_ws("\n", "doc_id", "subject", "raw_sha256"), 256).alias("job_id"), "doc_id", "subject", F.col("raw_sha256").alias("revision"),
        F.lit("READY").alias("state"), F.lit(0).cast("long").alias("generation"), F.lit(0).alias("attempts"), F.lit(now).alias("available_at"), F.lit(now).alias("created_at"),
    )
    seen = files.join(docs.select("doc_id", F.col("raw_sha256").alias("sha256")), "sha256")
    seen = seen.select(F.lit(root_id).alias("root_id"), "relative_path", "doc_id", F.lit(True).alias("available"))
    return docs, publish(jobs, work), observed(occurrences, seen, complete=complete)


def preview(files: DataFrame) -> DataFrame:
    """One row: what a scan would read."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def top_folders(files: DataFrame) -> DataFrame:
    return files.filter(F.contains("relative_path", F.lit("/"))).select(F.element_at(F.split("relative_path", "/"), 1).alias("folder")).distinct()


def reset(documents: DataFrame, jobs: DataFrame, chosen: DataFrame, now: datetime) -> DataFrame:
    """Documents of ``chosen`` (doc_id) pending again, save those with a running job."""
    busy = jobs.filter("state = 'RUNNING'").select("doc_id")
    t = documents.join(chosen.select("doc_id").distinct().join(busy, "doc_id", "left_anti").withColumn("_c", F.lit(True)), "doc_id", "left")
    put = lambda c, v: F.when(F.col("_c"), v).otherwise(F.col(c)).alias(c)
    new = {"status": F.lit("PENDING"), "reason": F.lit(None), "updated_at": F.lit(now)}
    return t.select(*[put(c, new[c]) if c in new else F.col(c) for c in documents.columns])
