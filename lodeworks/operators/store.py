"""Changes to the stored tables as new versions of them: whole documents are replaced, shared passages kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.text import passage_hash
from lodeworks.operators.graph import survivors_parent, unreachable


def new_passages(passages: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """(chunk_id, embed_model, raw_sha256, chunk_text): passages not stored for the model yet, each text once (the first document's spelling).

    Only these need a vector. ``passages``: doc_id, chunk_index, chunk_text.
    """
    t = passages.withColumn("raw_sha256", passage_hash(F.col("chunk_text")))
    t = t.withColumn("_n", F.row_number().over(W.partitionBy("raw_sha256").orderBy("doc_id", "chunk_index"))).filter("_n = 1")
    known = chunks.filter(F.col("embed_model") == model).select("raw_sha256")
    t = t.join(known, "raw_sha256", "left_anti")
    key = F.sha2(F.concat_ws("\n", F.lit(model), "raw_sha256"), 256)
    return t.select(key.alias("chunk_id"), F.lit(model).alias("embed_model"), "raw_sha256", "chunk_text")


def replace_chunks(chunks: DataFrame, placements: DataFrame, passages: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, placements) after the documents of ``passages`` were cut anew; passages that nothing places any more go.

    ``passages`` also has start_byte and end_byte. Placement ids depend on document,
    model and index, so a repeated run gives the same rows.
    """
    hashed = passages.withColumn("raw_sha256", passage_hash(F.col("chunk_text")))
    every = chunks.unionByName(new_passages(passages, chunks, model), allowMissingColumns=True)
    own = hashed.join(every.filter(F.col("embed_model") == model).select("raw_sha256", "chunk_id"), "raw_sha256")
    ident = F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), F.lit(model), F.col("chunk_index").cast("string")), 256)
    new = own.select(ident.alias("placement_id"), "doc_id", "chunk_id", "chunk_index", "start_byte", "end_byte", F.sha2("chunk_text", 256).alias("slice_sha256"))
    kept = placements.join(passages.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
    return every.join(kept.select("chunk_id"), "chunk_id", "left_semi"), kept


def delete_documents(documents: DataFrame, containment: DataFrame, placements: DataFrame, chunks: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, containment, placements, chunks) without ``deleted`` (doc_id).

    Survivors whose parent went get the earliest container that remains.
    """
    gone = deleted.select("doc_id").distinct()
    edges = containment.join(gone.withColumnRenamed("doc_id", "container_id"), "container_id", "left_anti").join(gone.withColumnRenamed("doc_id", "contained_id"), "contained_id", "left_anti")
    parent = survivors_parent(containment, gone).select(F.col("contained_id").alias("doc_id"), F.col("container_id").alias("_new"))
    lost = gone.select(F.col("doc_id").alias("parent_doc_id"), F.lit(True).alias("_lost"))
    docs = documents.join(gone, "doc_id", "left_anti").join(lost, "parent_doc_id", "left").join(parent, "doc_id", "left")
    docs = docs.withColumn("parent_doc_id", F.when(F.col("_lost"), F.col("_new")).otherwise(F.col("parent_doc_id"))).select(*documents.columns)
    left = placements.join(gone, "doc_id", "left_anti")
    return docs, edges, left, chunks.join(left.select("chunk_id"), "chunk_id", "left_semi")


def prune_plan(documents: DataFrame, edges: DataFrame, staged: DataFrame, ignored: DataFrame | None, *, backfilled: bool) -> DataFrame:
    """Documents that a sweep may delete. Refused while containment is incomplete, or if nothing is staged (a source is missing, not empty)."""
    if not backfilled:
        raise RuntimeError("containment is not complete; fill it in first")
    if staged.isEmpty():
        raise RuntimeError("nothing is staged; check the sources")
    return unreachable(documents, edges, staged, ignored)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key; columns in ``keep`` stay as they were."""
    old = table.select(*key, *[F.col(c).alias(f"_{c}") for c in keep])
    new = rows.join(old, key, "left") if keep else rows
    new = new.select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in table.columns])
    return table.join(rows.select(*key), key, "left_anti").unionByName(new)


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Containment with new edges; each stays as first seen, and nothing contains itself."""
    both = edges.unionByName(new.filter("container_id <> contained_id"))
    return both.groupBy("container_id", "contained_id").agg(F.min("first_seen_at").alias("first_seen_at"))


def orphans(chunks: DataFrame, placements: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Passages that nothing places any more."""
    return chunks.join(placements.select(key), key, "left_anti")


def last_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last by ``order``."""
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")


def forgotten(tables: dict[str, DataFrame], deleted: DataFrame, *, kept: tuple[str, ...] = ("metadata",)) -> dict[str, DataFrame]:
    """All ``tables`` without the rows of ``deleted`` (doc_id), by doc_id or as either end of containment; ``kept`` ones stay whole."""
    gone, out = deleted.select("doc_id").distinct(), {}
    for name, t in tables.items():
        for c in ("doc_id", "container_id", "contained_id") if name not in kept else ():
            t = t.join(gone.withColumnRenamed("doc_id", c), c, "left_anti").select(*t.columns) if c in t.columns else t
        out[name] = t
    return out


def by_hash(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """The documents (doc_id) with one of ``hashes`` (sha)."""
    return documents.join(hashes.select("sha").distinct(), "sha", "left_semi").select("doc_id")


def wiped(tables: dict[str, DataFrame], *, kept: tuple[str, ...] = ("metadata",)) -> dict[str, DataFrame]:
    """Empty tables of the same columns; ``kept`` ones stay as they are."""
    return {name: t if name in kept else t.limit(0) for name, t in tables.items()}


def source_records(documents: DataFrame, occurrences: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, files, routes): each document's own files and the containers' members that lead to it, in order."""
    files = occurrences.groupBy("doc_id").agg(F.sort_array(F.collect_set("path")).alias("files"))
    routes = members.groupBy(F.col("child_id").alias("doc_id")).agg(F.sort_array(F.collect_set(F.struct("parent_id", "selector"))).alias("routes"))
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like))
    t = documents.select("doc_id").join(files, "doc_id", "left").join(routes, "doc_id", "left")
    return t.select("doc_id", none("files", "array<string>").alias("files"), none("routes", routes.schema["routes"].dataType).alias("routes"))
