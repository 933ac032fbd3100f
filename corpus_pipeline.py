"""From raw documents to a training mix: five operators, each on what the one before kept.

Defined for every stage: a null text is an empty one to the rules and stays null
where its document stays; rows may share an id or have none (their text tells them
apart); rows that repeat a document wholly are copies of each other, of which the
join keeps one; very long texts go through whole; an empty table gives an empty one; other columns, whatever their
names, go through as they are, and ``n_chars`` follows the text where it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import decontaminate, jaccard_join, mixing, pii, quality_lines
from lodeworks.llm.common import Scratch, discard
from lodeworks.llm.queries import MIX_WEIGHTS, table


def counted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with ``n_chars``, where ``docs`` has it, as the length of the text."""
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null and empty texts among them, and the frequent lines of the others."""
    return counted(docs, quality_lines.accepted(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the least id (null first), then the least hash of its text. Documents without words stay all."""
    return jaccard_join.deduplicated(docs, threshold=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; without items none does. A document without words holds none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by their kind. Null texts stay null."""
    return counted(docs, pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, in training order, with the words taken and the position; a row for each pass over a document.

    Documents without words are not taken. The two columns get an underscore more
    where ``docs`` has their names; equal positions stand by a hash of id and text.
    """
    own = [c for c in docs.columns if c != "doc_id"]
    out = mixing.mix(docs.select("doc_id", F.struct(*own).alias("_row"), "text", "source"), weights=MIX_WEIGHTS, keep=("_row",), by_pass=True)
    taken, position = (_free(name, docs.columns) for name in ("taken", "position"))
    rows = out.filter("taken > 0").select("doc_id", *[F.col("_row")[c].alias(c) for c in own], F.col("taken").alias(taken), F.col("position").alias(position))
    return rows.select(*docs.columns, taken, position)


def _free(name: str, used: list[str]) -> str:
    while name.lower() in {c.lower() for c in used}:
        name += "_"
    return name


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("mixing", mix),
]

#: Weak supervision and pruning by probability are not statements of SQL; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with Scratch() as scratch:
            docs = scratch.result(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
