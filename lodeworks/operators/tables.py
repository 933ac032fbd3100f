"""Stored tables of the library: where they lie, when they go, and what they were made from."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``, or one of our own where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here, and lost executors cost a reread."""
    path = f"{shared_dir(df.sparkSession)}/lodeworks/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t._stored_at)
        fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def version(df: DataFrame, *of: object) -> str:
    """A digest of the plan, of the files that it reads (their paths, sizes and times) and of ``of``.

    What was built from these holds as long as it does. Rows that come from no files are
    never taken for those of another frame.
    """
    spark, files = df.sparkSession, sorted(df.inputFiles())
    told = [*map(str, of), str(df.semanticHash())] if files else [uuid.uuid4().hex]
    for path in files:
        fs, at = _file_system(spark, path)
        s = fs.getFileStatus(at)
        told.append(f"{path} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in one, none where it is not there."""
    fs, at = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)
