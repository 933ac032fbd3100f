"""Checks before work: requests, workspace scope, readiness, exclusivity; and counts observed while it runs."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date, datetime
from email.utils import parseaddr

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.tables import shared_dir


def mailbox_address(value: str) -> str:
    """One address in lower case; a value that is none, or several, is an error."""
    _, address = parseaddr(value)
    if len(value) > 320 or not re.fullmatch(r"[^\s@<>,]+@[^\s@<>,]+", address) or "," in value.replace(address, ""):
        raise ValueError(f"{value!r} is not one mail address")
    local, _, domain = address.rpartition("@")
    return f"{local}@{domain_name(domain)}".lower()


def domain_name(value: str) -> str:
    """Labels of 1 to 63 letters, digits and inner hyphens; 253 characters in all."""
    name = value.strip().lower().lstrip("@")
    if len(name) > 253 or not all(re.fullmatch(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?", x) for x in name.split(".")):
        raise ValueError(f"{value!r} is not a domain")
    return name


def moment(value: str) -> datetime:
    """A date, at its first moment, or a time with its zone."""
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        return datetime.combine(date.fromisoformat(value), datetime.min.time())
    out = datetime.fromisoformat(value)
    if out.tzinfo is None:
        raise ValueError(f"{value!r} has no zone")
    return out


def readable(text: str) -> bool:
    """Two letters, digits or characters beyond ASCII in a row."""
    return bool(re.search(r"(?:[A-Za-z0-9]|[^\x00-\x7F]){2}", text))


def in_scope(metadata: DataFrame, workspace: str, model: str, dim: int) -> None:
    """The stored identity is this workspace's, under this model and width; otherwise nothing is read or written."""
    rows = metadata.limit(2).collect()
    if len(rows) != 1:
        raise RuntimeError("the workspace has no single identity")
    r = rows[0]
    if (r["workspace_id"], r["embed_model"], r["embed_dim"]) != (workspace, model, dim):
        raise RuntimeError("the tables belong to another workspace, model or vector width")


def readiness(tables: dict[str, DataFrame], wanted: dict[str, tuple[str, ...]]) -> list[str]:
    """What is missing: tables, their columns, or any row."""
    out = []
    for name, columns in wanted.items():
        if name not in tables:
            out.append(f"{name}: missing")
        elif gone := [c for c in columns if c not in tables[name].columns]:
            out.append(f"{name}: no {', '.join(gone)}")
        elif tables[name].isEmpty():
            out.append(f"{name}: empty")
    return out


@contextmanager
def exclusive(spark: SparkSession, name: str, *, owner: str = "", hours: float = 12.0, now: Callable[[], float] = time.time) -> Iterator[None]:
    """Holds a workspace against other maintenance: a file in the shared folder that only one driver can create.

    The file tells its owner and when it expires, so that what a driver left that
    died is taken over after that.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodeworks/locks/{name}")
    fs = path.getFileSystem(conf)
    token = uuid.uuid4().hex

    def held() -> list[str]:
        try:
            stream = fs.open(path)
        except Exception:  # gone, or not whole yet
            return []
        try:
            return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split("\n")
        finally:
            stream.close()

    def take() -> bool:
        try:
            out = fs.create(path, False)
        except Exception:
            return False
        out.write(bytearray(f"{token}\n{owner}\n{now() + hours * 3600}".encode()))
        out.close()
        return True

    if not take():
        old = held()
        if len(old) != 3 or float(old[2]) > now():
            raise RuntimeError(f"{name} is under maintenance" + (f" by {old[1]}" if len(old) == 3 and old[1] else ""))
        fs.delete(path, False)
        if not take():
            raise RuntimeError(f"{name} is under maintenance")
    try:
        yield
    finally:
        if held()[:1] == [token]:
            fs.delete(path, False)


def counted(df: DataFrame, name: str, **counts: object) -> tuple[DataFrame, Observation]:
    """``df`` that also counts its rows, and those where a condition holds, whenever it is written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), seen
