"""Model endpoints as injected callables, run in batches on executors behind a circuit breaker."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.chunking import batches


class Unavailable(RuntimeError):
    """The endpoint did not answer, or the breaker is open."""


class Breaker:
    """Opens after ``most`` failures in a row for ``rest`` seconds; then one call may try."""

    def __init__(self, most: int = 5, rest: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.rest, self.clock, self.failures, self.opened = most, rest, clock, 0, None

    def call(self, f: Callable, *args: object) -> object:
        if self.opened is not None and self.clock() - self.opened < self.rest:
            raise Unavailable("the circuit is open")
        try:
            out = f(*args)
        except Exception as e:
            self.failures += 1
            if self.failures >= self.most or self.opened is not None:
                self.opened = self.clock()
            raise Unavailable(str(e)) from e
        self.failures, self.opened = 0, None
        return out


def embed(passages: DataFrame, model: Callable[[list[str]], Sequence[Sequence[float]]], *, key: str, text: str, dim: int) -> DataFrame:
    """(key, embedding): vectors of all passages, as many as were sent and of the stated width."""
    t = passages.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = t.schema["k"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        for p in parts:
            vectors: list = []
            for group in batches(list(p["t"])):
                found = breaker.call(model, group)
                if len(found) != len(group) or any(len(v) != dim for v in found):
                    raise ValueError("the endpoint answered with another number or width of vectors")
                vectors += [list(map(float, v)) for v in found]
            yield pd.DataFrame({"k": p["k"], "embedding": vectors})

    return t.mapInPandas(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def embed_new(passages: DataFrame, known: DataFrame, model: Callable[[list[str]], Sequence[Sequence[float]]], *, name: str, dim: int) -> DataFrame:
    """(embed_model, raw_sha256, embedding) of ``known`` and of the passages (raw_sha256, chunk_text) that it lacks for this model: only these are sent."""
    have = known.filter(F.col("embed_model") == name).select(F.col("raw_sha256").alias("_have"))
    # A passage without text has no hash, and is known where another such is.
    new = passages.dropDuplicates(["raw_sha256"]).join(have, F.col("raw_sha256").eqNullSafe(F.col("_have")), "left_anti")
    found = embed(new, model, key="raw_sha256", text="chunk_text", dim=dim).select(F.lit(name).alias("embed_model"), "raw_sha256", "embedding")
    return known.select("embed_model", "raw_sha256", "embedding").unionByName(found)


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a model: signed hashes of words, of unit length."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h & 0x10000 else -1.0
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out
