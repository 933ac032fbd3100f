"""Approximate nearest neighbours: cells in folders of their own, product codes, exact distances for a short list.

Centres are fitted by spherical k-means on a bounded sample; every vector is filed in the
folder of its nearest centre, with a code of some bytes. A search opens the folders of the
cells that its queries ask. A code names, for each part of the vector's distance to its
centre, the nearest of 256 entries, and so stands for a vector near to the coded one; only
rows that may be near by their code are measured exactly, where they lie. What is near
enough is known from the cells nearest to a query, which are measured first: a row whose
code is farther than their k-th row by more than codes err is not measured. So a task hands
on k rows of each query, and no list of rows to be measured is kept or moved.

How many cells a query asks, and by how much codes err, are fitted too, so that a part
``RECALL`` of the exact neighbours of vectors of the sample is found. Vectors that lie in
groups need few cells; for vectors without any structure no index saves much.

Null vectors and those without length are not filed, nor null keys; an empty table gives an index
without cells, in which nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeworks.operators.retrieval import Nearest, _blocks, ranked, unit
from lodeworks.operators.tables import shared_dir, version

#: Vectors that centres and codes are fitted on, and the most centres (driver and workers hold both).
SAMPLE, MAX_CELLS = 50_000, 8192
#: The part of the exact neighbours to be found, how many each vector has, and on how many vectors of the sample that is fitted.
RECALL, NEIGHBOURS, TRIED = 0.94, 50, 256
#: Components of a part of a code, and entries of its codebook.
PART, ENTRIES = 4, 256
#: Rows of a cell that are looked up at once; rows of one cell that a task files; found rows that wait to be ranked.
ROWS, FILED, WAITING = 4096, 50_000, 200_000


def centres(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Unit vectors of ``n`` cells at most; starts are rows far from those chosen before."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    rng = np.random.default_rng(11)
    at, far = [0], 1 - x @ x[0]
    while len(at) < min(n, len(x)) and far.sum() > 1e-9:
        at.append(int(rng.choice(len(x), p=np.maximum(far, 0) / np.maximum(far, 0).sum())))
        far = np.minimum(far, 1 - x @ x[at[-1]])
    c = x[at].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def codebook(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """(parts, entries, components) for rows ``x``; a last part that is shorter is filled with nothing."""
    rng = np.random.default_rng(12)
    cut = _parts(x)
    books = []
    for p in range(cut.shape[1]):
        v = cut[:, p]
        book = v[np.sort(rng.permutation(len(v))[:ENTRIES])].copy()
        for _ in range(rounds):
            own = _entry(v, book)
            total, size = np.zeros_like(book), np.bincount(own, minlength=len(book))
            np.add.at(total, own, v)
            book = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], book)
        books.append(book)
    return np.array(books)


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, parts, components)."""
    n = -(-x.shape[1] // PART)
    return np.pad(x, ((0, 0), (0, n * PART - x.shape[1]))).reshape(len(x), n, PART)


def _entry(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * v @ book.T).argmin(1)


def coded(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    cut = _parts(x)
    return np.stack([_entry(cut[:, p], book[p]) for p in range(len(book))], axis=1).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    """Centres, the codes' codebook (of what is left of a vector without its centre), cells a query asks, by how much codes err, and about how many rows a cell has."""

    centre: np.ndarray
    book: np.ndarray
    asked: int = 0
    slack: float = 0.0
    size: np.ndarray | None = None

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centre.T).argmax(1)

    def nearest_cells(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centre.T), axis=1)[:, : self.asked] if len(self.centre) else np.zeros((len(q), 0), int)

    def first_cells(self, q: np.ndarray, asked: np.ndarray, rows: int) -> np.ndarray:
        """Which of the asked cells (queries, cells in order) have about the first ``rows`` rows."""
        size = self.size[asked]
        return np.cumsum(size, axis=1) - size < rows

    def decoded(self, cell: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        x = self.book[np.arange(code.shape[1]), code].reshape(len(code), -1)
        return x[:, : self.centre.shape[1]] + self.centre[cell]


def fitted(x: np.ndarray, cells: int, k: int, rows: int) -> Model:
    """A model of the sample ``x`` of ``rows`` vectors: as many cells, and as much slack of codes, as find ``RECALL`` of the neighbours of some of its vectors."""
    c = centres(x, cells)
    if not len(x) or not len(c):
        return Model(c, np.zeros((0, ENTRIES, PART)))
    own = (x @ c.T).argmax(1)
    size = np.bincount(own, minlength=len(c)) * max(1.0, rows / len(x))
    model = Model(c, codebook((x - c[own])[np.linspace(0, len(x) - 1, min(len(x), 20_000)).astype(int)]), size=size)
    q = x[np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int)]
    score = q @ x.T
    near = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    at = np.take_along_axis(place, own[near], axis=1)
    # Half of what may be lost is lost to cells, half to codes.
    found = np.cumsum(np.bincount(at.ravel(), minlength=len(c))) / at.size
    asked = int(np.searchsorted(found, (1 + RECALL) / 2)) + 1
    row, of = np.unique(near, return_inverse=True)
    guess = model.decoded(own[row], coded(x[row] - c[own[row]], model.book))[of.reshape(near.shape)]
    err = np.sort((np.take_along_axis(score, near, axis=1) - np.einsum("qd,qkd->qk", q, guess)).ravel())
    slack = max(0.0, float(err[min(len(err) - 1, int(len(err) * (1 + RECALL) / 2))]))
    return Model(model.centre, model.book, min(len(c), asked), slack, size)


@dataclass(frozen=True)
class Cells:
    """Stored vectors with their codes (cell, k, code, v), each cell in a folder of its own, and the model."""

    rows: DataFrame
    model: Model
    key: str

    @property
    def codes(self) -> DataFrame:
        return self.rows.select("k", "code", "cell")

    @property
    def asked(self) -> int:
        return self.model.asked

    @staticmethod
    def build(vectors: DataFrame, *, key: str, vector: str = "embedding") -> Cells:
        n = vectors.count()
        share = min(1.0, SAMPLE / max(1, n))
        chosen = vectors.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else vectors
        x = _matrix(chosen.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL"))
        x = unit(x) if len(x) else x
        x = x[~np.isnan(x).any(1)]
        model = fitted(x, min(MAX_CELLS, max(1, int(2 * n**0.5))), NEIGHBOURS, n)
        sent = vectors.sparkSession.sparkContext.broadcast(model)
        own = vectors.schema[vector].dataType.simpleString()
        own = own if own == "array<float>" else "array<double>"
        t = vectors.select(F.col(key).alias("k"), F.col(vector).cast(own).alias("v")).filter("k IS NOT NULL AND v IS NOT NULL")
        # A cell of very many rows is filed by several tasks.
        deals = np.ceil(np.maximum(1, model.size if model.size is not None else np.ones(1)) / FILED).astype(np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
                v = unit(_array(b.column(1)))
                real = ~np.isnan(v).any(1)
                keep, v = pa.array(real), v[real]
                cell = sent.value.cells(v)
                code = coded(v - sent.value.centre[cell], sent.value.book)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(deals[cell]), b.column(0).filter(keep), pa.array([r.tobytes() for r in code], pa.binary()), b.column(1).filter(keep)], ["cell", "deals", "k", "code", "v"])

        at = f"{shared_dir(vectors.sparkSession)}/lodeworks/cells-{version(vectors, key, vector)}"
        filed = t.mapInArrow(run, f"cell int, deals int, k {t.schema['k'].dataType.simpleString()}, code binary, v {own}") if len(model.centre) else t.limit(0).select(F.lit(0).alias("cell"), F.lit(1).alias("deals"), "k", F.lit(b"").alias("code"), "v")
        filed = filed.repartition("cell", F.pmod(F.xxhash64("k"), F.col("deals"))).select("k", "code", "v", "cell")
        filed.write.mode("overwrite").partitionBy("cell").parquet(at)
        return Cells(vectors.sparkSession.read.schema(filed.schema).parquet(at), model, key)

    def nearest(self, queries: DataFrame, *, query: str, vector: str = "embedding", k: int = NEIGHBOURS) -> DataFrame:
        """(query, key, distance, dense_rank) of the best ``k`` of each query among the rows of its cells that are near by their codes, measured exactly."""
        kind, own = queries.schema[query].dataType, self.rows.schema["k"].dataType.simpleString()
        found = []
        for ids, q in _blocks(queries, query, vector):
            asked, bound = self._bounds(q, k)
            names = pa.array(ids, to_arrow_type(kind))
            t = self._met(q, asked, bound, k)
            sent = self.rows.sparkSession.sparkContext.broadcast(names)

            def named(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                for b in batches:
                    yield pa.RecordBatch.from_arrays([sent.value.take(b.column(0)), b.column(1), b.column(2)], ["q", "k", "d"])

            found.append(t.select("i", "k", "d").mapInArrow(named, f"q {kind.simpleString()}, k {own}, d double"))
        if not found:
            found = [queries.limit(0).select(F.col(query).alias("q"), F.lit(None).cast(own).alias("k"), F.lit(None).cast("double").alias("d"))]
        d = reduce(DataFrame.union, found).select(F.col("q").alias(query), F.col("k").alias(self.key), F.col("d").alias("distance"))
        return ranked(d, [F.col("distance").asc(), F.col(self.key).asc()], k, by=query, name="dense_rank")

    def _bounds(self, q: np.ndarray, k: int, tell: bool = False) -> tuple:
        """Which cells (queries, all cells) are asked, and how far the k-th row is in the first of them at most; with ``tell`` also how many rows were measured for that."""
        order = self.model.nearest_cells(q)
        asked = np.zeros((len(q), len(self.model.centre)), bool)
        first, bound = asked.copy(), np.full(len(q), np.inf)
        if not order.size:
            return (asked, bound, 0) if tell else (asked, bound)
        np.put_along_axis(asked, order, True, axis=1)
        np.put_along_axis(first, order, self.model.first_cells(q, order, 2 * k), axis=1)
        met = self._met(q, first, None, k)
        last = ranked(met.select("i", "k", "d"), [F.col("d").asc(), F.col("k").asc()], k, by="i").filter(F.col("rank") == k).select("i", "d").toArrow()
        bound[last["i"].to_numpy()] = last["d"].to_numpy()
        if not tell:
            return asked, bound
        size = {r["cell"]: r["n"] for r in self.codes.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        return asked, bound, int(sum(first[:, c].sum() * n for c, n in size.items()))

    def _met(self, q: np.ndarray, asked: np.ndarray, bound: np.ndarray | None, k: int, tell: bool = False) -> DataFrame:
        """(i, k, d): each task's nearest ``k`` rows of each query in the cells that it asks; with a ``bound`` only rows that may be as near by their codes are measured. Or, to ``tell``, how many are looked up and measured."""
        sent = self.rows.sparkSession.sparkContext.broadcast((q, asked, bound, self.model))
        own = self.rows.schema["k"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, asked, bound, model = sent.value
            best, waiting, looked, exact = Nearest(q, k), [], 0, 0

            def rank() -> None:
                if waiting:
                    best.add(*[np.concatenate(x) for x in zip(*waiting, strict=True)])
                    waiting.clear()

            for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
                cell = b.column(3).to_numpy()
                v, keys = unit(_array(b.column(2))), b.column(0).to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for c in np.unique(cell):
                    rows, who = np.flatnonzero(cell == c), np.flatnonzero(asked[:, c])
                    if not len(who):
                        continue
                    most = best.last[who] if bound is None else np.minimum(best.last, bound)[who]
                    if bound is not None:
                        guess = 1 - q[who] @ model.decoded(int(c), code[rows]).T
                        i, j = np.nonzero(guess - model.slack <= most[:, None])
                        if len(i) < guess.size // 8:
                            d = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", q[who[i[n]]], v[rows[j[n]]]) for n in (slice(at, at + ROWS) for at in range(0, len(i), ROWS)))])
                        else:
                            d = (q[who] @ v[rows].T)[i, j]
                    else:
                        i, j = (x.ravel() for x in np.indices((len(who), len(rows))))
                        d = (q[who] @ v[rows].T).ravel()
                    looked, exact = looked + len(who) * len(rows), exact + len(i)
                    d = np.round(np.maximum(0.0, 1 - d), 9)
                    near = np.flatnonzero(d <= most[i])
                    waiting.append((who[i[near]], d[near], keys[rows[j[near]]]))
                    if sum(len(x[0]) for x in waiting) > WAITING:
                        rank()
            if tell:
                yield pa.RecordBatch.from_arrays([pa.array([looked]), pa.array([exact])], ["looked", "exact"])
                return
            rank()
            for n in (slice(at, at + 100_000) for at in range(0, len(best.at), 100_000)):
                yield pa.RecordBatch.from_arrays([pa.array(best.at[n], pa.int32()), pa.array(best.keys[n], to_arrow_type(own)), pa.array(best.d[n])], ["i", "k", "d"])

        open_ = np.flatnonzero(asked.any(0)).tolist()
        # Each task hands on k rows of each query, so there are as many as cores ask for, not as files.
        tasks = max(8, 2 * self.rows.sparkSession.sparkContext.defaultParallelism)
        t = self.rows.filter(F.col("cell").isin(open_)).select("k", "code", "v", "cell").coalesce(tasks)
        return t.mapInArrow(run, "looked long, exact long" if tell else f"i int, k {own.simpleString()}, d double")

    def measured(self, queries: DataFrame, *, query: str, vector: str = "embedding", k: int = NEIGHBOURS) -> tuple[float, float]:
        """The parts of all pairs of queries and vectors whose codes are looked up, and that are measured."""
        n, looked, exact, every = self.codes.count(), 0, 0, 0
        for _, q in _blocks(queries, query, vector):
            asked, bound, first = self._bounds(q, k, tell=True)
            r = self._met(q, asked, bound, k, tell=True).agg(F.sum("looked").alias("looked"), F.sum("exact").alias("exact")).first()
            looked, exact, every = looked + (r["looked"] or 0), exact + first + (r["exact"] or 0), every + n * len(q)
        return (looked / every, exact / every) if every else (0.0, 0.0)


def _array(vectors: pa.Array) -> np.ndarray:
    """(rows, components) of a list array without nulls."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _matrix(vectors: DataFrame) -> np.ndarray:
    """The rows of a bounded frame of one array column."""
    t = vectors.toArrow().column(0).combine_chunks()
    return t.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 1))
