"""Compression of vectors to codes of nearest codebook entries, found by segment-mean lower bounds.

Vectors become integers and are cut into equal parts; each part has a codebook,
which a few rounds of reassignment refit. To find a part's nearest entry, both are
described by the means of blocks of components and by what is left of each block: with
w components in a block, w * (difference of means)^2 + (difference of the residuals'
norms)^2 is never more than the block's squared distance. One block for the whole part
comes first, then halves of halves; entries whose bound passes the distance of an
entry already measured go, and only the others are measured in whole numbers.

The integers are stored once and read in each round; codebooks (bounded by parts,
entries and components) travel with the tasks, whose sums come back added up, at most
one row for each entry.

Defined results: rows with a null vector or a null or non-finite component take no part;
null ids come after all others and their rows are coded like any; rows that repeat an id
stand each (for the first codebook in order of id, then of components); fewer rows than
entries give a smaller codebook; a null label is a label of its own; an empty table gives
an empty one; other columns are not read. Vectors of different lengths, of a length that
the parts do not divide, or so great that sums of squares pass 64 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import BROADCAST_KEYS, Spread, stored, within

#: Rows compared with a codebook at once: what a task holds is bounded by rows times entries.
BLOCK = 1024
#: Lower bounds are held to be this much lower, in part and in units, so that rounding never drops an entry.
SLACK, UNITS = 1e-9, 1e-3
#: A greater unit would make sums of squares pass 64 bits.
MOST_UNITS = 1 << 27


def usable(vector: Column) -> Column:
    """Whether a vector is there, with finite components only."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def units(vector: Column, scale: int) -> Column:
    """Components as floors of so many units; a component too great for exact sums is an error."""
    far = F.raise_error(F.lit(f"a component is beyond {MOST_UNITS} units"))
    return F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) <= MOST_UNITS, F.floor(x.cast("double") * scale).cast("int")).otherwise(far.cast("int")))


def prepared(vectors: DataFrame, scale: int, key: str, vector: str, label: str) -> DataFrame:
    """(_id, _label, _x) of the usable rows."""
    return vectors.filter(usable(F.col(vector))).select(F.col(key).alias("_id"), F.col(label).alias("_label"), units(F.col(vector), scale).alias("_x"))


def width(rows: DataFrame, parts: int = 1) -> int:
    """The length that all vectors have (0 without any). Sums of products of two vectors, and of squared differences, then fit 64 bits."""
    most = F.greatest(F.array_max("_x"), -F.array_min("_x"))
    r = rows.agg(F.min(F.size("_x")).alias("a"), F.max(F.size("_x")).alias("b"), F.max(most).alias("most")).first()
    if r["a"] != r["b"] or (r["a"] or 0) % parts:
        raise ValueError(f"vectors of {r['a']} to {r['b']} components can't be cut into {parts} equal parts")
    if (r["a"] or 0) * (2 * (r["most"] or 0)) ** 2 >= 1 << 63:
        raise ValueError(f"{r['a']} components of up to {r['most']} units are beyond exact sums of 64 bits")
    return r["a"] or 0


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def segments(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and norms of the residuals of equal blocks of each row, (rows, blocks)."""
    cut = x.astype(float).reshape(len(x), blocks, -1)
    mean = cut.mean(2)
    return mean, np.sqrt(((cut - mean[:, :, None]) ** 2).sum(2))


def levels(d: int) -> list[int]:
    """Numbers of blocks from coarse to fine: 1, 4, then of two components each, as far as they divide ``d``."""
    return [n for n in dict.fromkeys((1, 4, d // 2)) if n and n < d and d % n == 0] if d else []


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry (ties to the lower), and how many entries were measured exactly."""
    if not v.shape[1]:
        return np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), 0
    d, steps = v.shape[1], levels(v.shape[1])
    own, other = [segments(v, n) for n in steps], [segments(book, n) for n in steps]
    exact = lambda i, j: ((v[i] - book[j]) ** 2).sum(1)
    rows = np.arange(len(v))
    if steps:
        w, (m, r), (bm, br) = d // steps[0], own[0], other[0]
        bound = sum(w * (m[:, k, None] - bm[None, :, k]) ** 2 + (r[:, k, None] - br[None, :, k]) ** 2 for k in range(steps[0]))
        likely = bound.argmin(1)
    else:
        bound, likely = np.zeros((len(v), len(book))), np.zeros(len(v), np.int64)
    best = exact(rows, likely)
    i, j = np.nonzero(bound * (1 - SLACK) - UNITS <= best[:, None])
    for n, (m, r), (bm, br) in list(zip(steps, own, other, strict=True))[1:]:
        low = (d // n) * ((m[i] - bm[j]) ** 2).sum(1) + ((r[i] - br[j]) ** 2).sum(1)
        # The entry of the least finer bound is measured, so that the next test is a sharper one.
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        least = np.repeat(np.minimum.reduceat(low, first), np.diff(np.r_[first, len(i)])) == low
        np.minimum.at(best, i[least], exact(i[least], j[least]))
        keep = low * (1 - SLACK) - UNITS <= best[i]
        i, j = i[keep], j[keep]
    dist, first = exact(i, j), np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    size = np.diff(np.r_[first, len(i)])
    least = np.minimum.reduceat(dist, first)
    # The pairs of a row stand by entry, so its first pair of least distance is that of the lower entry.
    at = np.flatnonzero(dist == np.repeat(least, size))
    at = at[np.r_[True, i[at][1:] != i[at][:-1]]]
    return j[at], least, len(i)


def _coded(batches: Iterator[pa.RecordBatch], column: int, books: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    for b in (x.slice(at, BLOCK) for x in batches for at in range(0, x.num_rows, BLOCK)):
        cut = np.split(matrix(b.column(column), b.num_rows), len(books), axis=1)
        yield b, [(v, *nearest(v, book)[:2]) for v, book in zip(cut, books, strict=True)]


def refitted(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the floor of its parts' mean; entries without parts stay."""
    d = books[0].shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in sent.value]
        total = [np.zeros_like(b) for b in sent.value]
        for _, parts in _coded(batches, 0, sent.value):
            for p, (v, j, _) in enumerate(parts):
                count[p] += np.bincount(j, minlength=len(count[p]))
                np.add.at(total[p], j, v)
        for p in range(len(count)):
            e = np.flatnonzero(count[p])
            sums = [pa.array(total[p][e, k]) for k in range(d)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), p, np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p][e]), *sums], ["p", "e", "n", *[f"s{k}" for k in range(d)]])

    schema = "p int, e int, n long" + "".join(f", s{k} long" for k in range(d))
    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in range(d)]
    out = [b.copy() for b in books]
    for r in rows.select("_x").mapInArrow(run, schema).groupBy("p", "e").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["p"]][r["e"]] = [r[f"s{k}"] // r["n"] for k in range(d)]
    sent.destroy()
    return out


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The parts' codebooks after all rounds; the first ones are the parts of the rows of the least ids."""
    d = width(rows, parts)
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(entries).collect()
    books = np.split(np.array([r["_x"] for r in first], np.int64).reshape(len(first), d), parts, axis=1)
    for _ in range(rounds if first else 0):
        books = refitted(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row; ``entries`` is 256 at most."""
    rows = stored(prepared(vectors, scale, key, vector, label), "vector-units")
    books = codebooks(rows, parts, entries, rounds)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _coded(batches, 2, sent.value):
            index = np.stack([j for _, j, _ in found], axis=1).astype(np.uint8)
            error = sum((e for _, _, e in found), np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in index], pa.string()), pa.array(error)], ["_id", "_label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = stored(rows.select("_id", "_label", "_x").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long"), "codes")
    # Null labels stand together, apart from all that are there.
    coded = coded.withColumn("_by", F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit("")))
    told = stored(coded.groupBy("_by").agg(F.sum("error").alias("_sum"), F.count("*").alias("_n")), "label-errors")
    facts = told.select("_by", "_sum")
    out = coded.join(F.broadcast(facts), "_by") if within(told, BROADCAST_KEYS) else Spread(told, "_by", "_n", "hot-labels").join(coded, facts)
    return out.select(F.col("_id").alias(key), "code", "error", F.col("_sum").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
