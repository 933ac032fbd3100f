"""Hard negatives by a vector-approximation file.

Every dimension is cut into cells of one width between its least and greatest value, and
each row keeps its cells beside its components. For an anchor, a table gives what each
cell of each dimension adds to the score at least; a row's lower bound is the sum of what
its cells look up there, and as the cells of a dimension are equally wide, its upper
bound is that sum and one number of the anchor's. Only rows whose bounds may bring them
into a window are scored exactly: first into the best of an anchor's label, then, for each
of those positives, into the best rows of other labels under the positive's score.
Bounds and scores are whole numbers, so nothing is lost to rounding.

The file is stored once. Anchors go out in blocks (a stated query set), and a
task keeps a running best of each window, which sharpens its next tests; what it hands on
is at most the places of its windows, and these meet by anchor.

Defined results: rows with a null label, a null vector or a null or non-finite component take
no part; rows that repeat an id are rows of their own, so an anchor may have a copy of
itself as positive, and an anchor that repeats returns its rows each time; null ids are
no anchors, come last among ties and may be returned; anchors without positives and
positives without negatives have no rows; an empty table gives an empty one; other
columns are not read. Vectors of different lengths or with components beyond 2^27
units (or sums beyond 64 bits) are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import stored
from lodeworks.llm.vector_codes import matrix, prepared, width

#: Cells of a dimension; anchors in a block; rows looked up at once (a task holds that many times the dimensions).
CELLS, ANCHORS, ROWS = 64, 2048, 4096
#: Stands for "no score yet"; no sum of products comes near it.
NONE = np.iinfo(np.int64).min // 2
#: Stands for an id that isn't there, after all others.
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Grid:
    """Each dimension's least value, and how wide its cells are."""

    least: np.ndarray
    wide: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x - self.least) // self.wide

    def table(self, a: np.ndarray, cells: int) -> tuple[np.ndarray, int]:
        """What each cell (dimension, cell) adds to a score with ``a`` at least, and how much more all together may add."""
        low = self.least[:, None] + np.arange(cells)[None] * self.wide[:, None]
        ends = low * a[:, None], (low + self.wide[:, None] - 1) * a[:, None]
        return np.minimum(*ends), int((np.abs(a) * (self.wide - 1)).sum())


def grid(rows: DataFrame, cells: int) -> Grid:
    """Cells over all rows: one small row for each dimension comes back."""
    t = rows.select(F.posexplode("_x").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    found = sorted((r["d"], r["a"], r["b"]) for r in t.collect())
    least, most = (np.array([r[i] for r in found], np.int64) for i in (1, 2))
    return Grid(least, (most - least) // cells + 1)


def approximated(rows: DataFrame, g: Grid) -> DataFrame:
    """``rows`` with a number of their own and their cells, stored: the file that searches read."""
    sent = rows.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = sent.value.cells(matrix(b.column(3), b.num_rows)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in c], pa.binary())], ["_row", "_id", "_label", "_x", "_cells"])

    t = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", F.col("_label").cast("string").alias("_label"), "_x")
    return stored(t.mapInArrow(run, f"_row long, _id {t.schema['_id'].dataType.simpleString()}, _label string, _x array<int>, _cells binary"), "approximations")


class Best:
    """The best ``k`` of each of some windows by score, then id; ``floor`` is what a row must reach to enter."""

    def __init__(self, windows: int, k: int):
        self.score, self.id, self.row = np.full((windows, k), NONE), np.zeros((windows, k), np.int64), np.full((windows, k), -1)

    def floor(self, w: int) -> int:
        return int(self.score[w, -1])

    def add(self, w: int, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        s, i, r = np.r_[self.score[w], score], np.r_[self.id[w], id_], np.r_[self.row[w], row]
        order = np.lexsort((r, i, -s))[: self.score.shape[1]]
        self.score[w], self.id[w], self.row[w] = s[order], i[order], r[order]


@dataclass(frozen=True)
class Block:
    """Some anchors (row numbers, ids, labels, vectors) and their windows (place of the anchor, least and greatest score)."""

    row: np.ndarray
    id: np.ndarray
    label: list[str]
    x: np.ndarray
    windows: list[tuple[int, int, int]]


def searched(file: DataFrame, g: Grid, block: Block, cells: int, k: int, *, same: bool) -> DataFrame:
    """(_window, _nth, _id, _score): the best ``k`` rows of each window, of the anchor's label (but for itself) or of other ones."""
    sent = file.sparkSession.sparkContext.broadcast((g, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, block = sent.value
        own: list[list[int]] = [[] for _ in block.row]
        for w, (a, _, _) in enumerate(block.windows):
            own[a].append(w)
        best = Best(len(block.windows), k)
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            row, label = b.column(0).to_numpy(), np.array(b.column(2).to_pylist(), object)
            id_ = b.column(1).fill_null(NO_ID).to_numpy()
            x = matrix(b.column(3), b.num_rows)
            places = np.arange(x.shape[1], dtype=np.int32) * cells
            code = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint16).reshape(x.shape).astype(np.int32) + places
            group = {name: np.flatnonzero((label == name) == same) for name in set(block.label)}
            codes = {name: code[at] for name, at in group.items()}
            for a, name in enumerate(block.label):
                at = group[name]
                if not own[a] or not len(at):
                    continue
                table, more = g.table(block.x[a], cells)
                low = table.ravel()[codes[name]].sum(1)
                high = low + more
                other = row[at] != block.row[a]
                for w in own[a]:
                    _, least, most = block.windows[w]
                    may = (high >= max(best.floor(w), least)) & (low <= most) & other
                    # Of rows that are surely inside, the k-th greatest lower bound is a floor too.
                    sure = low[may & (low >= least) & (high <= most)]
                    if len(sure) > k:
                        may &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                    there = at[may]
                    if len(there):
                        score = x[there] @ block.x[a]
                        inside = (score >= max(best.floor(w), least)) & (score <= most)
                        best.add(w, score[inside], id_[there][inside], row[there][inside])
        w, i = np.nonzero(best.row >= 0)
        found = best.id[w, i]
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(best.row[w, i]), pa.array(found, mask=found == NO_ID), pa.array(best.score[w, i])], ["_window", "_row", "_id", "_score"])

    t = file.select("_row", "_id", "_label", "_x", "_cells").mapInArrow(run, "_window int, _row long, _id long, _score long")
    # At most k rows of a window from each task.
    nth = F.row_number().over(W.partitionBy("_window").orderBy(F.col("_score").desc(), F.col("_id").asc_nulls_last(), "_row"))
    return t.withColumn("_nth", nth).filter(F.col("_nth") <= k).select("_window", "_nth", "_id", "_score")


def blocks(file: DataFrame, every: int) -> Iterator[Block]:
    """The anchors, ``ANCHORS`` at a time, each with one window that takes all scores."""
    held: list[Row] = []
    for r in file.filter(F.col("_id") % every == 0).select("_row", "_id", "_label", "_x").toLocalIterator():
        held.append(r)
        if len(held) == ANCHORS:
            yield _block(held)
            held = []
    if held:
        yield _block(held)


def _block(rows: list[Row]) -> Block:
    x = np.array([r["_x"] for r in rows], np.int64).reshape(len(rows), -1)
    every = [(a, NONE, -NONE) for a in range(len(rows))]
    return Block(np.array([r["_row"] for r in rows]), np.array([r["_id"] for r in rows]), [r["_label"] for r in rows], x, every)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, cells: int = CELLS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, whose ids ``every`` divides.

    For each of an anchor's first ``positives`` other rows of its label, the first ``negatives`` rows of other labels
    that have at least ``percent`` of a hundred of the positive's score and no more than it.
    """
    spark = vectors.sparkSession
    rows = stored(prepared(vectors.filter(F.col(label).isNotNull()).withColumn(key, F.col(key).cast("long")), scale, key, vector, label), "vector-units")
    width(rows)
    g = grid(rows, cells)
    file, found = approximated(rows, g), []
    for block in blocks(file, every):
        pairs = sorted(tuple(r) for r in searched(file, g, block, cells, positives, same=True).collect())
        pairs = [(w, id_, score) for w, _, id_, score in pairs if score >= 0]
        windows = [(w, -(-percent * score // 100), score) for w, _, score in pairs]
        near = searched(file, g, replace(block, windows=windows), cells, negatives, same=False)
        told = spark.createDataFrame([(n, int(block.id[w]), id_, score) for n, (w, id_, score) in enumerate(pairs)], "_window int, anchor_id long, positive_id long, positive_score long")
        out = near.join(F.broadcast(told), "_window")
        found.append(stored(out.select("anchor_id", "positive_id", F.col("_nth").alias("rank"), F.col("_id").alias("negative_id"), "positive_score", F.col("_score").alias("negative_score")), "negatives"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)
