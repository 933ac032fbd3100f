"""Hybrid retrieval: two ranked legs, their fusion, and the bounded choices that follow.

The legs and the fusion are plans over passages. What comes after works on at most
some hundred rows of one question, where each choice depends on those before it;
there the rows are collected and folded in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodeworks.functions.text import content_key, cosine_distance
from lodeworks.vocabulary import BUDGET_BYTES, DENSE_K, FUSED_K, LEXICAL_K, POOL_DENSE_ONLY, POOL_PER_QUERY, RRF_K, SNIPPET_BYTES, TOP_K


#: What is asked is broadcast up to this many rows (some 50 bytes each); queries and vectors are measured in blocks of so many.
BROADCAST_ROWS, QUERY_BLOCK, ROW_BLOCK = 500_000, 4096, 1024


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def ranked(scores: DataFrame, order: Sequence[Column], k: int, *, by: str | None = None, name: str = "rank") -> DataFrame:
    """The best ``k`` rows (of each ``by``), numbered from 1. One ranking takes the top before numbering it."""
    if by is None:
        return scores.orderBy(*order).limit(k).withColumn(name, F.row_number().over(W.orderBy(*order)))
    return scores.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(name) <= k)


def lexical_leg(scores: DataFrame, *, key: str, by: str | None = None, k: int = LEXICAL_K) -> DataFrame:
    return ranked(scores, [F.col("score").desc(), F.col(key).asc()], k, by=by, name="lex_rank")


def dense_leg(vectors: DataFrame, query: Sequence[float], *, key: str, vector: str = "embedding", k: int = DENSE_K) -> DataFrame:
    """The ``k`` nearest vectors by cosine distance; ties by key. Every vector is measured: the exact search."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    d = vectors.select(key, F.round(cosine_distance(F.col(vector), wanted), 9).alias("distance"))
    return ranked(d, [F.col("distance").asc(), F.col(key).asc()], k, name="dense_rank")


def dense_many(vectors: DataFrame, queries: DataFrame, *, key: str, query: str, vector: str = "embedding", k: int = DENSE_K) -> DataFrame:
    """As ``dense_leg`` for a stated set of queries, in blocks: each batch of vectors is measured against a block at once and hands on its best ``k`` for each query.

    Vectors without length have no distance and are not returned.
    """
    found = [_block(vectors, ids, rows, key, query, vector, k, queries.schema[query].dataType) for ids, rows in _blocks(queries, query, vector)]
    if not found:
        found = [_block(vectors.limit(0), [], np.zeros((0, 1)), key, query, vector, k, queries.schema[query].dataType)]
    return ranked(reduce(DataFrame.union, found), [F.col("distance").asc(), F.col(key).asc()], k, by=query, name="dense_rank")


def _blocks(queries: DataFrame, query: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """The queries' ids and unit vectors, ``QUERY_BLOCK`` at a time."""
    ids, rows = [], []
    for r in queries.select(F.col(query).alias("i"), F.col(vector).alias("v")).toLocalIterator():
        ids.append(r["i"])
        rows.append(r["v"])
        if len(ids) == QUERY_BLOCK:
            yield ids, unit(np.array(rows, float))
            ids, rows = [], []
    if ids:
        yield ids, unit(np.array(rows, float))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; rows without length become not-a-number."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, np.nan)


class Nearest:
    """The ``k`` nearest rows to each of ``q`` among those met so far; ties by key. Holds ``k`` rows for each query, whatever comes."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.last, self.last_key = np.full(len(q), np.inf), np.full(len(q), None, object)
        self.at, self.d, self.keys = np.zeros(0, int), np.zeros(0), None

    def meet(self, v: np.ndarray, keys: np.ndarray) -> None:
        """Rows of unit length and their keys, none of them null."""
        self.take(np.round(np.maximum(0.0, 1 - self.q @ v.T), 9), keys)

    def take(self, d: np.ndarray, keys: np.ndarray) -> None:
        """Distances of rows from each of ``q``, not-a-number where there is none, and the rows' keys."""
        if d.shape[1] > self.k:
            # Of one block no more than k rows and the ties of the last can be among the nearest.
            own = np.partition(np.where(np.isnan(d), np.inf, d), self.k - 1, axis=1)[:, self.k - 1]
        else:
            own = self.last
        at, j = np.nonzero(d <= np.minimum(self.last, own)[:, None])
        found = d[at, j]
        tied = np.flatnonzero(found == self.last[at])
        if len(tied):
            good = np.ones(len(at), bool)
            good[tied] = np.array(keys[j[tied]] < self.last_key[at[tied]], bool)
            at, j, found = at[good], j[good], found[good]
        if len(at):
            self.add(at, found, keys[j])

    def add(self, at: np.ndarray, found: np.ndarray, keys: np.ndarray) -> None:
        """Single distances from the queries at places ``at``."""
        at, found, keys = np.r_[self.at, at], np.r_[self.d, found], keys if self.keys is None else np.r_[self.keys, keys]
        order = np.lexsort((np.unique(keys, return_inverse=True)[1], found, at))
        at = at[order]
        start = np.searchsorted(at, np.arange(len(self.q)))
        keep = np.arange(len(at)) - start[at] < self.k
        self.at, self.d, self.keys = at[keep], found[order][keep], keys[order][keep]
        full = np.flatnonzero(np.bincount(self.at, minlength=len(self.q)) == self.k)
        end = np.searchsorted(self.at, full, "right") - 1
        self.last[full], self.last_key[full] = self.d[end], self.keys[end]


def _block(vectors: DataFrame, ids: list, q: np.ndarray, key: str, query: str, vector: str, k: int, kind: T.DataType) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((pa.array(ids, to_arrow_type(kind)), q))
    t = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    own = t.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One task hands on k rows of each query; rows without a key, which numpy cannot order, are kept apart.
        names, q = sent.value
        best, nameless, own_type = Nearest(q, k), Nearest(q, k), to_arrow_type(own)
        for b in (x.slice(at, ROW_BLOCK) for x in batches for at in range(0, x.num_rows, ROW_BLOCK)):
            if b.num_rows and len(names):
                v = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                if known.any():
                    best.meet(v[known], b.column(0).drop_null().to_numpy(zero_copy_only=False))
                if not known.all():
                    nameless.meet(v[~known], np.zeros((~known).sum(), int))
        for part, keys in ((best, best.keys), (nameless, None)):
            for at in range(0, len(part.at), 100_000):
                n = slice(at, at + 100_000)
                key = pa.nulls(len(part.at[n]), own_type) if keys is None else pa.array(keys[n], own_type)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(part.at[n])), key, pa.array(part.d[n])], ["q", "k", "d"])

    out = t.mapInArrow(run, f"q {kind.simpleString()}, k {own.simpleString()}, d double")
    return out.select(F.col("q").alias(query), F.col("k").alias(key), F.col("d").alias("distance"))


def fuse(dense: DataFrame, lexical: DataFrame, *, key: str, by: Sequence[str] = (), k: int = FUSED_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; a leg without the passage adds nothing. Ties by key."""
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    on = [*by, key]
    both = dense.select(*on, "dense_rank").join(lexical.select(*on, "lex_rank"), on, "full")
    both = both.withColumn("rrf", part("dense_rank") + part("lex_rank"))
    order = [F.col("rrf").desc(), F.col(key).asc()]
    out = ranked(both, order, k, name="fused_rank") if not by else both.withColumn("fused_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("fused_rank") <= k)
    both_legs = F.col("dense_rank").isNotNull() & F.col("lex_rank").isNotNull()
    return out.withColumn("legs", F.when(both_legs, "both").when(F.col("dense_rank").isNotNull(), "dense").otherwise("lexical"))


# -- bounded choices ------------------------------------------------------------------


@dataclass(frozen=True)
class Candidate:
    placement: str
    doc: str
    text: str
    rrf: float = 0.0
    dense_rank: int | None = None
    lex_rank: int | None = None
    sub_query: int = 0
    score: float = 0.0


def pool(groups: Sequence[Sequence[Candidate]], limit: int = FUSED_K, per_query: int = POOL_PER_QUERY, dense_only: int = POOL_DENSE_ONLY) -> tuple[list[Candidate], bool]:
    """Joins the groups of the sub-queries: a few places for each (if there are several), a few for what only the dense leg found, the rest by fused score.

    The flag says that places were reserved and the pool is full.
    """
    chosen: dict[str, Candidate] = {}

    def room() -> bool:
        return len(chosen) < limit

    reserved = False
    if len(groups) > 1:
        for g in groups:
            for c in g[: max(0, per_query)]:
                if room() and c.placement not in chosen:
                    chosen[c.placement], reserved = c, True
    left = dense_only
    for c in (c for g in groups for c in g):
        if left > 0 and room() and c.dense_rank and not c.lex_rank and c.placement not in chosen:
            chosen[c.placement], reserved, left = c, True, left - 1
    for c in sorted((c for g in groups for c in g), key=lambda c: -c.rrf):
        if room():
            chosen.setdefault(c.placement, c)
    return list(chosen.values()), reserved and not room()


def rerank(question: str, rows: Sequence[Candidate], scorer: Callable[[str, list[str]], list[float]] | None) -> tuple[list[Candidate], str]:
    """Rows by score, ties in the order given; without a working scorer that order, scores 0 and a warning."""
    try:
        if scorer is None:
            raise RuntimeError("no scorer")
        scores = scorer(question, [r.text for r in rows])
        if len(scores) != len(rows):
            raise ValueError("as many scores as rows are wanted")
    except Exception:
        return [replace(r, score=0.0) for r in rows], "rerank_unavailable"
    out = [replace(r, score=float(s)) for r, s in zip(rows, scores, strict=True)]
    return sorted(out, key=lambda r: -r.score), ""


def text_key(text: str) -> str:
    return " ".join(text.split())


def select(rows: Iterable[Candidate], k: int = TOP_K, floor: float = 0.0) -> tuple[list[Candidate], int]:
    """Up to ``k`` rows in order, one for each document and each text. A row that is passed over for its text leaves its document open.

    Also how many rows lie under the floor, whatever was picked before them.
    """
    picked, docs, texts, under = [], set(), set(), 0
    for r in rows:
        if r.score < floor:
            under += 1
        elif len(picked) < k and r.doc not in docs:
            key = text_key(r.text)
            if key and key in texts:
                continue
            picked.append(r)
            docs.add(r.doc)
            texts.add(key)
    return picked, under


@dataclass
class Budget:
    """Admits texts whole or not at all; a refusal does not end it."""

    allowed: int = BUDGET_BYTES
    used: int = 0
    truncated: bool = False

    def admit(self, text: str) -> str:
        size = len(text.encode())
        if self.used + size > self.allowed:
            self.truncated = True
            return ""
        self.used += size
        return text


@dataclass
class Packet:
    match: Candidate
    text: str = ""
    snippet: str = ""
    related: list[dict] = field(default_factory=list)


def short(text: str, limit: int = SNIPPET_BYTES) -> str:
    plain = " ".join(text.split())
    raw = plain.encode()
    if len(raw) <= limit:
        return plain
    cut = raw[:limit].decode(errors="ignore")
    head = cut.rpartition(" ")[0]
    return (head if len(head.encode()) > limit // 2 else cut) + "…"


def packets(picked: Sequence[Candidate], texts: dict[str, str], related: Sequence[dict], budget: int = BUDGET_BYTES) -> tuple[list[Packet], Budget]:
    """Evidence in order: first the picked documents' texts, then their relations' (parents, attachments, siblings).

    ``related``: rows with anchor, doc and relation. Each related document goes to
    one packet, by relation, then by the packets' order.
    """
    bound, out = Budget(budget), []
    for c in picked:
        out.append(Packet(c, bound.admit(texts.get(c.doc, "")), short(c.text)))
    at = {p.match.doc: i for i, p in enumerate(out)}
    given: set[str] = set()
    for relation in ("parent", "attachment", "sibling"):
        own = sorted((r for r in related if r["relation"] == relation and r["anchor"] in at), key=lambda r: (at[r["anchor"]], r["doc"]))
        for r in own:
            if r["doc"] in given or r["doc"] in at:
                continue
            given.add(r["doc"])
            out[at[r["anchor"]]].related.append({"doc": r["doc"], "relation": relation, "text": bound.admit(texts.get(r["doc"], ""))})
    return out, bound


def sub_queries(lines: Iterable[str], most: int = 4) -> list[str]:
    """Different queries, the first spelling of each; most counts as 4 where it is not positive."""
    kept: dict[str, str] = {}
    for x in lines:
        x = x.strip().lstrip("-*0123456789. \t").strip()
        if x:
            kept.setdefault(" ".join(x.lower().split()), x)
    return list(kept.values())[: most if most > 0 else 4]


def decompose(question: str, model: Callable[[str], str] | None) -> tuple[list[str], str]:
    """The model's sub-queries; the question itself and a warning where it fails."""
    try:
        found = sub_queries(model(question).splitlines()) if model else []
    except Exception:
        found = []
    return (found, "") if found else ([question], "" if model is None else "decompose_unavailable")


def neighbours(containment: DataFrame, documents: DataFrame, matched: DataFrame) -> DataFrame:
    """(doc_id, relation, anchor_id) one step around matched documents: containers, contained, and those that share a container.

    ``containment``: container_id, contained_id. ``documents``: doc_id, status,
    dated. ``matched``: doc_id. Only completed documents that are not matched
    themselves; each once, by its closest relation and least anchor.
    """
    e, m = containment, _small(matched.select(F.col("doc_id").alias("anchor_id")).distinct())
    up = e.join(m, e.contained_id == m.anchor_id).select(F.col("container_id").alias("doc_id"), "anchor_id", F.lit(1).alias("r"))
    down = e.join(m, e.container_id == m.anchor_id).select(F.col("contained_id").alias("doc_id"), "anchor_id", F.lit(2).alias("r"))
    # Of the matched documents of one container only the least can be a sibling's anchor, so each container comes once.
    least = _small(up.groupBy(F.col("doc_id").alias("container_id")).agg(F.min("anchor_id").alias("anchor_id")))
    side = e.join(least, "container_id")
    side = side.select(F.col("contained_id").alias("doc_id"), "anchor_id", F.lit(3).alias("r"))
    every = up.unionByName(down).unionByName(side).join(m.withColumnRenamed("anchor_id", "doc_id"), "doc_id", "left_anti")
    best = every.groupBy("doc_id").agg(F.min(F.struct("r", "anchor_id")).alias("b"))
    names = F.element_at(F.array(F.lit("parent"), F.lit("attachment"), F.lit("sibling")), F.col("b.r"))
    done = documents.filter(F.col("status") == "COMPLETED")
    return best.join(done, "doc_id").select("doc_id", names.alias("relation"), F.col("b.anchor_id").alias("anchor_id"))


def dedup_passages(passages: DataFrame, *, model: str, text: str, order: Sequence[str]) -> DataFrame:
    """One passage of each model and text (up to white space): the first by ``order``."""
    best = W.partitionBy(model, "_hash").orderBy(*order)
    t = passages.withColumn("_hash", content_key(F.col(text)))
    return t.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_hash")
