"""A question answered from the tables: the whole read path, and pages of its result."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import retrieval as R
from lodeworks.operators.mailbox import page_bytes
from lodeworks.operators.terms import TermIndex
from lodeworks.vocabulary import BUDGET_BYTES, DENSE_K, FUSED_K, LEXICAL_K, TOP_K


@dataclass
class Tables:
    """``placements``: placement_id, chunk_id, doc_id. ``chunks``: chunk_id, chunk_text, embedding. ``documents``: doc_id, text, status. ``containment``: container_id, contained_id.

    ``index``: the stored index of the chunks by chunk_id; without it one is built, and found again while the chunks' files stay.
    """

    placements: DataFrame
    chunks: DataFrame
    documents: DataFrame
    containment: DataFrame
    index: TermIndex | None = None


@dataclass
class Result:
    question: str
    sub_queries: list[str]
    packets: list[R.Packet] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    used: int = 0
    floored: int = 0


def search(
    question: str, t: Tables, *, embed: Callable[[list[str]], list[list[float]]], scorer: Callable[[str, list[str]], list[float]] | None = None,
    planner: Callable[[str], str] | None = None, top_k: int = TOP_K, budget: int = BUDGET_BYTES, floor: float = 0.0,
) -> Result:
    """Ranks placements, chooses one passage a document, follows containment, packs whole texts. Model failures are warnings."""
    if not question.strip() or len(question) > 8192 or not 1 <= top_k <= 50:
        raise ValueError("a question of at most 8192 characters and 1 to 50 results")
    spark = t.chunks.sparkSession
    asked, warning = R.decompose(question, planner)
    warnings = [warning] if warning else []
    placed = t.placements.join(t.chunks.select("chunk_id", "chunk_text", "embedding"), "chunk_id")
    index = t.index or TermIndex.build(t.chunks.select("chunk_id", "chunk_text"), key="chunk_id", text="chunk_text")
    # All sub-queries in one plan.
    one = spark.createDataFrame([(n, q, list(map(float, v))) for n, (q, v) in enumerate(zip(asked, embed(asked), strict=True))], "query_id int, query string, embedding array<double>")
    dense = R.dense_many(placed, one, key="placement_id", query="query_id")
    scores = index.best(one, LEXICAL_K, digits=9).join(t.placements, "chunk_id")
    fused = R.fuse(dense, R.lexical_leg(scores, key="placement_id", by="query_id"), key="placement_id", by=["query_id"])
    # Texts are fetched for the few that are left.
    rows = placed.select("placement_id", "doc_id", "chunk_text").join(F.broadcast(fused), "placement_id").orderBy("query_id", "fused_rank").collect()
    groups: list[list[R.Candidate]] = []
    for n in range(len(asked)):
        own = [r for r in rows if r["query_id"] == n]
        if len(own) < FUSED_K and sum(r["dense_rank"] is not None for r in own) < DENSE_K:
            warnings.append("dense_leg_underfill")
        groups.append([R.Candidate(str(r["placement_id"]), str(r["doc_id"]), r["chunk_text"], r["rrf"], r["dense_rank"], r["lex_rank"], n) for r in own])
    pooled, reserved = R.pool(groups)
    if reserved:
        warnings.append("pool_floor_applied")
    ranked, warning = R.rerank(question, pooled, scorer)
    if warning:
        warnings.append(warning)
    picked, under = R.select(ranked, top_k, floor)
    matched = spark.createDataFrame([(c.doc,) for c in picked], "doc_id string")
    texts_of = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "status")
    edges = t.containment.select(F.col("container_id").cast("string").alias("container_id"), F.col("contained_id").cast("string").alias("contained_id"))
    near = R.neighbours(edges, texts_of, matched).collect()
    related = [{"anchor": r["anchor_id"], "doc": r["doc_id"], "relation": r["relation"]} for r in near]
    wanted = spark.createDataFrame([(d,) for d in {c.doc for c in picked} | {r["doc"] for r in related}], "doc_id string")
    texts = {r["doc_id"]: r["text"] or "" for r in texts_of.join(F.broadcast(wanted), "doc_id").collect()}
    packets, bound = R.packets(picked, texts, related, budget)
    if bound.truncated:
        warnings.append("budget_truncated")
    return Result(question, asked, packets, list(dict.fromkeys(warnings)), bound.used, under)


class Snapshots:
    """Results kept for reading in pages: the least used goes when there are too many, too many bytes, or after its time."""

    def __init__(self, most: int = 8, size: int = 2 << 20, ttl: float = 600.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.size, self.ttl, self.clock = most, size, ttl, clock
        self.held: OrderedDict[str, tuple[float, list[str]]] = OrderedDict()

    def put(self, texts: list[str]) -> str:
        """The key of a result; texts are kept in order."""
        bytes_ = sum(len(t.encode()) for t in texts)
        if bytes_ > self.size:
            raise ValueError("the result is too large to keep")
        key = "R" + hashlib.sha256("\0".join(texts).encode()).hexdigest()[:12]
        self.held[key] = (self.clock(), texts)
        self.held.move_to_end(key)
        self._shed()
        return key

    def page(self, key: str, n: int, at: int = 0, most: int = 48 << 10) -> tuple[str, int | None]:
        """A part of the text ``n`` and where the rest begins; reading renews the result's time."""
        self._shed()
        if key not in self.held:
            raise KeyError(f"{key} is not kept any more")
        _, texts = self.held[key]
        self.held[key] = (self.clock(), texts)
        self.held.move_to_end(key)
        return page_bytes(texts[n], most, at)

    def _shed(self) -> None:
        now = self.clock()
        for k in [k for k, (t, _) in self.held.items() if now - t > self.ttl]:
            del self.held[k]
        total = lambda: sum(len(x.encode()) for _, ts in self.held.values() for x in ts)
        while len(self.held) > self.most or total() > self.size:
            self.held.popitem(last=False)
