"""Exact dedup against grouping whole texts, with hashes that clash, and the cut itself."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import chunk_recipes, common
from tests.llm.test_small import IDS, TEXTS, docs

LOWER = str.maketrans(common.UPPER, common.LOWER)


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        kept = False
        for i in ids:
            out.append((str(i), str(best), len(ids), i == best and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept = kept or i == best
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def many(n):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "漢字", "é", "x" * 900, "\n"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 700))) for _ in range(40)]
    texts = [rng.choice(base) for _ in range(n)]
    texts = [t.upper() if t.isascii() and rng.random() < 0.3 else t + rng.choice(["", "", "", "!"]) for t in texts]
    texts += ["ab" * 40_000, "ab" * 40_000 + "c", "AB" * 40_000, "É", "é"]
    return list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))


@pytest.mark.parametrize("bits", [64, 3])
def test_equal_to_grouping_texts(spark, bits):
    rows = many(300)
    assert got(chunk_recipes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits)) == expected(rows)


@pytest.mark.parametrize("bits", [64, 2])
def test_beyond_the_broadcasts(spark, monkeypatch, bits):
    rows = many(200) + [(20_000 + i, "hot " * 100) for i in range(100)]
    monkeypatch.setattr(common, "HOT_ROWS", 16)
    monkeypatch.setattr(chunk_recipes, "BROADCAST_KEYS", 3)
    assert got(chunk_recipes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits)) == expected(rows)


def test_hard_rows(spark):
    d = docs(spark, TEXTS, IDS).withColumn("_text", F.lit("x")).withColumn("_whole", F.lit(1)).withColumn("keep_id", F.lit(2))
    assert got(chunk_recipes.deduplicate(d)) == expected(list(zip(IDS, TEXTS, strict=True)))
    assert chunk_recipes.deduplicate(d.limit(0)).count() == 0
    twice = d.union(d)
    assert got(chunk_recipes.deduplicate(twice)) == expected(list(zip(IDS, TEXTS, strict=True)) * 2)


def test_text_keys(spark):
    rows = [("b", "T"), ("a", "t"), (None, "t")]
    out = chunk_recipes.deduplicate(spark.createDataFrame(rows, "name string, body string"), key="name", text="body").collect()
    assert {(r["name"], r["keep_id"], r["kept"]) for r in out} == {("b", "b", True), ("a", "b", False), (None, "b", False)}


def test_cut(spark):
    """Chunks are the whole text, within their bounds, and meet again after an insertion."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß漢", k=rng.randint(2, 9))) for _ in range(20_000))
    rows = [(0, long), (1, "new words first " + long), (2, "q" * 100_000), (3, ""), (4, "short")]
    t = spark.createDataFrame(rows, "i int, text string").select("i", "text", chunk_recipes.chunks(F.col("text")).alias("c"))
    parts = {r["i"]: (r["text"], r["c"]) for r in t.collect()}
    for text, c in parts.values():
        size = [len(x) for x in c]
        assert "".join(c).encode("latin-1").decode() == text and max(size, default=0) <= chunk_recipes.MOST and min(size[:-1], default=256) >= chunk_recipes.LEAST
    assert len(set(parts[0][1]) & set(parts[1][1])) > 0.9 * len(parts[0][1]) > 50
