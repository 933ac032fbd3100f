"""Literal search by signatures against searching every text."""

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import mailbox, spans
from lodeworks.operators.spans import SpanIndex

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select("needle_id", "doc_id", "position", "context").collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "ΟΔΟΣ", "ΟΔΟΣΑ", "İstanbul", "漢字", "\U0001f600\U0001f601", "a", "b", "\n", "ÅNG", "Kelvin", "x" * 500]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", " \t\n ", "ab", "a", "tail end"]
    return spark.createDataFrame([(i % 290, t) for i, t in enumerate(texts)], "doc_id long, text string")


NEEDLES = ["alpha Beta", "beta", "A", "ab", "İstanbul", "i̇stanbul", "οδος", "ΟΔΟΣ ", "ΟΔΟΣΑ", "字", "漢字 a", "\U0001f600\U0001f601", "\U0001f601", "Kelvin", "kelvin", "end", "no such", "", "  ", None, "x" * 400, "alpha\n\tBeta", "ång", "q"]


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_same_as_searching_every_text(spark, docs, monkeypatch, fold, small):
    needles = spark.createDataFrame(list(enumerate(NEEDLES)), "needle_id int, needle string")
    if small:
        for name in ("BROADCAST", "NAMED"):
            monkeypatch.setattr(spans, name, 0)
    index = SpanIndex.build(docs, key="doc_id", text="text", folder=100, part=64)
    want = rows(mailbox.needles_in(docs, needles, text=F.col("text"), key=["doc_id"], fold=fold))
    assert len(want) > 500 and rows(index.find(needles, fold=fold)) == want


def test_random_needles(spark, docs):
    texts = [r["text"] for r in docs.filter("length(text) > 40").collect()]
    rng = random.Random(9)
    cut = [(i, t[a : a + rng.randint(1, 30)]) for i, t in enumerate(texts) if (a := rng.randrange(len(t))) >= 0]
    needles = spark.createDataFrame(cut, "needle_id int, needle string")
    index = SpanIndex.build(docs, key="doc_id", text="text")
    for fold in (False, True):
        assert rows(index.find(needles, fold=fold)) == rows(mailbox.needles_in(docs, needles, text=F.col("text"), key=["doc_id"], fold=fold))


def test_reads_little_and_never_nests_loops(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = SpanIndex.build(d, key="doc_id", text="text", path=f"{tmp_path}/spans", folder=500, part=8)
    text = d.filter("length(text) > 200").orderBy("doc_id").first()["text"]
    needles = spark.createDataFrame([(1, text[50:90])], "needle_id int, needle string")
    found = index.find(needles)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.count() >= 1
    texts = index.texts.join(index.candidates(needles.select("needle_id", F.col("needle").alias("_n"), F.lower("needle").alias("_f"))), "place", "left_semi")
    assert texts.count() < index.texts.count() / 4
    again = SpanIndex.open(spark, f"{tmp_path}/spans")
    assert rows(again.find(needles)) == rows(found) and index.folders > 10


def test_limits_and_nothing(spark, docs, monkeypatch):
    index = SpanIndex.build(docs.limit(0), key="doc_id", text="text")
    needles = spark.createDataFrame([(1, "alpha")], "needle_id int, needle string")
    assert index.find(needles).count() == 0 and SpanIndex.build(docs, key="doc_id", text="text").find(needles.limit(0)).count() == 0
    monkeypatch.setattr(spans, "MAX_NEEDLES", 0)
    with pytest.raises(ValueError, match="at most 0"):
        index.find(needles)
