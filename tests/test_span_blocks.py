"""The literal index makes rows of blocks of texts, not of the grams of each text, and loses none by how tasks and workers cut them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import mailbox, spans
from lodeworks.operators.spans import SpanIndex
from tests.sizes import most_rows

WORDS = ["alpha", "Beta", "ΟΔΟΣ", "İstanbul", "漢字", "\U0001f600\U0010ffff", "\u0000x", "a", "\n", "Kelvin", "ÅNG"]


def rows(df):
    return sorted(map(tuple, df.select("needle_id", "doc_id", "position", "context").collect()), key=str)


def test_building_makes_no_row_of_each_gram_and_text(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=2000))) for i in range(1024)], "doc_id long, text string")
    pairs = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?=(...))"), F.lit(1))))).count()
    made = most_rows(spark, lambda: SpanIndex.build(docs, key="doc_id", text="text", path=f"{tmp_path}/spans").grams)
    assert made * 10 < pairs


@pytest.mark.parametrize("held", [1, 100, 1 << 22])
def test_slots_and_blocks_that_are_cut_lose_nothing(spark, monkeypatch, held):
    monkeypatch.setattr(spans, "HELD", held)
    rng = random.Random(2)
    texts = ["".join(rng.choices([*WORDS, " "], k=rng.randint(0, 40))) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = SpanIndex.build(docs, key="doc_id", text="text", folder=50, part=64)
    cut = [t[a : a + rng.randint(1, 12)] for t in texts[:150] if t for a in [rng.randrange(len(t))]]
    needles = spark.createDataFrame(list(enumerate([*cut, *WORDS])), "needle_id int, needle string")
    for fold in (False, True):
        assert rows(index.find(needles, fold=fold)) == rows(mailbox.needles_in(docs, needles, text=F.col("text"), key=["doc_id"], fold=fold))


@pytest.mark.parametrize("piece", [1, 2, 3, 1000])
def test_grams_of_pieces_are_those_of_the_text(spark, monkeypatch, piece):
    monkeypatch.setattr(spans, "PIECE", piece)
    for t in ["", "a", "ab", "abc", "ab\u0000\U0010ffffcd漢字", "".join(WORDS)]:
        want = {t[i : i + 3] for i in range(len(t))}
        asked = spark.createDataFrame([(g,) for g in want], "g string").select(spans.coded(F.col("g"))).collect()
        assert {int(x) for g in spans._grams_of(t) for x in g} == {r[0] for r in asked} and len(asked) == len({r[0] for r in asked})


def test_all_places_of_a_slot_and_shorter_grams():
    grams = [np.sort(next(spans._grams_of(t))) for t in ("abcd", "xab", "b")]
    gram, mask = spans._of_slot(grams, [0, 63, 5])
    n = lambda g: sum((ord(c) + 1) << (spans.CHAR * (2 - i)) for i, c in enumerate(g))
    told = dict(zip(gram.tolist(), mask.tolist(), strict=True))
    bits = {"abc": [0], "bcd": [0], "xab": [63], "ab": [0, 63], "bc": [0], "cd": [0], "xa": [63], "a": [0, 63], "b": [0, 5, 63], "c": [0], "d": [0], "x": [63]}
    assert len(told) == len(gram) and told == {n(g): sum(1 << b for b in at) for g, at in bits.items()}


def test_repeated_needles_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two one")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "two"), (1, "two"), (None, "one two")], "needle_id int, needle string")
    index = SpanIndex.build(docs, key="doc_id", text="text")
    assert rows(index.find(needles)) == rows(mailbox.needles_in(docs, needles, text=F.col("text"), key=["doc_id"])) and index.find(needles).count() == 5
