"""Proximity matches against brute force: any two words of a window may be missing, those of the corpus and others."""

import itertools
import re

import pytest

from lodeworks.llm import decontaminate
from lodeworks.llm.queries import QUERIES

ITEM = [f"t{i}" for i in range(10)]


def brute(docs, items):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    out = {}
    for d, text in docs.items():
        w, n = word.findall((text or "").encode().lower()), 0
        for item in items:
            t = word.findall((item or "").encode().lower())
            size = min(10, len(t))
            agree = [sum(a == b for a, b in zip(w[i : i + size], t[k : k + size], strict=True)) for k in range(len(t) - size + 1) for i in range(len(w) - size + 1)] if size else []
            n += bool(agree) and max(agree) < size and max(agree) * 10 >= size * 8
        out[d] = n
    return out


@pytest.mark.parametrize("known", (True, False))
def test_any_two_words_changed(spark, known):
    rows = {n: " ".join(["lead"] + [f"other{n}" if i in gone else w for i, w in enumerate(ITEM)] + ["tail"]) for n, gone in enumerate([*itertools.combinations(range(10), 2), *itertools.combinations(range(10), 1), (0, 1, 2), (7, 8, 9)])}
    if known:  # words that stand elsewhere, rarer than the others
        rows |= {1000 + i: w for i, w in enumerate(ITEM)}
    else:
        rows = {n: t for n, t in rows.items() if "t4" not in t}
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    items = [" ".join(ITEM), "t0 t1 t2 t3 zz"]
    got = decontaminate.decontaminate(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = brute(rows, items)
    assert {r["doc_id"]: r["n_near"] for r in got} == want and sum(want.values()) > 5


def test_registered_query_returns_them(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r["n_near"] for r in QUERIES["op3_decontaminate"](spark, sf).collect()}
    assert {d: got[d] for d in docs} == brute(docs, set(items))
