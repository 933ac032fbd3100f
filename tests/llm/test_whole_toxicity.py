"""Kneser-Ney probabilities against plain Python, expressions of several words, bounds and other column names."""

import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import toxicity as m


def plain(grams, order, even):
    """The three probabilities (ordinary, toxic, pooled) of an n-gram's last symbol by recursion; ``grams`` has counts of tuples by class."""
    levels = {order: {g: (a, b, a + b) for g, (a, b) in grams.items()}}
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g, n in levels[k + 1].items():
            old = levels[k].get(g[1:], (0, 0, 0))
            levels[k][g[1:]] = tuple(o + (x > 0) for o, x in zip(old, n, strict=True))

    def p(g, k):
        if k == 0:
            return [even] * 3
        low, level, out = p(g[1:], k - 1), levels[k], [0, 0, 0]

        def mix(j, lower):
            one, two = (sum(n[j] == x for n in level.values()) for x in (1, 2))
            d = (one + 1) / (one + 2 * two + 2)
            own = [n[j] for h, n in level.items() if h[:-1] == g[:-1]]
            if not sum(own):
                return lower
            return max(level.get(g, (0, 0, 0))[j] - d, 0) / sum(own) + min(1, d * sum(x > 0 for x in own) / sum(own)) * lower

        pooled = mix(2, low[2])
        out = [mix(j, (low[j] + pooled) / 2) for j in range(2)]
        return [*out, pooled]

    return lambda g: p(g, order)


@pytest.mark.parametrize(("bits", "order"), ((8, 4), (31, 2)))
def test_kneser_ney(bits, order):
    rng = random.Random(2)
    seen = [tuple(rng.choice((3, 5, 9, 200)) for _ in range(order)) for _ in range(60)]
    grams = {g: (rng.randrange(4), rng.randrange(4)) for g in seen}
    grams = {g: n for g, n in grams.items() if sum(n)}
    pack = lambda g: sum(x << bits * (order - 1 - i) for i, x in enumerate(g))
    keys = np.array(sorted(map(pack, grams)))
    by = {pack(g): n for g, n in grams.items()}
    model = m.Grams.of(keys, np.array([by[k] for k in keys.tolist()]), bits, order)
    asked = [*grams, *(tuple(rng.choice((3, 5, 9, 200, 7)) for _ in range(order)) for _ in range(40))]
    want = plain(grams, order, model.even)
    sent = pickle.loads(pickle.dumps(model))
    assert (sent.orders[-1].keys == keys).all() and sent.evidence(keys).tolist() == model.evidence(keys).tolist()
    got = sent.evidence(np.array([pack(g) for g in asked]))
    assert got == pytest.approx([math.log(p[1]) - math.log(p[0]) for p in map(want, asked)])


def test_an_expression_of_common_words(spark):
    """Words that both classes use are toxic in one order only."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(30)]
    rows, labels = [], []
    for n in range(1200):
        text = rng.choices(words, k=12)
        at = rng.randrange(10)
        text[at : at + 2] = ["blue", "moon"] if n % 2 else ["moon", "blue"]
        rows.append((n, " ".join(text), n % 2))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "k long, body string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "which long, bad int")
    got = m.score(d, labels, key="k", text="body", label_key="which", label="bad").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1200 and sum(r["predicted"] == r["k"] % 2 for r in held) > 0.95 * len(held)


def test_bounds_of_the_sample(spark):
    d = spark.createDataFrame([(n, "some words " * 20, n % 2) for n in range(400)], "doc_id long, text string, toxic int")
    got = m.fit(d.drop("toxic"), d.select("doc_id", "toxic"), key="doc_id", label_key="doc_id", label="toxic", text="text", folds=5, max_rows=1000, max_chars=4000).model
    assert 0 < got.pairs.orders[-1].totals[:, 2].sum() < 400 * 40 / 4


def test_counts_to_evidence(spark, monkeypatch):
    """From texts to the ratios of pairs and spellings, by plain counting, with pairs that stand once."""
    monkeypatch.setattr(m, "SLICE", 40)
    rng = random.Random(3)
    texts = [(" ".join(rng.choices(["aa", "b", "cé", "dd", "e1"], k=rng.randint(0, 9))), rng.randrange(2)) for _ in range(60)] + [("only once here", 1), ("once only there", 0)]
    found = m.ngram_counts(spark.createDataFrame(texts, "_text string, _toxic int").repartition(3))
    pairs, spelling = Counter(), Counter()
    for text, toxic in texts:
        ws = m.words_of(text)
        for a, b in zip([None, *ws], ws, strict=False):
            pairs[(m.hash_of(a) if a else 0, m.hash_of(b)), toxic] += 1
        for w in ws:
            marked = b"\x01" * (m.ORDER - 1) + w + b"\x02"
            for i in range(len(w) + 1):
                spelling[tuple(marked[i : i + m.ORDER]), toxic] += 1
    for words, (bits, order, counted) in enumerate(((8, m.ORDER, spelling), (m.WORD_BITS, 2, pairs))):
        grams = {g: (counted[g, 0], counted[g, 1]) for g, _ in counted}
        keys, counts = m.collected(found, words)
        pack = lambda g, bits=bits, order=order: sum(x << bits * (order - 1 - i) for i, x in enumerate(g))
        assert dict(zip(keys.tolist(), map(tuple, counts.tolist()), strict=True)) == {pack(g): n for g, n in grams.items()} and any(sum(n) == 1 for n in grams.values())
        model = m.Grams.of(keys, counts, bits, order)
        unseen = [(*g[:-1], h[-1]) for g, h in zip(grams, list(grams)[1:], strict=False)]
        want = [plain(grams, order, model.even)(g) for g in [*grams, *unseen]]
        assert model.evidence(np.array([pack(g) for g in [*grams, *unseen]])) == pytest.approx([math.log(p[1]) - math.log(p[0]) for p in want], rel=1e-5)
