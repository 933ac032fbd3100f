"""The join near its threshold, and with hot sets, buckets, families and hubs."""

import random

from lodeworks.llm import common, jaccard_join
from tests.llm.test_tables import classes


def answer(spark, rows):
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(d).collect()}


def test_recall_near_the_threshold(spark):
    """Pairs at random similarities from 0.7 to 0.95: none at 0.8 or more is missed, none below is taken."""
    rng = random.Random(7)
    rows = {}
    for n in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 400))]
        rows[2 * n] = " ".join(base)
        changed = list(base)
        for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.uniform(0.004, 0.04)))):
            changed[at] = f"x{rng.randrange(10**6)}"
        rows[2 * n + 1] = " ".join(changed)

    def similarity(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(x & y) / len(x | y)

    want = {2 * n + k: (2 * n, 1) if similarity(rows[2 * n], rows[2 * n + 1]) >= 0.8 - 1e-12 else (2 * n + k, 0) for n in range(400) for k in (0, 1)}
    got = answer(spark, rows)
    assert 150 < sum(n for _, n in want.values()) < 790 and got == want


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK_SIGS", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 3000)
    base = [f"w{i}" for i in range(80)]
    rows = {n: " ".join(base[:n] + [f"x{n}"] + base[n + 1 :]) for n in range(50)} | {100 + n: " ".join(base) for n in range(60)} | {200 + n: "one text of its own " + "ab"[n % 2] * (n // 2 + 1) for n in range(9)} | {300: "", 301: None}
    want = classes({i: t or "" for i, t in rows.items()})
    assert answer(spark, rows) == want
    monkeypatch.setattr(common, "BROADCAST_KEYS", 2)
    assert answer(spark, rows) == want
