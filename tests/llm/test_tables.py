"""The registered queries against brute force, on the smallest tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lodeworks.llm import secrets
from lodeworks.llm.oracles import ORACLES
from lodeworks.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def answers(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    show = lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii_base(spark, texts):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and luhn(d)), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    got = answers(spark, "op1_pii")
    for i, t in texts.items():
        spans = sorted((m.start(), k, m.end(), n) for k, (n, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t) if ok(m.group()))
        base = ",".join(f"{n}:{s}:{e}" for s, _, e, n in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))


def test_lm_base_and_gain(spark, texts):
    told = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in told}
    c = Counter(w for i, ws in told.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = answers(spark, "op2_lm_score")
    for i, ws in told.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    mean = lambda k, h: sum(got[i][k] for i in told if held[i] == h) / sum(len(told[i]) for i in told if held[i] == h)
    assert mean("score", False) > mean("base_score", False) and mean("score", True) > mean("base_score", True)


def test_leaks(spark, texts):
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    items = {str(r["item_id"]): word.findall((r["text"] or "").encode().lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    windows = {}
    for i, w in items.items():
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    got = answers(spark, "op3_decontaminate")
    for i, t in texts.items():
        w, hit, own = word.findall(t.encode().lower()), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    own |= x
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == (len(w), len(hit), len(own), digest, bool(hit))


def classes(texts):
    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in sets}


def test_join(spark, texts):
    got = answers(spark, "op4_jaccard_join")
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == classes(texts)


def test_join_in_blocks(spark, monkeypatch):
    """A family of near copies, larger than a block, and a chain."""
    from lodeworks.llm import jaccard_join

    base = [f"w{i}" for i in range(100)]
    rows = {n: " ".join(base[:n] + [f"x{n}"] + base[n + 1 :]) for n in range(60)} | {100 + n: " ".join(f"c{k}" for k in range(4 * n, 4 * n + 60)) for n in range(12)} | {500: " ".join(base), 501: " ".join(base)}
    monkeypatch.setattr(jaccard_join, "BLOCK_SIGS", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 8)
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(d).collect()}
    assert got == classes(rows)
    kept = {r["doc_id"] for r in jaccard_join.deduplicated(d).collect()}
    assert kept == {c for c, _ in classes(rows).values()}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.9 and ((got.score >= 0.5) == got.toxic).mean() > 0.92


def test_quality_base(spark, texts):
    from tests.llm.test_small import repeat_words

    got = answers(spark, "op8_line_quality")
    for i, t in texts.items():
        w = t.encode().split()
        spoken = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = (len(w), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(spoken) - len(set(spoken)), repeat_words(" ".join(words)))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and got[i]["kept"] == (not got[i]["base_failed"])


def test_secrets_base(spark, texts):
    got = answers(spark, "op9_secret_scan")
    for i, t in texts.items():
        spans = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(t) if len(m[1]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        base = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_pipeline(spark, texts):
    import corpus_pipeline

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    quality = {i for i, r in answers(spark, "op8_line_quality").items() if r["kept"]}
    own = classes({i: t for i, t in texts.items() if i in quality})
    leaks = {i for i, r in answers(spark, "op3_decontaminate").items() if r["contaminated"]}
    left = {c for c, _ in own.values()} - leaks
    assert set(got) <= left and sum(r["taken"] for r in got.values()) > 0
    assert all("@" not in r["text"] or not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r["text"]) for r in got.values())
