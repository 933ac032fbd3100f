"""Spans, votes and redaction against plain Python, on hard rows and on very long texts."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import pii
from lodeworks.llm.common import running, text_of

PATTERNS = {k: re.compile(p.replace(r"\G", r"(?!)")) for k, p in (("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE))}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _found string, start int, kind string, p string"
PIECES = ["joe@example.com", "1.2.3.4", "10.0.0.256", "4111 1111 1111 1111", "1234567812345678", "+1 (555) 123-4567", "555 123 4567", "ann [at] mail [dot] org", "call", "mail me at", "version", "é漢", "\n", ",", "+44 20 7946 0958", "a@b.c"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "f", 2, "k", "p") for i, t in enumerate(texts)], SCHEMA)


def spans_of(spark, texts, column=None):
    found = pii.proposals(text_of("text"))
    return [r["x"] for r in docs(spark, texts).orderBy("doc_id").select((found if column is None else column(found)).alias("x")).collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [None, "", " \n\t ", "joe@example.com", *(" ".join(rng.choices(PIECES, k=rng.randrange(30))) for _ in range(80)), *("".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(40))]


def test_running(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(-9, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 1000)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", running(F.col("x"), lambda a, b: a + b, F.lit(0)).alias("s"), running(F.col("x"), F.greatest, F.lit(-99)).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))] and r["m"] == [max(r["x"][:i], default=-99) for i in range(len(r["x"]))]


def test_located_with_context(spark, texts):
    for kind, pattern in (("email", pii.EMAIL), ("phone", pii.PHONE)):
        got = docs(spark, texts).orderBy("doc_id").select(pii.located(text_of("text"), pattern).alias("x")).collect()
        plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "phone": pii.PHONE}[kind]
        for t, r in zip(texts, got, strict=True):
            want = [(m.start(), m.end(), m.group(), t[max(0, m.start() - pii.CONTEXT) : m.start()]) for m in re.finditer(plain, t or "")]
            assert [tuple(x) for x in r["x"]] == want


def test_no_looser_span_overlaps_a_base_span(spark, texts):
    for spans in spans_of(spark, texts):
        base = [x for x in spans if x["base"]]
        assert not any(b["start"] < x["end"] and x["start"] < b["end"] for x in spans if x["pattern"][1] == "0" for b in base)
        assert [(x["start"], x["end"], x["kind"]) for x in spans] == sorted((x["start"], x["end"], x["kind"]) for x in spans)
    kept = spans_of(spark, ["call 555 123 4567 now", "joe [at] example [dot] com and joe@example.com", "+1 (555) 123-4567"])
    assert [[(x["kind"], x["base"]) for x in r] for r in kept] == [[(3, False)], [(0, False), (0, True)], [(3, True)]]


def em(counts, rounds=40):
    """The same estimate written over single votes: probabilities of each pattern being personal data."""
    out = {}
    for k in "0123":
        own = {p: n for p, n in counts.items() if p[0] == k}
        start = [{"+": (x, 10 - x), "-": (10 - x, x), "0": (5, 5)} for x in (9.5, 8, 8, 8)]
        pi, rel = 0.5, {(j, v): (a / 10, b / 10) for j in range(4) for v, (a, b) in start[j].items()}
        post = {}
        for _ in range(rounds):
            for p in own:
                yes, no = pi, 1 - pi
                for j in range(4):
                    yes, no = yes * rel[j, p[2 + j]][0], no * rel[j, p[2 + j]][1]
                post[p] = yes / (yes + no)
            n = sum(own.values())
            good = sum(own[p] * post[p] for p in own)
            pi = (good + 5) / (n + 10)
            for j, v in itertools.product(range(4), "+-0"):
                yes = sum(own[p] * post[p] for p in own if p[2 + j] == v)
                no = sum(own[p] * (1 - post[p]) for p in own if p[2 + j] == v)
                rel[j, v] = ((yes + start[j][v][0]) / (good + 15), (no + start[j][v][1]) / (n - good + 15))
        out[k] = (pi, rel)
    return out


def test_reliabilities_by_expectation_maximisation():
    rng = random.Random(8)
    counts = {f"{k}{s}{''.join(v)}{z}": rng.randrange(1, 200) for k in "0123" for s in "01" for v in itertools.product("+-0", repeat=4) for z in "0123" if rng.random() < 0.1}
    model = pii.fit(counts)
    for k, (pi, rel) in em(counts).items():
        assert model.prior[int(k)] == pytest.approx(pi)
        for (j, v), x in rel.items():
            assert model.reliable[int(k)][j][v] == pytest.approx(x)


def test_the_classifier_alone_decides(spark, texts):
    """Every span beyond the base ones is there just if the trained model gives it 0.9."""
    found = spans_of(spark, texts)
    counts = {}
    for r in found:
        for x in r:
            counts[x["pattern"]] = counts.get(x["pattern"], 0) + 1
    assert pii.pattern_counts(docs(spark, texts).select(pii.proposals(text_of("text")).alias("_found"))) == counts
    model = pii.fit(counts)
    got = spans_of(spark, texts, lambda f: pii.accepted(f, model))
    assert got == [[x for x in r if x["base"] or model.probability(x["pattern"]) >= 0.9] for r in found]
    assert any(not x["base"] for r in got for x in r)


def redacted(text, spans):
    out, at, upto = [], 0, 0
    for s, e, k in spans:
        if s >= upto:
            out += [text[at:s] if s > at else "", f"[{pii.KINDS[k].upper()}]"]
        upto = max(upto, e)
        at = upto
    return "".join(out) + text[at:]


def test_redaction(spark, texts):
    found = docs(spark, texts).orderBy("doc_id").select(text_of("text").alias("t"), pii.proposals(text_of("text")).alias("f")).select("f", pii.redacted(F.col("t"), F.col("f")).alias("r")).collect()
    for t, r in zip(texts, found, strict=True):
        assert r["r"] == redacted(t or "", [(x["start"], x["end"], x["kind"]) for x in r["f"]])


def test_hard_rows(spark):
    d = docs(spark, [None, "", "joe@example.com", "joe@example.com"])
    model = pii.fit_documents(d)
    got = [r["s"] for r in d.orderBy("doc_id").select(pii.spelled(pii.accepted(pii.proposals(text_of("text")), model)).alias("s")).collect()]
    assert got == ["", "", "email:0:15", "email:0:15"]
    assert pii.fit_documents(d.limit(0)).weights[0].get("bias", 0.0) == 0.0 and d.limit(0).select(pii.proposals(text_of("text"))).count() == 0


def test_redacted_documents(spark, texts):
    d = docs(spark, texts)
    model = pii.fit_documents(d)
    spans = spans_of(spark, texts, lambda f: pii.accepted(f, model))
    got = pii.redact(d).orderBy("doc_id").collect()
    assert pii.redact(d).columns == d.columns and pii.redact(d.limit(0)).count() == 0
    for i, (t, x) in enumerate(zip(texts, spans, strict=True)):
        assert tuple(got[i]) == (i, None if t is None else redacted(t, [(s["start"], s["end"], s["kind"]) for s in x]), "en", "s", 1, "f", 2, "k", "p")


def test_a_long_text_full_of_addresses(spark):
    text = " ".join(f"joe{i}@example.com 10.0.{i % 256}.1" for i in range(30_000))
    x = docs(spark, [text]).select("text", pii.proposals(text_of("text")).alias("f")).select("f", pii.redacted(F.col("text"), F.col("f")).alias("r")).first()
    assert len(x["f"]) == 60_000 and x["r"] == " ".join(["[EMAIL] [IP]"] * 30_000)
    assert all(text[s["start"] : s["end"]].startswith(("joe", "10.")) for s in x["f"])
