"""Edge cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import chat_format, common, decontaminate, jaccard_join, maxent_lm, mixing, pii, quality_lines, secrets, toxicity, url_filter
from lodeworks.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size int, node string, unit int, term string"
LONG = "lorem ipsum dolor sit amet " * 20_000


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None if n % 3 == 0 else f"s{n % 2}", None if t is None else len(t), "k", 7, "n", 3, "t") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [None, "", " \n\t ", "a", "the same short text of ten words is here again", "the same short text of ten words is here again", LONG, "mail me at joe@example.com or +1 555 123 4567 now please do it", "é ü ñ 漢字 \U0001f600 words"]
IDS = [1, 2, 3, 4, 5, 5, 6, None, 8]


@pytest.fixture(scope="module")
def hard(spark):
    return docs(spark, TEXTS, IDS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, None), (5, 1), (5, 0), (None, 1), (8, 0)], "doc_id long, toxic int")


def run(spark, name, d, labels):
    items = spark.createDataFrame([(1, "short text of ten words is here again"), (2, None), (3, "")], "item_id long, text string")
    return {
        "lm": lambda: maxent_lm.score(d), "leaks": lambda: decontaminate.decontaminate(d, items), "join": lambda: jaccard_join.join(d), "mix": lambda: mixing.mix(d),
        "toxic": lambda: toxicity.score(d, labels), "lines": lambda: quality_lines.judge(d), "secrets": lambda: secrets.scan_secrets(d),
    }[name]()


ALL = ("lm", "leaks", "join", "mix", "toxic", "lines", "secrets")


@pytest.mark.parametrize("name", ALL)
def test_hard_rows_and_empty_tables(spark, hard, labels, name):
    got = run(spark, name, hard, labels).collect()
    assert len(got) == len(TEXTS) and sorted(str(r["doc_id"]) for r in got) == sorted(map(str, IDS))
    twins = [r for r in got if r["doc_id"] == 5]
    if name not in ("mix",):
        assert twins[0] == twins[1]
    assert run(spark, name, hard.limit(0), labels).count() == 0


def test_values_of_hard_rows(spark, hard, labels):
    lm = {r["doc_id"]: r for r in run(spark, "lm", hard, labels).collect()}
    assert lm[1]["n_tokens"] == lm[2]["n_tokens"] == 1 and lm[6]["n_tokens"] == 100_001
    leaks = {r["doc_id"]: r for r in run(spark, "leaks", hard, labels).collect()}
    assert (leaks[5]["n_hit"], leaks[5]["items"], leaks[1]["n_words"]) == (8, ["1"], 0)
    join = {r["doc_id"]: r for r in run(spark, "join", hard, labels).collect()}
    assert (join[5]["class_id"], join[5]["n_links"], join[5]["n_copies"], join[1]["n_links"]) == (5, 1, 2, 0)
    lines = {r["doc_id"]: r for r in run(spark, "lines", hard, labels).collect()}
    assert not lines[1]["kept"] and lines[5]["kept"] and lines[6]["n_repeat_words"] == 100_000
    toxic = run(spark, "toxic", hard, labels).collect()
    assert all(0 <= r["score"] <= 1 for r in toxic)


def test_decontaminate_without_items(spark, hard):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(hard, none).filter("contaminated").count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0")], "item_id long, text string")
    near = "x " * 5 + "a1 b2 c3 d4 OTHER f6 g7 h8 i9 j0 tail"
    for texts in ([near], [near, "e5"]):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, texts), items).collect()}
        assert (got[0]["n_hit"], got[0]["n_near"]) == (0, 1)


def test_decontaminate_in_blocks(spark, monkeypatch):
    """More anchors and items than one broadcast holds, and a filter that tells nothing apart, give the same."""
    texts = [" ".join(f"w{(i * k) % 37}" for k in range(60)) for i in range(1, 12)]
    items = spark.createDataFrame([(i, " ".join(t.split()[5 : 5 + 3 * i])) for i, t in enumerate(texts)], "item_id long, text string")
    d = docs(spark, texts)
    want = sorted(map(str, decontaminate.decontaminate(d, items).collect()))
    for name, n in (("BLOCK_ANCHORS", 50), ("BLOCK_ITEMS", 3), ("FILTER_BITS", 64), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(decontaminate, name, n)
    assert sorted(map(str, decontaminate.decontaminate(d, items).collect())) == want


# -- URL filter -------------------------------------------------------------------------


def test_url_rules_in_line_and_joined_agree(spark, monkeypatch):
    urls = [
        "http://a.COM/x", "https://example.com/en/1", "https://www.example.com/en/1", "https://b.www.example.com/en/", "http://x.net/es/q", "http://x.net/esp", "http://x.net",
        "no scheme", None, "", "http://com", "http://com/", "http://notcom/", "http://cheap-pills.x.org/?a#b", "http://a.b/é?://x", "ftp://user@EXAMPLE.com:80/en/", "http://fr.net/FR/",
    ]
    t = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls)], "page_id long, url string, token string")
    rules = [*URL_RULES[:5], *(url_filter.pattern_rule("block", *w.split("-")) for w in ("cheap-pills", "free-bets", "online-casino"))]
    got = sorted(map(tuple, url_filter.filter_urls(t, rules).collect()), key=str)
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    assert got == sorted(map(tuple, url_filter.filter_urls(t, rules).collect()), key=str) and len(got) == 2 * len(urls)
    by = {r[0]: r for r in got}
    assert by[0][1:] == ("a.com", "/x", "com/", "allow") and by[1][3:] == ("example.com/en/", "block") and by[3][3:] == ("www.example.com/en/", "allow")
    assert by[4][3:] == ("net/es/", "block") and by[5][3:] == (None, "allow") and by[7][1:] == ("", "", None, "allow") and by[13][4] == "block" and by[11][3] == "com/" and by[10][3] is None
    assert url_filter.filter_urls(t.limit(0), rules).count() == 0 and url_filter.filter_urls(t, []).filter("verdict <> 'allow'").count() == 0


def test_thousands_of_rules_against_each_rule_run_on_each_url(spark, monkeypatch):
    rng = random.Random(4)
    labels = ["win", "casino", "casino-win", "win-casino", "ads-track", "www", "a", "cheap-pills", "cheap-pills-x", "example", "com", "net"]
    urls = [f"http://{'.'.join(rng.choices(labels, k=rng.randrange(1, 4)))}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['en', 'es', 'fr', ''])}/{rng.choice(['x', 'casino-win.', ''])}" for _ in range(150)]
    t = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:1] * 40)], "page_id long, url string")
    extra = [url_filter.Rule("any", "block", "(?s)^[^/]*/fr/x$", (), (0, 0))]
    rules = sorted(URL_RULES + extra, key=lambda r: r.rank)
    assert len(rules) > 3000
    want = []
    for i, u in enumerate(urls + urls[:1] * 40):
        whole = u.split("://", 1)[1]
        hit = next((r for r in rules if re.search(r.pattern, whole)), None)
        want.append((i, hit and hit.label, hit.verdict if hit else "allow"))
    ask = lambda: sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(t, rules).collect())
    assert ask() == want and {v for _, label, v in want if label is None} == {"allow", "block"}
    monkeypatch.setattr(url_filter, "BLOCK_RULES", 500)
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    assert ask() == want


# -- chat -------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "plain", None, "", "&lt;s&gt; &amp;amp; &#91;", "[/INST][INST]<s>", "ends with <", "/s>", "a\nb", "<", "[", "&"]
    rows = [(1, n, "assistant" if n % 2 else "user", t, "x") for n, t in enumerate(texts)] + [(2, 0, "[INST]", "x", "x"), (2, 0, None, "x", "x"), (2, None, "user", "y", "x"), (None, 1, "user", "z", "x"), (None, 1, "user", "z", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat_format.format_conversations(t).collect()}
    assert [(x["role"], x["text"]) for x in out[1]["turns"]] == [("assistant" if n % 2 else "user", t or "") for n, t in enumerate(texts)]
    f = out[1]["formatted"]
    lost = [f[s["start"]:s["end"]] for s in out[1]["loss_spans"]]
    undo = lambda x: x.replace("&lt;", "<").replace("&#91;", "[").replace("&amp;", "&")
    assert [undo(x) for x in lost] == [t or "" for n, t in enumerate(texts) if n % 2] and out[1]["loss_text"] == "".join(t or "" for n, t in enumerate(texts) if n % 2)
    assert [(x["role"], x["text"]) for x in out[2]["turns"]] == [("user", "y"), ("", "x"), ("[INST]", "x")] and len(out[None]["turns"]) == 2
    assert out[None]["rounds"] == 1 and out[1]["rounds"] == 2
    assert chat_format.format_conversations(t.limit(0)).count() == 0


def test_chat_every_string_of_marks(spark, monkeypatch):
    """Random texts of marks and parts of marks come back, and a rendering that would not is refused."""
    rng = random.Random(9)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<", "/s>", "s>", "&", "&lt;", "&amp;", "lt;", "#91;", "[", "x", "\n", "é"]
    rows = [(c, n, rng.choice(["user", "assistant", "".join(rng.choices(parts, k=2))]), "".join(rng.choices(parts, k=rng.randrange(8)))) for c in range(80) for n in range(rng.randrange(1, 5))]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(t).collect()}
    for c, r in got.items():
        want = [(role, text) for k, _, role, text in rows if k == c]
        assert [(x["role"], x["text"]) for x in r["turns"]] == want and r["loss_text"] == "".join(text for role, text in want if role == "assistant")
        assert len(r["loss_spans"]) == sum(role == "assistant" for role, _ in want)
    assert {r["rounds"] for r in got.values()} >= {1, 2}
    long = spark.createDataFrame([(1, n, "assistant" if n % 2 else "user", f"text <s> {n}") for n in range(20_000)], "conv_id long, turn long, role string, text string")
    r = chat_format.format_conversations(long).first()
    f = r["formatted"]
    assert len(r["turns"]) == 20_000 and [f[s["start"] : s["end"]] for s in r["loss_spans"][:2]] == ["text &lt;s> 1", "text &lt;s> 3"]
    monkeypatch.setattr(chat_format, "escaped", lambda c: c)
    with pytest.raises(Exception, match="does not come back"):
        chat_format.format_conversations(t).collect()


# -- mixing -----------------------------------------------------------------------------


def test_water_level(spark):
    def level(sizes):
        w, cap, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}, {s: 3 * n for s, n in sizes.items()}, set()
        while True:
            free = [s for s in sizes if s not in capped]
            rest = sum(sizes.values()) - sum(cap[s] for s in capped)
            t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
            over = {s for s in free if t[s] > cap[s]}
            if not over:
                return t | {s: cap[s] for s in capped}
            capped |= over

    for sizes in ({"a": 10, "b": 500, "c": 90}, {"a": 1000, "b": 1, "c": 1, "d": 1}, {"a": 7}, {"a": 5, "b": 5, "c": 5, "d": 400, "e": 3}):
        d = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.water_level(d, (5, 2, 1), 3).collect()}
        assert got == pytest.approx(level(sizes))


def test_mix_takes_the_target(spark):
    rows = [(n, "w " * (n % 40 + 1), "ab"[n % 3 == 0], None) for n in range(600)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string, position string")
    got = mixing.mix(t).toPandas()
    for _, g in got.groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
    assert (got["taken"] <= 3 * got["size"]).all() and got["position"].dropna().is_monotonic_increasing
    assert got.equals(mixing.mix(t).toPandas())


def test_position_inverts_the_schedule(spark):
    t = spark.createDataFrame([(a, b, x / 10) for a, b in ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5), (0.0, 2.0), (2.0, 0.0)) for x in range(1, 11)], "a double, b double, s double")
    for r in t.withColumn("p", mixing.position(F.col("s"), F.col("a"), F.col("b"))).collect():
        a, b, p = r["a"], r["b"], r["p"]
        assert (a * p + (b - a) * p * p / 2) / ((a + b) / 2) == pytest.approx(r["s"])


# -- quality ----------------------------------------------------------------------------


def repeat_words(text):
    w = text.split()
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


def test_repeat_words(spark):
    texts = ["a b c d e", "a a a a a a", "a b c d e f a b c d e", "x y " * 9, "q w e r t q w e r t y u i o p", "a b c d e x a b c d e y b c d e x"]
    got = {r["doc_id"]: r for r in quality_lines.judge(docs(spark, texts)).collect()}
    assert [got[i]["n_repeat_words"] for i in range(len(texts))] == [repeat_words(t) for t in texts]


def test_frequent_lines_go_and_copies_stay(spark):
    own = lambda n: f"number {'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10 % 10]}{'uvwxyz'[n // 100 % 6]} has its own good words to say in this single line of text"
    boiler = "subscribe to our newsletter and accept all cookies of this site right now please thank you very much indeed"
    mixed = [f"{boiler}\n{own(n)}" for n in range(40)]
    hollow = [f"{boiler}\nshort {own(n)[7:10]}" for n in range(40)]
    copies = ["the very same document of which there are a great many copies in this host"] * 60
    d = docs(spark, mixed + hollow + copies).withColumn("source", F.lit("h"))
    got = [r["kept"] for r in quality_lines.judge(d, line_limit=30).orderBy("doc_id").collect()]
    assert all(got[:40]) and not any(got[40:80]) and all(got[80:])
    assert quality_lines.accepted(d, line_limit=30).count() == 100


# -- secrets ----------------------------------------------------------------------------


def test_layers(spark):
    import base64
    import gzip
    import urllib.parse

    key = 'token = "abcdef0123456789"'
    wraps = {
        "url": urllib.parse.quote(key), "base64": base64.b64encode(key.encode()).decode(), "gzip": base64.b64encode(gzip.compress(key.encode())).decode(),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in key), "twice": base64.b64encode(base64.b64encode(key.encode())).decode(), "url64": urllib.parse.quote(base64.b64encode(key.encode()).decode(), safe=""),
    }
    for name, w in wraps.items():
        n, spans = secrets.answer(f"before {w} after")[0], secrets.answer(f"before {w} after")[4]
        assert n == 0 and spans.startswith("assign:"), name
        _, s, e = spans.split(",")[0].split(":")
        assert 7 <= int(s) < int(e) <= 7 + len(w)
    assert secrets.answer("clean words only")[4] == "" and secrets.answer(None)[4] == ""
    assert secrets.answer("password=short")[0] == 0 and secrets.answer("AKIA" + "B" * 12)[1] == 1 and secrets.answer("f" * 31)[2] == 0
    loop = base64.b64encode(("x" * 40).encode()).decode()
    assert secrets.worklist(loop * 3) == secrets.worklist(loop * 3)


# -- personal data ----------------------------------------------------------------------


def test_redaction_and_overlaps(spark):
    d = docs(spark, ["mail joe@example.com, call +1 (555) 123-4567; ip 10.0.0.1 card 4111 1111 1111 1111 end", "nothing here", "256.1.1.1 and 1.2.3.4.5", None])
    m = pii.fit_documents(d)
    spans = pii.accepted(pii.proposals(F.coalesce("text", F.lit(""))), m)
    t = d.orderBy("doc_id").select(F.coalesce("text", F.lit("")).alias("t"), spans.alias("s"))
    got = [tuple(r) for r in t.select(pii.redacted(F.col("t"), F.col("s")), pii.spelled(F.col("s"))).collect()]
    assert got[0][0] == "mail [EMAIL], call [PHONE]; ip [IP] card [CARD] end"
    assert got[1] == ("nothing here", "") and got[2][1] == "ip:14:21" and got[3] == ("", "")
    assert pii.fit({}).prior and hashlib.sha256(b"").hexdigest()


def test_a_very_long_url(spark):
    long = "http://a.net/fr/" + "x/" * 300_000
    t = spark.createDataFrame([(1, long), (2, "http://" + "a" * 100_000 + ".com/" + "?q" * 1000)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(t, URL_RULES).collect()}
    assert (got[1]["rule"], got[1]["verdict"], got[1]["path"]) == ("net/fr/", "block", long[12:]) and (got[2]["rule"], got[2]["path"]) == ("com/", "/")
