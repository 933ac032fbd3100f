import email
import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import chunking, text
from lodeworks.sources import containers, files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("t", ["", "   ", "short", "x" * 8192, "Привет мир " * 2048, "a. b! c? " * 900, "emoji 😀 " * 1500])
def test_passages_are_the_bytes_they_name(t):
    raw, last = t.encode(), -1
    for n, (i, start, end, p) in enumerate(chunking.split(t)):
        assert i == n and start > last and raw[start:end].decode() == p and p == p.strip() and len(p) <= 2048
        last = start
    assert bool(list(chunking.split(t))) == bool(t.strip())


def test_short_text_is_one_passage_and_paragraphs_break_first():
    assert len(list(chunking.split("x" * 2048))) == 1
    t = "x" * 1848 + "\n\n" + "SECOND PARAGRAPH STARTS HERE" + "y" * 2048
    assert "SECOND" not in next(chunking.split(t))[3]


def test_batches_keep_both_bounds():
    groups = list(chunking.batches(["w" * 100] * 200))
    assert sum(map(len, groups)) == 200 and max(map(len, groups)) <= 64


def test_compact(spark):
    got = one(spark, "Yes, agreed.\r\n\r\nOn Mon, 3 Feb 2025 at 10:00, Someone <s@x.org> wrote:\r\n> old words", text.compact)
    assert got == "Yes, agreed."
    assert one(spark, "Hello\n-- \nSig", text.compact) == "Hello"
    assert one(spark, "A plain sentence.", text.compact) == "A plain sentence."
    assert one(spark, "see https://x.org/" + "a" * 400 + " ok", text.compact) == "see ok"
    assert "https://maps.x.org/q" in one(spark, "see https://maps.x.org/q ok", text.compact)


def test_snippet_cuts_between_characters_and_words(spark):
    got = one(spark, "a" * 239 + "😀 more words", text.snippet)
    assert got.endswith("…") and got == "a" * 239 + "…"
    got = one(spark, "word " * 100, text.snippet)
    assert got.endswith("word…") and len(got.encode()) <= 243


def test_html():
    page = "<html><head><title>no</title></head><body><p>A &amp; B</p><table><tr><td>c</td></tr></table><script>x</script></body></html>"
    assert text.html_text(page).split() == ["A", "&", "B", "c"]
    assert text.html_text(None) is None


def test_ignore_rules():
    keep = lambda rules, p: not files.matches(p, rules)
    assert not keep(["*.log"], "a/b/x.LOG") and keep(["*.log"], "a/log")
    assert not keep(["/".join(["src", "*.txt"])], "src/a.txt") and keep(["src/*.txt"], "x/src/a.txt")
    assert not keep(["**/logs/*.txt"], "logs/a.txt") and not keep(["**/logs/*.txt"], "a/b/logs/c.txt")
    assert not keep(["caches/**"], "caches/x/y") and keep(["caches/**"], "caches")
    assert not keep(["tmp/"], "a/tmp/b") and keep(["tmp/"], "a/tmp")
    assert keep(["*.txt", "!keep.txt"], "keep.txt") and not keep(["*.txt", "!keep.txt", "keep.txt"], "keep.txt")
    assert not keep(["*.[ch]"], "x.c") and not keep(["*.[!ch]"], "x.d") and keep(["*.[!ch]"], "x.c")
    with pytest.raises(ValueError):
        files.ignore_patterns(["!"])


def test_ignore_column_agrees(spark):
    rules, paths = ["*.log", "!a/keep.log", "b/**"], ["x.log", "a/keep.log", "b/c", "b", "d"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.ignored(F.col("p"), rules).alias("i")).collect()
    assert {r["p"]: r["i"] for r in got} == {p: files.matches(p, rules) for p in paths}


def _mail(**more):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Date"], m["Message-ID"] = "Ada <Ada@X.org>", "b@y.org, \"C, D\" <c@z.org>", "Hi", "Mon, 03 Feb 2025 10:00:00 +0100", "<1@x.org>"
    m.set_content("the body")
    m.add_attachment(b"%PDF-1", maintype="application", subtype="pdf", filename="f.pdf")
    return m.as_bytes()


def test_mail_and_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("dir/m.eml", _mail())
        f.writestr("note.txt", "plain")
    rows = [("z", "archive", z.getvalue())]
    t = spark.createDataFrame(rows, "sha256 string, doc_type string, content binary")
    got = containers.unroll_all(t, files.classify).collect()
    assert {r["filename"] for r in got} == {"m.eml", "note.txt", "f.pdf"} and all(r["reason"] is None for r in got)
    m = containers.messages(spark.createDataFrame([("m", _mail())], "sha256 string, content binary")).first()
    assert m["message_id"] == "1@x.org" and m["sent_at"].hour == 9 and m["body"].strip() == "the body"
    assert [(a["kind"], a["address"]) for a in m["addresses"]] == [("from", "ada@x.org"), ("to", "b@y.org"), ("to", "c@z.org")]


def test_content_types(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="urn:w"><w:body><w:p><w:t>Hello</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    cases = [(b"%PDF-1.7", "x", "pdf"), (_mail(), "x", "email"), (z.getvalue(), "x.docx", "office"), (b"some words", "a.txt", "text"), (b"x = 1", "app.log.3", "unsupported"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.doc", "legacy-office"), (b"\x89PNG\r\n\x1a\n", "p", "image"), (b"a\0b", "a.txt", "unsupported")]
    t = spark.createDataFrame([(a, b, c) for a, b, c in cases], "c binary, n string, want string")
    for r in t.select("want", files.classify(F.col("c"), F.col("n")).alias("r")).collect():
        assert r["r"]["doc_type"] == r["want"]
    assert containers.office_text(z.getvalue(), "docx") == "Hello\na\tb"
    assert containers.rtf_text(rb"{\rtf1{\fonttbl x}\pard Hi\par caf\'e9}") == "Hi\ncafé"


def test_declines_and_charsets():
    with pytest.raises(containers.Declined, match="UNSUPPORTED_FORMAT"):
        containers.unroll(b"BZh9")
    with pytest.raises(containers.Declined, match="ARCHIVE_DAMAGED"):
        containers.unroll(b"PK\x03\x04broken")
    russian = "Привет, как дела сегодня"
    assert containers.decode_text(russian.encode("windows-1251")) == (russian, "detected:windows-1251")
    assert containers.decode_text("é".encode("latin-1"), "latin-1") == ("é", "declared:latin-1")
    assert containers.identifiers("<a@b><c@d> e@f, broken <a@b>") == ["a@b", "c@d", "e@f"]
    assert containers.sent_at("nonsense") is None and email is not None
