"""Worked examples: operators whose inputs are files, mails, requests or model answers, on inputs written here, with their results stated by SQL."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from email.message import EmailMessage

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import chunking, metadata, text
from lodeworks.operators import admission, evaluate, graph, guards, layout, mailbox, retrieval, service, store
from lodeworks.operators import jobs as J
from lodeworks.operators.tables import shared_dir, stored
from lodeworks.operators.retrieval import Candidate
from lodeworks.plans.registry import table
from lodeworks.sources import cases, containers, files, models, names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


NOW = datetime(2026, 1, 1)
RUSSIAN = "Привет, как дела сегодня"


def _values(rows: Sequence[Sequence], columns: str) -> str:
    """SQL of a table of literals."""
    say = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f"TIMESTAMP '{v}'" if isinstance(v, datetime) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({columns})"


def _files(spark: SparkSession, contents: dict[str, bytes]) -> str:
    """Writes small files below a folder of the shared one and returns it."""
    root = f"{shared_dir(spark)}/lodeworks/worked-{uuid.uuid4().hex}/mail"
    for name, raw in contents.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(raw))
        out.close()
    return root


def _zip(members: dict[str, bytes | str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return raw.getvalue()


def _tar(members: dict[str, bytes]) -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return raw.getvalue()


def _mail(**headers: str) -> bytes:
    m = EmailMessage()
    for k, v in {"From": "Ada <Ada@X.org>", "To": 'b@y.org, "C, D" <c@z.org>', "Subject": "Hi", "Date": "Mon, 03 Feb 2025 10:00:00 +0100", "Message-ID": "<1@x.org>"}.items():
        m[k] = headers.pop(k, v)
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    m.set_content("the body")
    m.add_attachment(b"%PDF-1", maintype="application", subtype="pdf", filename="f.pdf")
    return m.as_bytes()


# -- sources ----------------------------------------------------------------------------

_SCANNED = [("a.log", True), ("keep.log", False), ("mail/b c.eml", False), ("tmp/x.txt", True), ("mail/tmp.txt", False)]


@query(f"SELECT *, sha256(relative_path) AS sha256, strlen(relative_path) AS size FROM ({_values(_SCANNED, 'relative_path, ignored')})")
def file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files below a root whose name comes again further down, with ignore rules of which the last that matches decides."""
    found = files.scan(spark, _files(spark, {p: p.encode() for p, _ in _SCANNED} | {".DS_Store": b"x"}))
    return found.select("relative_path", files.ignored(F.col("relative_path"), ["*.log", "!keep.log", "tmp/"]).alias("ignored"), "sha256", "size")


@query(_values([("a", False), ("b", True), ("c", True), ("d", True)], "path, unstable"))
def unstable_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that changed in size or time between two listings, or are gone."""
    schema = "path string, size long, modified_at timestamp"
    before = spark.createDataFrame([(p, 1, NOW) for p in "abcd"], schema)
    after = spark.createDataFrame([("a", 1, NOW), ("b", 2, NOW), ("c", 1, NOW + timedelta(seconds=1))], schema)
    return before.join(files.unstable(before, after).withColumn("_u", F.lit(True)), "path", "left").select("path", F.coalesce("_u", F.lit(False)).alias("unstable"))


_KINDS = [
    ("x.pdf", b"%PDF-1.7", "pdf", "", False), ("x.eml", _mail(), "email", "", False), ("x.docx", _zip({"word/document.xml": "<x/>"}), "office", "docx", False), ("x.zip", _zip({"a.txt": "a"}), "archive", "", False),
    ("x.jar", _zip({"a.txt": "a"}), "unsupported", "", True), ("x.tgz", gzip.compress(_tar({"a": b"a"})), "archive", "", False), ("a.txt", b"some words", "text", "", False), ("app.log.3", b"x = 1", "unsupported", "", True),
    ("a.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "legacy-office", "", True), ("p", b"\x89PNG\r\n\x1a\n", "image", "", False), ("n.txt", b"a\0b", "unsupported", "", True), ("r.rtf", b"{\\rtf1 x}", "office", "rtf", False),
]


@query(_values([(n, t, s, no) for n, _, t, s, no in _KINDS], "filename, doc_type, subtype, declined"))
def content_types(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(n, c) for n, c, *_ in _KINDS], "filename string, content binary")
    return t.select("filename", files.classify(F.col("content"), F.col("filename")).alias("r")).select("filename", "r.*")


def _named(raw_name: bytes, flag: int, extra: bytes = b"") -> bytes:
    """A zip of one stored member with its name as bytes."""
    head = struct.pack("<HHHHHIIIHH", 20, flag, 0, 0, 33, zlib.crc32(b"x"), 1, 1, len(raw_name), len(extra))
    local = b"PK\x03\x04" + head + raw_name + extra + b"x"
    central = b"PK\x01\x02" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, 0) + raw_name + extra
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


def _path_field(name: str, plain: bytes) -> bytes:
    field = b"\x01" + struct.pack("<I", zlib.crc32(plain)) + name.encode()
    return struct.pack("<HH", 0x7075, len(field)) + field


_NAMES = [
    ("utf8", _named("é.txt".encode(), 0x800), "é.txt"), ("extra", _named(b"?.txt", 0, _path_field("ж.txt", b"?.txt")), "ж.txt"), ("stale", _named(b"new.txt", 0, _path_field("old.txt", b"other")), "new.txt"),
    ("charset", _named("отчет за январь.txt".encode("cp866"), 0), "отчет за январь.txt"), ("tar", _tar({"dir/письмо.txt": b"x"}), "письмо.txt"),
]


@query(_values([(k, n) for k, _, n in _NAMES], "sha256, filename"))
def member_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of members in UTF-8, with a field that repeats them in UTF-8 (if its checksum holds), and in a charset nobody declared."""
    t = spark.createDataFrame([(k, "archive", raw) for k, raw, _ in _NAMES], "sha256 string, doc_type string, content binary")
    return containers.members_of(t).select(F.col("parent_sha").alias("sha256"), "filename")


_DEEP = "".join(hashlib.sha256(bytes([n])).hexdigest() for n in range(16))


@query(_values([("m.eml", "text/plain"), ("note.txt", "plain"), ("f.pdf", "%PDF-1"), ("deep.txt", _DEEP)], "filename, content").replace("'text/plain'", f"'{len(_mail())} bytes'"))
def containers_unrolled(spark: SparkSession, d: str) -> DataFrame:
    """A mail and a packed archive inside an archive, opened to the bottom."""
    raw = _zip({"dir/m.eml": _mail(), "note.txt": "plain", "in.tgz": gzip.compress(_tar({"x/deep.txt": _DEEP.encode()}))})
    t = spark.createDataFrame([("z", "archive", raw)], "sha256 string, doc_type string, content binary")
    got = containers.unroll_all(t, files.classify).filter("filename <> 'in.tgz'")
    shown = F.when(F.col("filename") == "m.eml", F.concat(F.octet_length("content"), F.lit(" bytes"))).otherwise(F.decode("content", "UTF-8"))
    return got.select("filename", shown.alias("content"))


@query(_values([("bz2", "UNSUPPORTED_FORMAT"), ("broken", "ARCHIVE_DAMAGED"), ("large", "ARCHIVE_TOO_LARGE"), ("plain.gz", "UNSUPPORTED_FORMAT")], "sha256, reason"))
def archives_declined(spark: SparkSession, d: str) -> DataFrame:
    rows = [("bz2", b"BZh9"), ("broken", b"PK\x03\x04broken"), ("large", gzip.compress(b"\0" * (1 << 20), 9)), ("plain.gz", gzip.compress(b"words"))]
    t = spark.createDataFrame([(k, "archive", raw) for k, raw in rows], "sha256 string, doc_type string, content binary")
    return containers.members_of(t).select(F.col("parent_sha").alias("sha256"), "reason")


_MAILS = [
    ("one", _mail(), "Hi", "1@x.org", datetime(2025, 2, 3, 9), "from ada@x.org to b@y.org to c@z.org", "", ""),
    ("two", b"From: \"A B\" <a@b.org>\nTo: undisclosed\nSubject: =?koi8-r?B?8NLJ18XU?=\nReferences: <r1@x> <r2@x>\nIn-Reply-To: <r2@x>\nDate: nonsense\n\nx", "Привет", "", None, "from a@b.org to undisclosed!", "r2@x r1@x", "missing_message_id missing_date"),
]


@query(_values([(k, *r) for k, _, *r in _MAILS], "sha256, subject, message_id, sent_at, boxes, refs, warnings"))
def mail_parsed(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(k, raw) for k, raw, *_ in _MAILS], "sha256 string, content binary")
    box = lambda x: F.concat(x["kind"], F.lit(" "), x["address"], F.when(x["valid"], "").otherwise("!"))
    m = containers.messages(t)
    return m.select("sha256", "subject", "message_id", "sent_at", F.array_join(F.transform("addresses", box), " ").alias("boxes"), F.array_join("references", " ").alias("refs"), F.array_join("warnings", " ").alias("warnings"))


_BROKEN = [
    ("folded", b"From: a@b.c\nSubject: one\nbroken line\nTo: d@e.f\n\nbody", "one broken line", "d@e.f", "body", "header_repaired missing_message_id missing_date"),
    ("no blank line", b"From: a@b.c\nSubject: two\nThe body begins here\nand ends", "two", "", "The body begins here\nand ends", "header_repaired missing_message_id missing_date"),
    ("eight bits", "From: a@b.c\nSubject: ".encode() + RUSSIAN.encode("koi8-r") + b"\n\nx", RUSSIAN, "", "x", "header_detected missing_message_id missing_date"),
    ("eight bits of utf-8", f"From: a@b.c\nSubject: {RUSSIAN}\n\nx".encode(), RUSSIAN, "", "x", "missing_message_id missing_date"),
    ("extended name", b"From: a@b.c\nContent-Type: application/pdf\nContent-Disposition: attachment; filename*=koi8-r''%F4.pdf\n\nx", "", "", "", "missing_message_id missing_date"),
]


@query(_values([(k, *r) for k, _, *r in _BROKEN], "sha256, subject, recipient, body, warnings"))
def mail_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Header lines that are no fields, and headers in bytes that nobody declared."""
    m = containers.messages(spark.createDataFrame([(k, raw) for k, raw, *_ in _BROKEN], "sha256 string, content binary"))
    to = F.coalesce(F.element_at(F.col("headers"), "to"), F.lit(""))
    return m.select("sha256", "subject", to.alias("recipient"), "body", F.array_join("warnings", " ").alias("warnings"))


@query(_values([("folded name", "т.pdf".upper().replace("PDF", "pdf")), ("nul", "NUL_BYTES"), ("text", "words")], "what, got"))
def plain_sources(spark: SparkSession, d: str) -> DataFrame:
    """Names of attachments in a declared charset, and plain text, which holds no NUL."""
    m = containers.read_message(_BROKEN[-1][1])
    def read(raw: bytes) -> str:
        try:
            return containers.plain_text(raw)[0]
        except containers.Declined as e:
            return str(e)

    return spark.createDataFrame([("folded name", m.members[0].filename), ("nul", read(b"a\0b")), ("text", read(b"words"))], "what string, got string")


_W = 'xmlns:w="urn:w"'
_OFFICE = [
    ("docx", _zip({"word/document.xml": f"<w:document {_W}><w:body><w:p><w:t>Hello</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}), "Hello\na\tb"),
    ("pptx", _zip({"ppt/slides/slide1.xml": f"<w:s {_W}><w:p><w:t>One</w:t></w:p></w:s>", "ppt/slides/slide10.xml": f"<w:s {_W}><w:p><w:t>Ten</w:t></w:p></w:s>", "ppt/notesSlides/notesSlide1.xml": f"<w:n {_W}><w:p><w:t>said</w:t></w:p></w:n>"}), "# Slide 1\nOne\n\nNotes:\nsaid\n\n# Slide 10\nTen"),
    ("xlsx", _zip({"xl/workbook.xml": f'<w:b {_W}><w:sheet name="S"/></w:b>', "xl/sharedStrings.xml": f"<w:sst {_W}><w:si><w:t>x</w:t></w:si></w:sst>", "xl/worksheets/sheet1.xml": f'<w:s {_W}><w:row><w:c t="s"><w:v>0</w:v></w:c><w:c><w:v>7</w:v></w:c></w:row></w:s>'}), "# S\nx\t7"),
    ("odt", _zip({"content.xml": f"<w:d {_W}><w:h>Head</w:h><w:p>Text</w:p></w:d>"}), "Head\nText"), ("rtf", rb"{\rtf1{\fonttbl x}\pard Hi\par caf\'e9}", "Hi\ncafé"),
]


@query(_values([(k, t) for k, _, t in _OFFICE], "kind, text"))
def office_texts(spark: SparkSession, d: str) -> DataFrame:
    read = F.udf(lambda raw, kind: containers.office_text(bytes(raw), kind), "string")
    return spark.createDataFrame([(k, raw) for k, raw, _ in _OFFICE], "kind string, raw binary").select("kind", read("raw", "kind").alias("text"))


_CHARSETS = [
    ("utf8", "é".encode(), None, "é", ""), ("mark", "﻿x".encode("utf-16-le"), None, "x", "bom:utf-16-le"), ("declared", "é".encode("latin-1"), "latin-1", "é", "declared:latin-1"),
    ("cyrillic", RUSSIAN.encode("windows-1251"), None, RUSSIAN, "detected:windows-1251"), ("koi", RUSSIAN.encode("koi8-r"), None, RUSSIAN, "detected:koi8-r"), ("lost", b"\x80\xff a", None, "�� a", "replaced"),
]


@query(_values([(k, t, n) for k, _, _, t, n in _CHARSETS], "name, text, note"))
def charsets(spark: SparkSession, d: str) -> DataFrame:
    read = F.udf(lambda raw, declared: containers.decode_text(bytes(raw), declared), "text string, note string")
    t = spark.createDataFrame([(k, raw, dec) for k, raw, dec, _, _ in _CHARSETS], "name string, raw binary, declared string")
    return t.select("name", read("raw", "declared").alias("r")).select("name", "r.*")


_PAGES = [
    ("<html><head><title>no</title></head><body><p>A &amp; B</p><table><tr><td>c</td><td>d</td></tr></table><script>x</script></body></html>", "\nA & B\n\tc\td"),
    ("a<br>b<style>p{}</style><h2>c</h2><li>d &lt;e&gt; &#233;</li>", "a\nb\nc\nd <e> é"), ("no tags", "no tags"), ("", ""), ("<head>only", ""),
]


@query(_values([(n, t) for n, (_, t) in enumerate(_PAGES)], "n, text"))
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Breaks at blocks, tabs at cells, nothing of scripts, styles and the head."""
    return spark.createDataFrame([(n, h) for n, (h, _) in enumerate(_PAGES)], "n int, h string").select("n", text.strip_html("h").alias("text"))


@query(_values([(1, "Name   Sum\nx        7\ny\n\nend\n\nnext page")], "doc_id, text"))
def pages_laid_out(spark: SparkSession, d: str) -> DataFrame:
    cells = [("Name", 0, 0, 40, 10), ("Sum", 70, 1, 100, 11), ("x", 0, 12, 10, 22), ("7", 90, 12, 100, 22), ("y", 0, 24, 10, 34), ("end", 0, 60, 30, 70)]
    rows = [(1, 1, w, float(a), float(b), float(c), float(e)) for w, a, b, c, e in cells] + [(1, 2, "next", 0.0, 0.0, 40.0, 10.0), (1, 2, "page", 50.0, 0.0, 90.0, 10.0)]
    return layout.lay_out(spark.createDataFrame(rows, "doc_id int, page int, text string, left double, top double, right double, bottom double"))


# -- scalar functions ------------------------------------------------------------------


_CLEANED = [
    ("<Ada@X.ORG> ", "ada@x.org", "X.ORG> ", False, "ada@x.org", "<Ada@X.ORG>"), ("a@b@c-d.org", "a@b@c-d.org", "c-d.org", True, "a@b@c-d.org", "a@b@c-d.org"),
    ("1. News <news.x.org>", "1. news <news.x.org", "1. News <news.x.org>", False, "news.x.org", "News <news.x.org>"), ("- a\0b", "- ab", "- ab", False, "- ab", "ab"),
]


@query(_values([(n, *r[1:]) for n, r in enumerate(_CLEANED)], "n, address, domain, valid, list_id, cleaned"))
def scalar_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """NUL gone, addresses, domains after the last sign, list identifiers and query lines."""
    t = spark.createDataFrame([(n, r[0]) for n, r in enumerate(_CLEANED)], "n int, t string").select("n", text.storable(F.col("t")).alias("t"))
    c = F.col("t")
    return t.select("n", text.normal_address(c).alias("address"), text.sender_domain(c).alias("domain"), text.valid_domain(text.sender_domain(c)).alias("valid"), text.list_id(c).alias("list_id"), text.clean_query(c).alias("cleaned"))


# -- requests, pages, choices -----------------------------------------------------------


def _tried(f, *args: object) -> str:  # noqa: ANN001
    try:
        return str(f(*args))
    except ValueError:
        return "refused"


@query(_values([
    ("Ada <ADA@X.org>", "ada@x.org"), ("a@b, c@d", "refused"), ("a b@c", "refused"), ("@X-y.Org", "x-y.org"), ("-a.org", "refused"), ("a..b", "refused"),
    ("2024-02-03", "2024-02-03 00:00:00"), ("2024-02-03T10:00:00", "refused"), ("2024-02-03T10:00:00+01:00", "2024-02-03 10:00:00+01:00"), ("a 1 .", "False"), ("éé", "True"),
], "given, got"))
def requests_checked(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses, domains, moments and readable questions; what is none of them is refused."""
    checks = {guards.mailbox_address: ("Ada <ADA@X.org>", "a@b, c@d", "a b@c"), guards.domain_name: ("@X-y.Org", "-a.org", "a..b"), guards.moment: ("2024-02-03", "2024-02-03T10:00:00", "2024-02-03T10:00:00+01:00"), guards.readable: ("a 1 .", "éé")}
    return spark.createDataFrame([(v, _tried(f, v)) for f, values in checks.items() for v in values], "given string, got string")


_MESSAGES = "SELECT event_id AS doc_id, CASE WHEN event_id % 17 <> 0 THEN ts END AS sent_at FROM events WHERE user_id = 7"


def _box(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").filter("user_id = 7")
    m = e.select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("sent_at"), F.lit(datetime(2000, 1, 1)).alias("ingested_at"))
    return m, spark.createDataFrame([], "doc_id long, kind string, ordinal int, address string, valid boolean")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY sent_at DESC NULLS LAST, doc_id DESC) AS place FROM ({_MESSAGES})")
def pages_followed(spark: SparkSession, d: str) -> DataFrame:
    """A mailbox read page by page with opaque cursors, every other page cut short by its reader: all messages, once, in order."""
    m, none = _box(spark, d)
    got, at = [], None
    while True:
        page = mailbox.list_messages(m, none, now=NOW, limit=9, at=at)
        page = page.truncated(4) if len(got) % 2 and len(page.rows) > 4 else page
        got += [r["doc_id"] for r in page.rows]
        if not page.more:
            return spark.createDataFrame([(i, n) for n, i in enumerate(got, 1)], "doc_id long, place long")
        at = page.cursor


@query(f"SELECT doc_id, row_number() OVER (ORDER BY sent_at ASC NULLS LAST, doc_id) AS place FROM ({_MESSAGES})")
def conversation_order(spark: SparkSession, d: str) -> DataFrame:
    m, _ = _box(spark, d)
    rows = m.orderBy(*mailbox.reading_order()).collect()
    return spark.createDataFrame([(r["doc_id"], n) for n, r in enumerate(rows, 1)], "doc_id long, place long")


@query(_values([("clamped", "200 limit_clamped"), ("default", "25 "), ("other filters", "refused"), ("other order", "refused"), ("boundary repeated", "refused"), ("wrong order", "refused"), ("in order", "taken"), ("document", "text 3"), ("other text", "refused"), ("beyond", "refused")], "what, got"))
def page_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Limits, cursors of other requests, pages out of order, and cursors into a document's text."""
    m = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(NOW).alias("sent_at"), F.lit(datetime(2000, 1, 1)).alias("ingested_at"))
    none = spark.createDataFrame([], "doc_id long, kind string, ordinal int, address string, valid boolean")
    took = lambda n: (lambda x: f"{len(x.rows)} {' '.join(x.warnings)}")(mailbox.list_messages(m, none, now=NOW, limit=n))
    at = mailbox.cursor({"a": 1}, True, None, 5, NOW)
    rows = [{"sent_at": NOW, "doc_id": i} for i in (3, 2, 1)]

    def ordered(*args: object) -> str:
        try:
            mailbox.verified(*args)
        except RuntimeError:
            return "refused"
        return "taken"

    doc = mailbox.document_cursor({"q": 1}, "d", "é é", "text", 3)
    far = mailbox.document_cursor({"q": 1}, "d", "é é", "text", 6)
    got = {
        "clamped": took(1000), "default": took(None), "other filters": _tried(mailbox.read_cursor, at, {"a": 2}, True), "other order": _tried(mailbox.read_cursor, at, {"a": 1}, False),
        "boundary repeated": ordered(rows, True, (NOW, 3)), "wrong order": ordered(rows[::-1]), "in order": ordered(rows, True, (NOW, 4)), "document": " ".join(map(str, mailbox.read_document_cursor(doc, {"q": 1}, "d", "é é"))),
        "other text": _tried(mailbox.read_document_cursor, doc, {"q": 1}, "d", "e e"), "beyond": _tried(mailbox.read_document_cursor, far, {"q": 1}, "d", "é é"),
    }
    return spark.createDataFrame(list(got.items()), "what string, got string")


@query("SELECT doc_id, text FROM documents WHERE doc_id < 40")
def texts_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts read in pages of at most 1,000 bytes from kept snapshots, put together again."""
    kept, out = service.Snapshots(most=64, size=1 << 30), []
    for r in table(spark, d, "documents").filter("doc_id < 40").select("doc_id", "text").collect():
        key, at, parts = kept.put([r["text"]]), 0, []
        while at is not None:
            part, at = kept.page(key, 0, at, 1000)
            parts.append(part)
        out.append((r["doc_id"], "".join(parts) if max(len(p.encode()) for p in parts) <= 1000 else None))
    return spark.createDataFrame(out, "doc_id long, text string")


def _c(i: int, doc: str, words: str, score: float = 1.0, **more: object) -> Candidate:
    return Candidate(str(i), doc, words, score=score, **more)


@query(_values([
    ("one a document and text", "1 3 / 0"), ("all under the floor", " / 3"), ("one under the floor", "0 1 / 1"), ("same text reflowed", "1 / 0"), ("other digits", "1 2 / 0"), ("at most k", "0 1 / 0"),
    ("no scorer", "1 2 rerank_unavailable"), ("scored", "2 1 "), ("scores missing", "1 2 rerank_unavailable"), ("pool of two", "24 True"), ("pool of one", "12 False"), ("budget", "60 0 60 True"), ("empty budget", "0 False"),
    ("relations", "parent"), ("sub-queries", "closing balance|solicitor parenting|cruise"), ("spellings", "A  b|c"), ("at most four", "a|b|c|d"), ("no planner", "q "), ("broken planner", "q decompose_unavailable"),
], "what, got"))
def bounded_choices(spark: SparkSession, d: str) -> DataFrame:
    """Pool, reranking, floor, selection, packing and sub-queries on given candidates."""
    ids = lambda x: " ".join(c.placement for c in x[0]) + f" / {x[1]}"
    pick = lambda *cs, k=15: ids(retrieval.select(cs, k))
    scored = lambda *s: pick(*(_c(i, str(i), str(i), x) for i, x in enumerate(s)))
    two = [_c(1, "a", "x"), _c(2, "b", "y")]
    rank = lambda f: (lambda x: f"{' '.join(c.placement for c in x[0])} {x[1]}")(retrieval.rerank("q", two, f))
    legs = [[_c(100 * q + i, f"{q}{i}", "t", rrf=1 / (q + i + 1), dense_rank=i + 1, lex_rank=1 if i < 3 else None) for i in range(12)] for q in range(2)]
    pool = lambda g: (lambda x: f"{len({c.placement for c in x[0]})} {x[1]}")(retrieval.pool(g))
    packed, bound = retrieval.packets(two, {"a": "u" * 60, "b": "v" * 60}, [], 100)
    empty = retrieval.Budget(0)
    kin, _ = retrieval.packets(two[:1], {"a": "1", "r": "2"}, [{"anchor": "a", "doc": "r", "relation": "sibling"}, {"anchor": "a", "doc": "r", "relation": "parent"}])
    plan = lambda f: (lambda x: f"{' '.join(x[0])} {x[1]}")(retrieval.decompose("q", f))
    got = {
        "one a document and text": pick(_c(1, "d1", "t1"), _c(2, "d2", "t1"), _c(3, "d2", "t2")), "all under the floor": scored(-0.03, -0.092, -0.213), "one under the floor": scored(0.5, 0.4, -0.1),
        "same text reflowed": pick(_c(1, "a", "x\n y"), _c(2, "b", "x y")), "other digits": pick(_c(1, "a", "x 1"), _c(2, "b", "x 2")), "at most k": pick(*(_c(i, str(i), str(i)) for i in range(5)), k=2),
        "no scorer": rank(None), "scored": rank(lambda q, t: [0.1, 0.9]), "scores missing": rank(lambda q, t: []), "pool of two": pool(legs), "pool of one": pool(legs[:1]),
        "budget": f"{len(packed[0].text)} {len(packed[1].text)} {bound.used} {bound.truncated}", "empty budget": f"{len(empty.admit(''))} {empty.truncated}", "relations": " ".join(r["relation"] for r in kin[0].related),
        "sub-queries": "|".join(retrieval.sub_queries(["1. closing balance", "- solicitor parenting", "* cruise"])), "spellings": "|".join(retrieval.sub_queries(["A  b", "a B", "c"])), "at most four": "|".join(retrieval.sub_queries("abcdef")),
        "no planner": plan(None), "broken planner": plan(lambda q: 1 / 0),
    }
    return spark.createDataFrame(list(got.items()), "what string, got string")


@query(_values([("1", "1,2,4", "alpha beta gamma", "parent:4 attachment:2", "dense_leg_underfill")], "doc, given, text, related, warnings").replace("'1,2,4', ", "").replace("doc, given, text", "doc, text"))
def question_answered(spark: SparkSession, d: str) -> DataFrame:
    """The whole read path over four documents: legs, fusion, scores, floor, containment, packing."""
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "eta"), (4, "zeta")], "doc_id long, text string").withColumn("status", F.lit("COMPLETED"))
    chunks, placements = store.replace_chunks(
        spark.createDataFrame([], "chunk_id string, embed_model string, raw_sha256 string, chunk_text string"),
        spark.createDataFrame([], "placement_id string, doc_id long, chunk_id string, chunk_index int, start_byte int, end_byte int, slice_sha256 string"), chunking.chunk(docs), "m",
    )
    vectors = models.embed(chunks, models.hashed_embedding, key="chunk_id", text="chunk_text", dim=64)
    edges = spark.createDataFrame([(1, 2), (4, 1)], "container_id long, contained_id long")
    t = service.Tables(placements, chunks.join(vectors, "chunk_id"), docs, edges)
    got = service.search("alpha beta", t, embed=models.hashed_embedding, scorer=lambda q, ts: [float("alpha" in x) - 0.5 for x in ts])
    rows = [(p.match.doc, p.text, " ".join(f"{r['relation']}:{r['doc']}" for r in p.related), " ".join(got.warnings)) for p in got.packets]
    return spark.createDataFrame(rows, "doc string, text string, related string, warnings string")


# -- evaluation ------------------------------------------------------------------------


@query(_values([("good", 3, 2, 0.75, 0.75, 0.75, 1.0, 0.9, True), ("low recall", 2, 1, 0.5, 1.0, 1.0, None, None, False), ("missed empty", 1, 1, 1.0, 1.0, 1.0, 0.5, None, False), ("bad index", 1, 1, 1.0, 1.0, 1.0, None, 0.8, False), ("nothing ranked", 1, 0, None, None, None, None, None, True)], "run, cases, ranked, recall, mrr, ndcg, empty, ann, passed"))
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over the cases that expect something, and all five thresholds."""
    case = lambda *r: spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(r)], "case_id int, n_expected double, recall double, rr double, ndcg double")
    one = lambda name, kind, *v: spark.createDataFrame([(x,) for x in v], f"{name} {kind}")
    full = (1, 1, 1, 1)
    runs = {
        "good": (case(full, (1, 0.5, 0.5, 0.5), (0, 1, 0, 0)), one("passed", "boolean", True), one("overlap", "double", 0.9)), "low recall": (case((1, 0.5, 1, 1), (0, 1, 0, 0)),),
        "missed empty": (case(full), one("passed", "boolean", True, False)), "bad index": (case(full), None, one("overlap", "double", 0.8)), "nothing ranked": (case((0, 1, 0, 0)),),
    }
    rows = [(name, *evaluate.summary(*args).select("cases", "ranked", "recall", "mrr", "ndcg", "empty", "ann", "passed").first()) for name, args in runs.items()]
    return spark.createDataFrame(rows, "run string, cases long, ranked long, recall double, mrr double, ndcg double, empty double, ann double, passed boolean")


@query(_values([("whole", "c1:aa:3 c1:bb:1"), ("other version", "refused"), ("repeated id", "refused"), ("grade of 4", "refused"), ("empty and expected", "refused"), ("unknown hash", "refused"), ("written twice", "refused"), ("same runs", "None"), ("other cases", "refused")], "what, got"))
def case_sets(spark: SparkSession, d: str) -> DataFrame:
    """Case sets are taken whole or refused; reports are never overwritten; runs over other cases are not compared."""
    def case(i: str, *found: tuple[str, int], empty: bool = False) -> dict:
        return {"id": i, "question": "q", "expected_documents": [{"match": {"raw_sha256": s}, "grade": g} for s, g in found], "require_all_expected_documents": False, "expected_empty": empty}

    sets = {
        "whole": (6, [case("c1", ("aa", 3), ("bb", 1)), case("c2", empty=True)]), "other version": (5, [case("c1", ("aa", 3))]), "repeated id": (6, [case("c1", ("aa", 3)), case("c1", ("bb", 3))]),
        "grade of 4": (6, [case("c1", ("aa", 4))]), "empty and expected": (6, [case("c1", ("aa", 1), empty=True)]),
    }
    root = _files(spark, {f"{name}.json": json.dumps({"version": v, "cases": c}).encode() for name, (v, c) in sets.items()})
    told = lambda name: " ".join(sorted(f"{r['case_id']}:{r['sha']}:{r['grade']}" for r in cases.expected(cases.load(spark, f"{root}/{name}.json")).collect()))
    known = spark.createDataFrame([("aa", 1)], "sha string, doc_id long")
    got = {name: _tried(told, name) for name in sets}
    whole = cases.load(spark, f"{root}/whole.json")
    got["unknown hash"] = _tried(evaluate.resolved, cases.expected(whole), known)
    cases.archive(known, f"{root}/runs", "r1")
    try:
        cases.archive(known, f"{root}/runs", "r1")
        got["written twice"] = "taken"
    except Exception:  # the session's own kind of error
        got["written twice"] = "refused"
    run = {"digest": evaluate.case_digest(whole), "version": "1"}
    got["same runs"] = _tried(evaluate.comparable, run, {"digest": evaluate.case_digest(whole.orderBy(F.col("id").desc())), "version": "1"})
    got["other cases"] = _tried(evaluate.comparable, run, {"digest": evaluate.case_digest(whole.limit(1)), "version": "1"})
    return spark.createDataFrame(list(got.items()), "what string, got string")


# -- store, admission, containment ------------------------------------------------------


@query(_values([("first", "a.eml PENDING emails, b.log SKIPPED -, c.txt PENDING embed", 3, 4), ("again", "a.eml PENDING emails, b.log SKIPPED -, c.txt PENDING embed", 3, 4), ("less", "a.eml PENDING emails, b.log SKIPPED -, c.txt PENDING embed", 3, 2)], "scan, documents, known, available").replace(", 3, 4", ", 2, 4").replace(", 3, 2", ", 2, 2"))
def files_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Three scans: contents become documents once, with one job; a complete scan tells what is gone."""
    here = {"a.eml": _mail(), "b.log": b"x = 1", "c.txt": b"some words", "d/copy.txt": b"some words"}
    docs = spark.createDataFrame([], "doc_id string, raw_sha256 string, source_filename string, doc_type string, status string, reason string, updated_at timestamp")
    jobs = spark.createDataFrame([], "job_id string, doc_id string, subject string, revision string, state string, generation long, attempts int, available_at timestamp, created_at timestamp")
    seen = spark.createDataFrame([], "root_id string, relative_path string, doc_id string, available boolean")
    rows = []
    for name, part in (("first", list(here)), ("again", list(here)), ("less", ["a.eml", "c.txt"])):
        t = spark.createDataFrame([(p, p.split("/")[-1], here[p]) for p in part], "relative_path string, filename string, content binary").withColumn("sha256", F.sha2("content", 256))
        docs, jobs, seen = (stored(x, "admitted") for x in admission.admit(docs, jobs, seen, t, root_id="r", now=NOW, complete=True))
        told = docs.join(jobs.select("doc_id", "subject"), "doc_id", "left").orderBy("source_filename").collect()
        rows.append((name, ", ".join(f"{r['source_filename']} {r['status']} {r['subject'] or '-'}" for r in told), jobs.count(), seen.filter("available").count()))
    return spark.createDataFrame(rows, "scan string, documents string, known long, available long")


@query(_values([("all read", "1>2 1>3", True), ("one unreadable", "1>2 1>3", False), ("unparsed with children", "1>2 1>3", False), ("unparsed without", "1>2 1>3", True)], "what, edges, complete"))
def containment_backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, sha string")
    found = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("a", "unknown"), ("a", "b")], "parent_sha string, child_sha string")
    rows = []
    for name, read in {"all read": ("a", True, True, True), "one unreadable": ("a", False, False, False), "unparsed with children": ("a", True, False, True), "unparsed without": ("a", True, False, False)}.items():
        edges, state = graph.backfilled(found, docs, spark.createDataFrame([read], "sha string, readable boolean, parsed boolean, had_children boolean"))
        rows.append((name, " ".join(f"{r['container_id']}>{r['contained_id']}" for r in edges.orderBy("container_id", "contained_id").collect()), state.first()["complete"]))
    return spark.createDataFrame(rows, "what string, edges string, complete boolean")


@query(_values([("documents", 2, 2), ("containment", 1, 1), ("jobs", 1, 1), ("metadata", 1, 1)], "name, left_over, wiped").replace("2, 2", "2, 0").replace("'containment', 1, 1", "'containment', 1, 0").replace("'jobs', 1, 1", "'jobs', 1, 0"))
def forgotten_and_wiped(spark: SparkSession, d: str) -> DataFrame:
    """One document forgotten by its hash in every table; a wipe leaves only the metadata."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, sha string")
    tables = {
        "documents": docs, "containment": spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "container_id long, contained_id long"), "jobs": spark.createDataFrame([(2, "x"), (3, "y")], "doc_id long, job string"),
        "metadata": spark.createDataFrame([("m", 2)], "model string, doc_id long"),
    }
    left = store.forgotten(tables, store.by_hash(docs, spark.createDataFrame([("b",)], "sha string")))
    return spark.createDataFrame([(k, left[k].count(), store.wiped(tables)[k].count()) for k in tables], "name string, left_over long, wiped long")


@query(_values([("batch sizes", "64 64 64 8"), ("charset names", "отчет за январь"), ("recovered", "READY 0 3"), ("changed since", "refused"), ("rerouted", "text PENDING embed"), ("declined", "unsupported SKIPPED -"), ("running", "refused"), ("nothing staged", "refused"), ("not backfilled", "refused"), ("breaker", "open")], "what, got"))
def guarded_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes that hold only under their conditions, and are refused otherwise."""
    schema = "job_id string, doc_id string, subject string, revision string, state string, generation long, attempts int, available_at timestamp, created_at timestamp, lease_until timestamp"
    failed = spark.createDataFrame([("j", "d", "pdfs", "r", "FAILED", 2, 3, NOW, NOW, None)], schema)
    running = spark.createDataFrame([("j", "d", "pdfs", "r", "RUNNING", 2, 3, NOW, NOW, NOW + timedelta(hours=1))], schema)
    docs = spark.createDataFrame([("d", "pdf", "FAILED", "OCR_FAILED", NOW)], "doc_id string, doc_type string, status string, reason string, updated_at timestamp")
    route = lambda kind, subject: spark.createDataFrame([("d", kind, subject)], "doc_id string, doc_type string, subject string")

    def safe(f, *args: object, **more: object):  # noqa: ANN001, ANN202
        try:
            return f(*args, **more)
        except RuntimeError:
            return "refused"

    def routed(kind: str, subject: str | None) -> str:
        a, b = J.rerouted(docs, failed, route(kind, subject), NOW)
        r, j = a.first(), b.filter("state = 'READY'").first()
        return f"{r['doc_type']} {r['status']} {j['subject'] if j else '-'}"

    back = J.recovered(failed, failed, NOW).first()
    breaker = models.Breaker(most=2)
    for _ in range(3):
        safe(breaker.call, lambda: 1 / 0)
    edges = spark.createDataFrame([], "src string, dst string")
    known = docs.withColumn("sha", F.col("doc_id"))
    none = spark.createDataFrame([], "sha string")
    got = {
        "batch sizes": " ".join(str(len(b)) for b in chunking.batches(["w" * 100] * 200)), "charset names": names.decode_names(["отчет за январь".encode("cp866"), "договор".encode("cp866")])[0][0],
        "recovered": f"{back['state']} {back['attempts']} {back['generation']}", "changed since": str(safe(J.recovered, failed, running, NOW)), "rerouted": routed("text", "embed"), "declined": routed("unsupported", None),
        "running": str(safe(J.rerouted, docs, running, route("text", "embed"), NOW)), "nothing staged": str(safe(store.prune_plan, known, edges, none, None, backfilled=True)),
        "not backfilled": str(safe(store.prune_plan, known, edges, known.select("sha"), None, backfilled=False)), "breaker": "open" if breaker.opened is not None else "closed",
    }
    return spark.createDataFrame(list(got.items()), "what string, got string")
