"""Queries over files, mails, containers and requests that Spark makes from the tables."""

from __future__ import annotations

import io
import tarfile
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions import text
from lodeworks.operators import admission, evaluate, graph, mailbox, store
from lodeworks.operators import jobs as J
from lodeworks.operators.tables import stored
from lodeworks.plans.registry import query, table
from lodeworks.sources import containers, files

NOW = datetime(2026, 1, 1)


def _bytes(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8")


def _base64(c: Column) -> Column:
    return F.base64(F.encode(c, "UTF-8"))


@F.pandas_udf(T.BinaryType())
def _zipped(members: pd.Series) -> pd.Series:
    """A zip of (name, content) pairs."""

    def one(pairs: list[dict]) -> bytes:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for p in pairs:
                z.writestr(zipfile.ZipInfo(p["name"]), p["content"])
        return raw.getvalue()

    return members.map(one)


# -- mail and containers ------------------------------------------------------------------


def _mails(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of a conversation as a mail that answers the one before, its text in base64."""
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    day = F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")
    answers = F.when(F.col("turn") > 0, F.concat(F.lit("In-Reply-To: <"), "conv_id", F.lit("."), F.col("turn") - 1, F.lit("@x.org>\r\n"))).otherwise("")
    raw = _bytes(
        'From: "', F.col("role"), '" <', F.initcap("role"), "@X", F.col("conv_id") % 5, ".ORG>\r\nTo: a@b.org, nobody\r\n\t, \"C, D\" <c@d.org>\r\nSubject: =?utf-8?B?", _base64(F.concat(F.lit("Gespräch "), "conv_id")),
        "?= turn\r\n ", F.col("turn"), "\r\nDate: ", day, " Mar 2025 10:00:00 +0200\r\nMessage-ID: <", F.col("conv_id"), ".", F.col("turn"), "@x.org>\r\n", answers,
        "Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n", _base64(F.col("text")), "\r\n",
    )
    return t.select(F.concat("conv_id", F.lit("."), "turn").alias("sha256"), raw.alias("content"))


@query(r"""SELECT conv_id || '.' || turn AS sha256, 'Gespräch ' || conv_id || ' turn ' || turn AS subject, conv_id || '.' || turn || '@x.org' AS message_id,
  TIMESTAMP '2025-03-01 08:00:00' + to_days(CAST(conv_id % 28 AS INTEGER)) AS sent_at, 'from ' || role || '@x' || conv_id % 5 || '.org ' || role || ',to a@b.org ,to nobody !,to c@d.org C, D' AS boxes,
  CASE WHEN turn > 0 THEN conv_id || '.' || (turn - 1) || '@x.org' ELSE '' END AS refs, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN text ELSE '' END AS body, '' AS warnings FROM conversations WHERE conv_id >= 0""")
def mail_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Subjects in encoded words, folded headers, addresses with names, broken ones that keep their place, dates with zones, references and bodies in base64."""
    box = lambda x: F.concat(x["kind"], F.lit(" "), F.when(x["valid"], x["address"]).otherwise(x["address"]), F.lit(" "), x["display_name"], F.when(x["valid"], "").otherwise("!"))
    m = containers.messages(_mails(spark, d))
    return m.select("sha256", "subject", "message_id", "sent_at", F.array_join(F.transform("addresses", box), ",").alias("boxes"), F.array_join("references", " ").alias("refs"), "body", F.array_join("warnings", " ").alias("warnings"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS sha256, CASE o_orderkey % 3 WHEN 0 THEN 'order ' || o_orderkey || ' and more' ELSE 'order ' || o_orderkey END AS subject, CASE o_orderkey % 3 WHEN 1 THEN '' ELSE 'c' || o_custkey || '@x.org' END AS recipient,
  CASE o_orderkey % 3 WHEN 1 THEN 'The body of ' || o_orderkey ELSE o_orderpriority END AS body, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE 'header_repaired ' END || 'missing_message_id missing_date' AS warnings FROM orders""")
def mail_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Header lines that are no fields, and headers without a blank line after them."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    to = F.concat(F.lit("To: c"), "o_custkey", F.lit("@x.org\n\n"), "o_orderpriority")
    rest = F.when(k % 3 == 0, F.concat(F.lit("and more\n"), to)).when(k % 3 == 1, F.concat(F.lit("The body of "), k.cast("string"))).otherwise(to)
    m = containers.messages(o.select(k.cast("string").alias("sha256"), _bytes("From: a@b.c\nSubject: order ", k, "\n", rest).alias("content")))
    return m.select("sha256", "subject", F.coalesce(F.element_at("headers", "to"), F.lit("")).alias("recipient"), "body", F.array_join("warnings", " ").alias("warnings"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """A mail for each conversation, with a zip of its turns attached."""
    t = table(spark, d, "conversations").filter("text <> ''").select("conv_id", F.struct(F.concat(F.lit("dir/é"), "turn", F.lit(".txt")).alias("name"), F.concat(F.lit("conv "), "conv_id", F.lit("\n"), "text").alias("content")).alias("m"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("members"))
    z = t.select("conv_id", F.base64(_zipped("members")).alias("z"))
    head = 'From: a@b.c\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="cut"\r\n\r\n--cut\r\nContent-Type: text/plain\r\n\r\nsee below\r\n--cut\r\nContent-Type: application/zip\r\nContent-Disposition: attachment; filename="c'
    raw = _bytes(head, F.col("conv_id"), '.zip"\r\nContent-Transfer-Encoding: base64\r\n\r\n', F.col("z"), "\r\n--cut--\r\n")
    return z.select(F.concat(F.lit("m"), "conv_id").alias("sha256"), F.lit("email").alias("doc_type"), raw.alias("content"))


@query("SELECT 'é' || turn || '.txt' AS filename, 'conv ' || conv_id || chr(10) || text AS content FROM conversations WHERE text <> ''")
def containers_unrolled(spark: SparkSession, d: str) -> DataFrame:
    """Mails opened to the bottom: the turns in the archives that are attached to them, under their names."""
    got = containers.unroll_all(_packed(spark, d), files.classify)
    return got.filter("filename LIKE '%.txt'").select("filename", F.decode("content", "UTF-8").alias("content"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'ARCHIVE_DAMAGED' WHEN 1 THEN 'UNSUPPORTED_FORMAT' WHEN 2 THEN 'ARCHIVE_DAMAGED' ELSE NULL END AS reason, CASE WHEN o_orderkey % 5 > 2 THEN 'a' || o_orderkey || '.txt' END AS filename FROM orders""")
def archives_declined(spark: SparkSession, d: str) -> DataFrame:
    """Archives cut short, of a kind that is not read, and no archives at all, each with its reason; whole ones with their member."""
    k = F.col("o_orderkey")
    whole = _zipped(F.array(F.struct(F.concat(F.lit("in\\a"), k.cast("string"), F.lit(".txt")).alias("name"), F.col("o_orderpriority").alias("content"))))
    t = table(spark, d, "orders").select(k.cast("string").alias("sha256"), F.lit("archive").alias("doc_type"), whole.alias("z"), "o_orderkey")
    cut = F.when(k % 5 == 0, F.substr("z", F.lit(1), F.lit(30))).when(k % 5 == 1, F.concat(F.encode(F.lit("BZh9"), "UTF-8"), F.col("z"))).when(k % 5 == 2, F.encode(F.concat(F.lit("PK\x03\x04"), k.cast("string")), "UTF-8")).otherwise(F.col("z"))
    out = containers.members_of(t.select("sha256", "doc_type", cut.alias("content")))
    return out.select(F.col("parent_sha").cast("long").alias("id"), "reason", "filename")


_KINDS = """CASE o_orderkey % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'pdf' WHEN 2 THEN 'archive' WHEN 3 THEN 'text' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'image' WHEN 6 THEN 'office' ELSE 'legacy-office' END"""


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """A file of one of eight kinds for each order."""
    k = F.col("o_orderkey")
    pick = lambda *c: F.element_at(F.array(*c), (k % 8 + 1).cast("int"))
    said, raw = F.concat(k.cast("string"), F.lit(" "), "o_orderpriority"), lambda x: F.unhex(F.lit(x.hex()))
    name = pick(*[F.concat(F.lit("f"), k.cast("string"), F.lit(x)) for x in (".eml", ".bin", ".dat", ".txt", ".log.3", "", ".rtf", ".doc")])
    heads = [F.encode(F.lit("From: a@b.c\nMessage-ID: <1@b.c>\nSubject: "), "UTF-8"), raw(b"%PDF-1.7\n"), raw(b"PK\x03\x04"), raw(b"words "), raw(b"x = "), raw(b"\x89PNG\r\n\x1a\n"), raw(b"{\\rtf1 "), raw(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")]
    return table(spark, d, "orders").select("o_orderkey", name.alias("filename"), F.concat(pick(*heads), F.encode(F.concat(said, F.lit("\n\n")), "UTF-8")).alias("content"))


#: How a file of each kind is named, and what it is taken for.
_TYPES = [
    (".pdf", "pdf", "", False), (".eml", "email", "", False), (".docx", "office", "docx", False), (".zip", "archive", "", False), (".jar", "unsupported", "", True), (".tgz", "archive", "", False), (".txt", "text", "", False), (".log.3", "unsupported", "", True),
    (".doc", "legacy-office", "", True), ("", "image", "", False), (".nul.txt", "unsupported", "", True), (".rtf", "office", "rtf", False), (".xlsx", "office", "xlsx", False), (".pptx", "office", "pptx", False), (".odt", "office", "odt", False),
]
_TYPED = lambda n: f"{[t[n] for t in _TYPES]}[o_orderkey % {len(_TYPES)} + 1]"


@F.pandas_udf(T.BinaryType())
def _tarred(texts: pd.Series) -> pd.Series:
    """A packed tar of one member for each text, nothing for those that are missing."""

    def one(x: str | None) -> bytes | None:
        if x is None:
            return None
        raw, said = io.BytesIO(), x.encode()
        with tarfile.open(fileobj=raw, mode="w:gz") as t:
            member = tarfile.TarInfo("a")
            member.size = len(said)
            t.addfile(member, io.BytesIO(said))
        return raw.getvalue()

    return texts.map(one)


@query(f"SELECT 'f' || o_orderkey || {_TYPED(0)} AS filename, {_TYPED(1)} AS doc_type, {_TYPED(2)} AS subtype, {_TYPED(3)} AS declined FROM orders")
def content_types(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by leading bytes first, by headers of mail, by the members of archives, and by name, of a file of one of fifteen kinds for each order."""
    k, said = F.col("o_orderkey"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority")
    pick = lambda *c: F.element_at(F.array(*c), (k % len(_TYPES) + 1).cast("int"))
    member = lambda name, text=said: F.struct(F.lit(name).alias("name"), text.alias("content"))
    # A name of the first member of each kind that is a zip; text documents name their type there.
    first = {2: "word/document.xml", 3: "a.txt", 4: "a.txt", 12: "xl/workbook.xml", 13: "ppt/slides/slide1.xml"}
    of = pick(*[F.lit(first.get(n, "content.xml")) for n in range(len(_TYPES))])
    odt = F.array(member("mimetype", F.lit("application/vnd.oasis.opendocument.text")), member("content.xml"))
    members = F.when(of != "content.xml", F.array(F.struct(of.alias("name"), said.alias("content")))).when(k % len(_TYPES) == 14, odt).otherwise(F.array().cast("array<struct<name:string,content:string>>"))
    t = table(spark, d, "orders").select("o_orderkey", said.alias("said"), _zipped(members).alias("z"), _tarred(F.when(k % len(_TYPES) == 5, said)).alias("tgz"))
    after = lambda x: F.concat(F.unhex(F.lit(x.hex())), F.encode(F.concat("said", F.lit("\n\n")), "UTF-8"))
    z = F.col("z")
    content = pick(
        after(b"%PDF-1.7\n"), after(b"From: a@b.c\nMessage-ID: <1@b.c>\nSubject: "), z, z, z, F.col("tgz"), after(b"words "), after(b"x = "), after(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), after(b"\x89PNG\r\n\x1a\n"), after(b"a\0b "),
        after(b"{\\rtf1 "), z, z, z,
    )
    name = F.concat(F.lit("f"), k.cast("string"), pick(*[F.lit(x[0]) for x in _TYPES]))
    return t.select(name.alias("filename"), files.classify(content, name).alias("r")).select("filename", "r.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority || chr(10) || o_orderstatus || chr(9) || o_custkey WHEN 1 THEN '# Slide 1' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'Notes:' || chr(10) || 'n' || o_custkey
  WHEN 2 THEN '# S' || chr(10) || o_orderpriority || chr(9) || o_custkey WHEN 3 THEN o_orderpriority || chr(10) || 'c' || o_custkey ELSE 'Grüße ' || o_orderpriority || chr(10) || o_custkey END AS text FROM orders""")
def office_texts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs and tables, slides and notes, cells and shared strings, headings, and escaped letters, of files made for each order."""
    k, p, c, s = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    xml = lambda name, *parts: F.struct(F.lit(name).alias("name"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("content"))
    w, end = '<w:x xmlns:w="urn:w">', "</w:x>"
    cell = lambda x: (f"<w:tc><w:p><w:t>", x, "</w:t></w:p></w:tc>")  # noqa: E731, F541
    members = (
        F.when(k % 5 == 0, F.array(xml("word/document.xml", w + "<w:body><w:p><w:t>", p, "</w:t></w:p><w:tbl><w:tr>", *cell(s), *cell(c), "</w:tr></w:tbl></w:body>" + end)))
        .when(k % 5 == 1, F.array(xml("ppt/slides/slide1.xml", w + "<w:p><w:t>", p, "</w:t></w:p>" + end), xml("ppt/notesSlides/notesSlide1.xml", w + "<w:p><w:t>n", c, "</w:t></w:p>" + end)))
        .when(k % 5 == 2, F.array(xml("xl/workbook.xml", w + '<w:sheet name="S"/>' + end), xml("xl/sharedStrings.xml", w + "<w:si><w:t>", p, "</w:t></w:si>" + end), xml("xl/worksheets/sheet1.xml", w + '<w:row><w:c t="s"><w:v>0</w:v></w:c><w:c><w:v>', c, "</w:v></w:c></w:row>" + end)))
        .otherwise(F.array(xml("content.xml", w + "<w:h>", p, "</w:h><w:p>c", c, "</w:p>" + end)))
    )
    rtf = _bytes(r"{\rtf1{\fonttbl x}\pard Gr\'fc\'dfe ", p, r"\par ", c, "}")
    kind = F.element_at(F.array(*map(F.lit, ("docx", "pptx", "xlsx", "odt", "rtf"))), (k % 5 + 1).cast("int"))
    t = table(spark, d, "orders").select("o_orderkey", F.when(k % 5 == 4, rtf).otherwise(_zipped(members)).alias("raw"), kind.alias("kind"))
    return t.select("o_orderkey", containers.office_texts("raw", "kind")["text"].alias("text"))


_LATIN = r"regexp_matches(t, '^[\x00-\xFF]*$')"


@query(rf"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN doc_id % 5 = 4 THEN 4 WHEN strpos(t, chr(0)) > 0 THEN 4 ELSE doc_id % 5 END AS k FROM s)
SELECT doc_id, CASE WHEN k = 4 THEN NULL ELSE t END AS text, CASE WHEN k = 4 THEN NULL WHEN k = 1 THEN 'bom:utf-16-le' WHEN k = 2 THEN 'bom:utf-16-be' ELSE '' END AS note, CASE WHEN k = 4 THEN 'NUL_BYTES' END AS reason FROM k""")
def charsets(spark: SparkSession, d: str) -> DataFrame:
    """All documents as bytes with and without marks of their encoding, and with NUL, which makes them no text."""
    k, t = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    mark = lambda x, c: F.concat(F.unhex(F.lit(x)), F.encode(t, c))
    raw = F.when(t == "", F.encode(t, "UTF-8")).when(k == 1, mark("FFFE", "UTF-16LE")).when(k == 2, mark("FEFF", "UTF-16BE")).when(k == 3, mark("EFBBBF", "UTF-8")).when(k == 4, F.concat(F.encode(t, "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode(t, "UTF-8"))
    return table(spark, d, "documents").select("doc_id", containers.decoded(raw, F.lit(None).cast("string")).alias("r")).select("doc_id", "r.*")


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, chr(10) || t || chr(10) || chr(9) || 'c' || conv_id || chr(9) || t || ' é <b>' AS text FROM t""")
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Breaks at blocks, tabs at cells, entities, nothing of scripts, styles and the head, around every turn's text."""
    t = F.coalesce("text", F.lit(""))
    safe = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>no</title><style>p{}</style></head><body><p>"), safe, F.lit("</p><script>if (a < b) x</script><table><tr><td>c"), "conv_id", F.lit("</td><td>"), safe, F.lit(" &#233; &lt;b&gt;</td></tr></table></body></html>"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_html(page).alias("text"))


# -- scalars, listings, admission ---------------------------------------------------------


@query(r"""WITH e AS (SELECT event_id, event_id % 3 AS k, 'U' || user_id || '@D' || user_id % 7 || '.Example.ORG' AS a FROM events)
SELECT event_id, lower(a) AS address, 'D' || split_part(a, '@D', 2) AS domain, k = 1 AS valid, CASE k WHEN 0 THEN lower(a) ELSE lower(a) END AS list_id, CASE k WHEN 0 THEN '<' || a || '>' WHEN 1 THEN a ELSE 'News <' || a || '>' END AS cleaned FROM e""")
def scalar_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """NUL gone, addresses, domains after the last sign and whether they are sound, list identifiers and query lines."""
    k = F.col("event_id") % 3
    a = F.concat(F.lit("U"), "user_id", F.lit("@D"), F.col("user_id") % 7, F.lit(".Exa\0mple.ORG"))
    named = F.when(k == 0, F.concat(F.lit("<"), a, F.lit(">"))).when(k == 1, a).otherwise(F.concat(F.lit("News <"), a, F.lit(">")))
    t = table(spark, d, "events").select("event_id", text.storable(a).alias("a"), text.storable(named).alias("n"), k.alias("k"))
    sound = text.valid_domain(F.when(F.col("k") == 1, F.lower(text.sender_domain(F.col("a")))).otherwise(text.sender_domain(F.col("n"))))
    return t.select(
        "event_id", text.normal_address(F.concat(F.lit(" <"), "a", F.lit("> "))).alias("address"), text.sender_domain(F.col("a")).alias("domain"), sound.alias("valid"), text.list_id(F.col("n")).alias("list_id"),
        text.clean_query(F.concat(F.lit("- 1. "), "n", F.lit(" "))).alias("cleaned"),
    )


@query("""SELECT 'o' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.log' ELSE '.txt' END AS path, o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 AS ignored, o_orderkey % 7 IN (1, 2, 3) AS unstable FROM orders""")
def listings_compared(spark: SparkSession, d: str) -> DataFrame:
    """Two listings of a folder with a file for each order: which changed in size, in time or are gone, and which are ignored, the last rule that matches deciding."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("o"), k.cast("string"), F.when(k % 2 == 0, ".log").otherwise(".txt"))
    t = table(spark, d, "orders").select(path.alias("path"), k.alias("size"), F.col("o_orderdate").cast("timestamp").alias("modified_at"), (k % 7).alias("k"))
    before = t.select("path", "size", "modified_at")
    later = F.when(F.col("k") == 2, F.col("modified_at") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("modified_at"))
    after = t.filter("k <> 3").select("path", (F.col("size") + (F.col("k") == 1).cast("long")).alias("size"), later.alias("modified_at"))
    moved = files.unstable(before, after).withColumn("_u", F.lit(True))
    return before.join(moved, "path", "left").select("path", files.ignored(F.col("path"), ["*.log", "!*0.log"]).alias("ignored"), F.coalesce("_u", F.lit(False)).alias("unstable"))


@query(f"""WITH f AS (SELECT {_KINDS} AS kind, o_orderkey FROM orders)
SELECT kind AS doc_type, CASE WHEN kind IN ('unsupported', 'legacy-office') THEN 'SKIPPED' ELSE 'PENDING' END AS status, CASE kind WHEN 'email' THEN 'emails' WHEN 'archive' THEN 'emails' WHEN 'pdf' THEN 'pdfs' WHEN 'image' THEN 'images' WHEN 'office' THEN 'docx' WHEN 'text' THEN 'embed' END AS subject,
  count(*) AS documents, count(*) * 2 AS known, count(*) + count(*) FILTER (o_orderkey % 3 = 0) AS available FROM f GROUP BY kind""")
def files_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Two scans of a folder that holds every content twice, the second without some copies: contents become documents once, with one job; a complete scan tells what is gone."""
    c = _contents(spark, d).withColumn("sha256", F.sha2("content", 256))
    both = c.select(F.explode(F.array(F.lit("a/"), F.lit("b/"))).alias("folder"), "*").withColumn("relative_path", F.concat("folder", "filename"))
    docs = spark.createDataFrame([], "doc_id string, raw_sha256 string, source_filename string, doc_type string, status string, reason string, updated_at timestamp")
    jobs = spark.createDataFrame([], "job_id string, doc_id string, subject string, revision string, state string, generation long, attempts int, available_at timestamp, created_at timestamp")
    seen = spark.createDataFrame([], "root_id string, relative_path string, doc_id string, available boolean")
    for part in (both, both.filter("folder = 'a/' OR o_orderkey % 3 = 0")):
        docs, jobs, seen = (stored(x, "admitted") for x in admission.admit(docs, jobs, seen, part.select("relative_path", "filename", "content", "sha256"), root_id="r", now=NOW, complete=True))
    held = seen.groupBy("doc_id").agg(F.count("*").alias("k"), F.count_if("available").alias("a"))
    t = docs.join(jobs.select("doc_id", "subject"), "doc_id", "left").join(held, "doc_id")
    return t.groupBy("doc_type", "status", "subject").agg(F.count("*").alias("documents"), F.sum("k").alias("known"), F.sum("a").alias("available"))


# -- mailboxes and texts in pages -----------------------------------------------------------


@query("""WITH m AS (SELECT event_id AS doc_id, user_id AS box, CASE WHEN event_id % 17 <> 0 THEN ts END AS sent_at FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY sent_at DESC NULLS LAST, doc_id DESC) AS place FROM m)
SELECT doc_id, place, (place - 1) // 9 + 1 AS page, row_number() OVER (PARTITION BY box ORDER BY sent_at ASC NULLS LAST, doc_id) AS reading FROM n""")
def mailboxes_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every user's mailbox: each message's place and page, newest first, and its place in a conversation as it is read."""
    m = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").alias("box"), F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("sent_at"))
    return mailbox.numbered(m, by="box", size=9).select("doc_id", "place", "page", "reading")


@query("SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) > 1000 AS several FROM documents")
def texts_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """All texts cut into pages of at most 1,000 bytes, put together again; none where a page is longer."""
    p = mailbox.text_pages(table(spark, d, "documents"), key="doc_id", text="text", most=1000)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), "")
    t = p.groupBy("doc_id").agg(whole.alias("text"), F.max(F.octet_length("part")).alias("_most"), F.count("*").alias("_n"))
    return t.select("doc_id", F.when(F.col("_most") <= 1000, F.col("text")).alias("text"), (F.col("_n") > 1).alias("several"))


# -- evaluation, containment, changes -------------------------------------------------------


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 4 > 0 AS told, (o_orderkey % 5) / 4.0 AS recall, (o_orderkey % 3) / 2.0 AS rr, (o_orderkey % 7) / 6.0 AS ndcg FROM orders)
SELECT count(*) AS cases, count(*) FILTER (told) AS ranked, round(avg(recall) FILTER (told), 9) AS recall, round(avg(rr) FILTER (told), 9) AS mrr, round(avg(ndcg) FILTER (told), 9) AS ndcg,
  round(avg(CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 8 = 0)::INT END), 9) AS empty, avg(recall) FILTER (told) >= 0.7 AND avg(rr) FILTER (told) >= 0.5 AND avg(ndcg) FILTER (told) >= 0.5 AND avg(CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 8 = 0)::INT END) >= 1 AS passed FROM c""")
def suite_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over the cases that expect something, and whether all thresholds hold."""
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k, (k % 4).cast("double").alias("n_expected"), ((k % 5) / 4).alias("recall"), ((k % 3) / 2).alias("rr"), ((k % 7) / 6).alias("ndcg"))
    out = evaluate.summary(c, c.filter("n_expected = 0").select((k % 8 == 0).alias("passed")))
    return out.select("cases", "ranked", *[F.round(x, 9).alias(x) for x in ("recall", "mrr", "ndcg", "empty")], "passed")


@query("""SELECT o_orderkey AS case_id, min(p_partkey) AS first, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def cases_resolved(spark: SparkSession, d: str) -> DataFrame:
    """What cases expect, named by hashes of contents, as the documents with these."""
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    docs = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("doc_id"), sha("p_partkey").alias("sha"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), sha("l_partkey").alias("sha"))
    return evaluate.resolved(e, docs).groupBy("case_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS p FROM lineitem WHERE l_orderkey <> l_partkey)
SELECT count(*) AS edges, sum(c % 7 * (p % 11)) AS told, (SELECT count(*) FILTER (o_orderkey % 50 = 0 OR (o_orderkey % 60 = 7 AND o_orderkey % 2 = 1)) FROM orders) AS incomplete FROM e SEMI JOIN part ON p_partkey = p SEMI JOIN orders ON o_orderkey = c""")
def containment_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Containment derived anew from what orders hold, by hashes; originals that cannot be read, or have children and stay unparsed, make it incomplete."""
    sha = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    # An order and a part of one number are one document here, which does not hold itself.
    docs = o.select(F.col("o_orderkey").cast("long").alias("doc_id"), sha("o", "o_orderkey").alias("sha")).union(table(spark, d, "part").select(F.col("p_partkey").cast("long"), sha("p", "p_partkey")))
    found = li.select(sha("o", "l_orderkey").alias("parent_sha"), sha("p", "l_partkey").alias("child_sha"))
    k = F.col("o_orderkey")
    reads = o.select(sha("o", "o_orderkey").alias("sha"), (k % 50 != 0).alias("readable"), (k % 60 != 7).alias("parsed"), (k % 2 == 1).alias("had_children"))
    edges, state = graph.backfilled(found, docs, reads)
    told = edges.agg(F.count("*").alias("edges"), F.sum((F.col("container_id") % 7) * (F.col("contained_id") % 11)).alias("told"))
    return told.crossJoin(F.broadcast(state.select("incomplete")))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW') AS documents, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW') AS placements,
  (SELECT count(*) FROM customer) AS metadata, 0 AS wiped""")
def forgotten_and_wiped(spark: SparkSession, d: str) -> DataFrame:
    """Documents forgotten by the hash of their content in every table; a wipe leaves only the metadata."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.sha2("o_orderpriority", 256).alias("sha"))
    tables = {"documents": docs, "placements": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber"), "metadata": table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))}
    gone = store.by_hash(docs, table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select(F.sha2("o_orderpriority", 256).alias("sha")))
    left, empty = store.forgotten(tables, gone), store.wiped(tables)
    n = lambda t, name: t.agg(F.count("*").alias(name))
    # Rows of one each.
    out = n(left["documents"], "documents").crossJoin(F.broadcast(n(left["placements"], "placements"))).crossJoin(F.broadcast(n(left["metadata"], "metadata")))
    return out.crossJoin(F.broadcast(n(empty["documents"].select("doc_id").union(empty["placements"].select("doc_id")), "wiped")))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'unsupported' ELSE 'text' END AS doc_type, CASE WHEN o_orderkey % 2 = 0 THEN 'SKIPPED' ELSE 'PENDING' END AS status,
  CASE WHEN o_orderkey % 2 = 1 THEN 'embed' END AS subject FROM orders""")
def documents_rerouted(spark: SparkSession, d: str) -> DataFrame:
    """Failed documents that turn out to be of another kind: half go to another queue, half to none."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    docs = o.select(k.alias("doc_id"), F.lit("pdf").alias("doc_type"), F.lit("FAILED").alias("status"), F.lit("OCR_FAILED").alias("reason"), F.lit(NOW).alias("updated_at"))
    jobs = o.select(
        F.concat(F.lit("j"), k).alias("job_id"), k.alias("doc_id"), F.lit("pdfs").alias("subject"), F.lit("r").alias("revision"), F.lit("FAILED").alias("state"), F.lit(2).cast("long").alias("generation"),
        F.lit(3).alias("attempts"), F.lit(NOW).alias("available_at"), F.lit(NOW).alias("created_at"), F.lit(None).cast("timestamp").alias("lease_until"),
    )
    even = F.col("o_orderkey") % 2 == 0
    routes = o.select(k.alias("doc_id"), F.when(even, "unsupported").otherwise("text").alias("doc_type"), F.when(even, F.lit(None)).otherwise(F.lit("embed")).alias("subject"))
    a, b = J.rerouted(docs, jobs, routes, NOW)
    ready = b.filter("state = 'READY'").select("doc_id", "subject")
    return a.join(ready, "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "doc_type", "status", "subject")
