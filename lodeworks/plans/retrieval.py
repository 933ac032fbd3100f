"""Queries over passages, vectors and evaluation runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import chunking, text
from lodeworks.operators import ann, evaluate, ranks, retrieval
from lodeworks.operators.segments import SegmentedIndex
from lodeworks.operators.spans import SpanIndex
from lodeworks.operators.tables import shared_dir
from lodeworks.operators.terms import TermIndex
from lodeworks.plans.registry import query, table
from lodeworks.vocabulary import LEXICAL_K

WS = r"[\s\x{0B}\x{85}\p{Z}]"
NORM = rf"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"
_BM25 = f"""
q AS (SELECT item_id, unnest(list_distinct({TERMS.format("text")})) AS term FROM benchmark),
d AS (SELECT doc_id, {TERMS.format("text")} AS ts FROM documents),
s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d),
tf AS (SELECT term, doc_id, dl, count(*)::DOUBLE AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw
       FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS lex_rank FROM (SELECT item_id, doc_id, round(raw, 6) AS score FROM sc))"""
_DENSE = """
qv AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
dn AS (SELECT q, vec_id, round(greatest(0.0, 1 - list_cosine_similarity(x.embedding::DOUBLE[], e)), 9) AS distance FROM qv, embeddings x),
dr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, vec_id) AS dense_rank FROM dn)"""


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    """The best 50 documents of every benchmark item, from the index of the documents' files."""
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    return terms_of(spark, d).best(asked, LEXICAL_K, query="item_id")


def terms_of(spark: SparkSession, d: str) -> TermIndex:
    """Built as an ingest does; later searches find it until the documents' files change."""
    return TermIndex.build(table(spark, d, "documents").select("doc_id", "text"), key="doc_id", text="text")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding", F.col("label").alias("ql"))


def _dense(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    return retrieval.dense_many(table(spark, d, "embeddings"), _queries(spark, d), key="vec_id", query="q", k=k)


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, lex_rank FROM lx WHERE lex_rank <= 50")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.lexical_leg(_lexical(spark, d), key="doc_id", by="item_id")
    return out.select("item_id", "doc_id", "score", F.col("lex_rank").cast("long").alias("lex_rank"))


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, lex_rank FROM lx WHERE lex_rank <= 50")
def bm25_segmented(spark: SparkSession, d: str) -> DataFrame:
    """As ``bm25_topk``, from an index that came about by batches: a third of the documents first with another text, then all others, then the third as it is, and some that go again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    third = docs.filter("doc_id % 3 = 0")
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/lodeworks/segments-{uuid.uuid4().hex}", "doc_id")
    index.add(third.withColumn("text", F.concat(F.lit("another "), F.substr("text", F.lit(1), F.lit(200)))))
    index.add(docs.filter("doc_id % 3 <> 0").unionByName(third.select((-F.col("doc_id") - 1).alias("doc_id"), "text")))
    index.add(third)
    index.delete(third.select((-F.col("doc_id") - 1).alias("doc_id")))
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    out = retrieval.lexical_leg(index.best(asked, LEXICAL_K, query="item_id"), key="doc_id", by="item_id")
    return out.select("item_id", "doc_id", "score", F.col("lex_rank").cast("long").alias("lex_rank"))


@query(f"WITH {_DENSE} SELECT q, vec_id, round(distance, 6) AS distance, dense_rank FROM dr WHERE dense_rank <= 50")
def dense_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("q", "vec_id", F.round("distance", 6).alias("distance"), F.col("dense_rank").cast("long").alias("dense_rank"))


@query(f"""WITH {_BM25},
qv AS (SELECT b.item_id, e.embedding::DOUBLE[] AS e FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
dn AS (SELECT item_id, vec_id AS doc_id, round(greatest(0.0, 1 - list_cosine_similarity(x.embedding::DOUBLE[], e)), 9) AS distance FROM qv, embeddings x),
dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS dense_rank FROM dn),
f AS (SELECT item_id, doc_id, dense_rank, lex_rank, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0) AS rrf
      FROM (SELECT * FROM dr WHERE dense_rank <= 50) FULL JOIN (SELECT * FROM lx WHERE lex_rank <= 50) USING (item_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS fused_rank FROM f)
SELECT item_id, doc_id, dense_rank, lex_rank, round(rrf, 9) AS rrf, fused_rank,
  CASE WHEN dense_rank IS NOT NULL AND lex_rank IS NOT NULL THEN 'both' WHEN dense_rank IS NOT NULL THEN 'dense' ELSE 'lexical' END AS legs
FROM r WHERE fused_rank <= 24""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Both legs for every benchmark item, a document's vector being the one of its id, fused to 24 a question."""
    lex = retrieval.lexical_leg(_lexical(spark, d), key="doc_id", by="item_id")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = table(spark, d, "benchmark").select("item_id").join(vectors, F.col("item_id") == F.col("doc_id")).select("item_id", "embedding")
    dense = retrieval.dense_many(vectors, asked, key="doc_id", query="item_id")
    out = retrieval.fuse(dense, lex, key="doc_id", by=["item_id"])
    as_long = [F.col(c).cast("long").alias(c) for c in ("dense_rank", "lex_rank", "fused_rank")]
    return out.select("item_id", "doc_id", *as_long, F.round("rrf", 9).alias("rrf"), "legs")


@query()
def ann_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the approximate index against the exact search, by query."""
    v = table(spark, d, "embeddings")
    near = ann.Cells.build(v, key="vec_id").nearest(_queries(spark, d), query="q")
    return evaluate.overlap(_dense(spark, d), near, by="q", key="vec_id")


@query(f"""WITH {_DENSE} SELECT count(DISTINCT q) AS queries, count(*) AS neighbours, TRUE AS reached FROM dr WHERE dense_rank <= 50""")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many exact neighbours there are, and whether the approximate index finds nine of ten of them with their exact distances."""
    exact = _dense(spark, d).select("q", "vec_id", "distance")
    near = ann.Cells.build(table(spark, d, "embeddings"), key="vec_id").nearest(_queries(spark, d), query="q").select("q", "vec_id", F.col("distance").alias("found"))
    t = exact.join(near, ["q", "vec_id"], "left")
    same = F.coalesce(F.abs(F.col("found") - F.col("distance")) < 1e-6, F.lit(False))
    return t.agg(F.countDistinct("q").alias("queries"), F.count("*").alias("neighbours"), (F.count_if(same) >= 0.9 * F.count("*")).alias("reached"))


@query(f"""WITH {_DENSE},
hit AS (SELECT q, dense_rank, (x.label = ql) AS rel FROM dr JOIN embeddings x USING (vec_id) JOIN qv USING (q) WHERE dense_rank <= 10),
n AS (SELECT q, count(*) AS n FROM qv JOIN embeddings x ON x.label = ql GROUP BY q),
i AS (SELECT q, sum(1 / log2(k + 1)) AS ideal FROM (SELECT q, unnest(range(1, least(n, 10) + 1)) AS k FROM n) GROUP BY q)
SELECT q AS case_id, n AS n_expected, round(count(*) FILTER (rel) / n, 9) AS recall, round(coalesce(1.0 / min(dense_rank) FILTER (rel), 0), 9) AS rr,
  round(coalesce(sum(1 / log2(dense_rank + 1)) FILTER (rel), 0) / ideal, 9) AS ndcg FROM hit JOIN n USING (q) JOIN i USING (q) GROUP BY q, n, ideal""")
def case_scores(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and gain at 10, vectors of a query's label being what it expects."""
    q, v = _queries(spark, d), table(spark, d, "embeddings")
    runs = _dense(spark, d, 10).select(F.col("q").alias("case_id"), F.col("vec_id").alias("doc_id"), F.col("dense_rank").alias("rank"))
    expected = v.filter("label IS NOT NULL").select(F.col("label").alias("ql"), F.col("vec_id").alias("doc_id"), F.lit(1).alias("grade"))
    out = evaluate.scores(q.select(F.col("q").alias("case_id"), "ql"), runs, expected, 10, by="ql")
    return out.select("case_id", "n_expected", *[F.round(c, 9).alias(c) for c in ("recall", "rr", "ndcg")])


@query("""SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean,
  quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""")
def percentiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranks.distribution(table(spark, d, "lineitem"), "l_extendedprice", by=("l_returnflag",)).withColumn("mean", F.round("mean", 4))


@query("""SELECT event_type AS stage, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def stage_latencies(spark: SparkSession, d: str) -> DataFrame:
    """How long each stage took, events standing for timed stages."""
    out = ranks.distribution(table(spark, d, "events").withColumnRenamed("event_type", "stage"), "value", by=("stage",))
    return out.withColumn("mean", F.round("mean", 4))


@query("""SELECT l_returnflag, 0.5::DOUBLE AS p, quantile_disc(l_extendedprice, 0.5) AS value FROM lineitem GROUP BY 1 UNION ALL
SELECT NULL, 0.99::DOUBLE, quantile_disc(l_extendedprice, 0.99) FROM lineitem""")
def percentiles_narrowed(spark: SparkSession, d: str) -> DataFrame:
    """Medians of groups, and a percentile of all rows, by narrowing bounds."""
    li = table(spark, d, "lineitem")
    every = ranks.percentiles(li, "l_extendedprice", [0.99]).select(F.lit(None).cast("string").alias("l_returnflag"), "p", "value")
    return ranks.percentiles(li, "l_extendedprice", [0.5], by=["l_returnflag"]).unionByName(every)


@query("""WITH a AS (SELECT doc_id, quality = 1 AS p FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, toxic = 0 AS p FROM labels WHERE doc_id % 7 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS case_id, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' WHEN NOT a.p AND b.p THEN 'fixed'
  WHEN a.p AND NOT b.p THEN 'regressed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def run_delta(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "labels")
    before = t.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"))
    after = t.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("case_id"), (F.col("toxic") == 0).alias("passed"))
    return evaluate.compared(before, after)


@query("""WITH e AS (SELECT o_orderkey AS c, l_partkey AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
r AS (SELECT l_orderkey AS c, l_partkey AS d, bool_or(l_returnflag = 'R') AS own, bool_or(l_linestatus = 'F') AS rel FROM lineitem GROUP BY 1, 2),
x AS (SELECT DISTINCT c, d FROM e)
SELECT c AS case_id, avg(own::INT) AS delivered, avg(rel::INT) AS supplementary, avg((own OR rel)::INT) AS together FROM x JOIN r USING (c, d) GROUP BY c""")
def delivered_recall(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an order stand for expected documents, returned lines for delivered and finished lines for related ones."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("doc_id"), "l_returnflag", "l_linestatus")
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id")).join(li, "case_id").select("case_id", "doc_id")
    related = F.when(F.col("l_linestatus") == "F", F.array("doc_id")).otherwise(F.array().cast("array<bigint>"))
    runs = li.select("case_id", "doc_id", (F.col("l_returnflag") == "R").alias("own_text"), related.alias("related"))
    return evaluate.delivery(runs, expected)


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '{WS}+', ' ', 'g') AS t FROM documents),
n AS (SELECT item_id AS needle_id, {NORM} AS n FROM benchmark)
SELECT needle_id, doc_id, CAST(strpos(t, n) AS INTEGER) AS position, substr(t, greatest(1, strpos(t, n) - 240), 480) AS context FROM t, n WHERE n <> '' AND strpos(t, n) > 0""")
def corpus_span_search(spark: SparkSession, d: str) -> DataFrame:
    """From the index of the documents' files, which is built once."""
    needles = table(spark, d, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return spans_of(spark, d).find(needles)


def spans_of(spark: SparkSession, d: str) -> SpanIndex:
    return SpanIndex.build(table(spark, d, "documents").select("doc_id", "text"), key="doc_id", text="text")


@query(rf"""SELECT min(doc_id) AS doc_id, count(*) AS copies, CASE WHEN k = '' THEN '' ELSE sha256(k) END AS hash FROM (SELECT doc_id, {NORM} AS k FROM documents) GROUP BY k""")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.content_key(F.col("text")).alias("hash"))
    return t.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(rf"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, {NORM} ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def passage_dedup(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dedup_passages(table(spark, d, "documents"), model="lang", text="text", order=["doc_id"]).select("doc_id", "lang")


@query(rf"SELECT doc_id, sha256({NORM}) AS passage_hash, sha256(text) AS extraction_hash, octet_length(encode(text)) AS bytes, length(text) AS chars FROM documents")
def passage_identity(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.passage_hash(t).alias("passage_hash"), F.sha2(t, 256).alias("extraction_hash"), F.octet_length(t).cast("long").alias("bytes"), F.length(t).cast("long").alias("chars"))


@query(rf"""WITH c AS (SELECT doc_id, {NORM} AS t FROM documents), b AS (SELECT doc_id, t, octet_length(encode(t)) AS n FROM c),
k AS (SELECT doc_id, t, n, unnest(range(0, CAST(least(length(t), 240) AS BIGINT) + 1)) AS chars FROM b WHERE n > 240),
f AS (SELECT doc_id, t, max(chars) AS chars FROM k WHERE octet_length(encode(substr(t, 1, chars))) <= 240 GROUP BY ALL),
h AS (SELECT doc_id, substr(t, 1, chars) AS cut, regexp_extract(substr(t, 1, chars), '^(.*) [^ ]*$', 1) AS head FROM f)
SELECT doc_id, t AS snippet FROM b WHERE n <= 240
UNION ALL SELECT doc_id, CASE WHEN octet_length(encode(head)) > 120 THEN head ELSE cut END || '…' FROM h""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The cut between characters, and between words where that keeps more than half."""
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


#: The end of the window that begins at ``start``: all that is left, or the last break in the window's last part.
_WINDOW = """SELECT doc_id, w, lead, n, start, CASE WHEN length(w) - start <= 2048 THEN length(w) WHEN ok1 THEN start + length(b1) + 2 WHEN ok2 THEN start + length(b2) + 1
  WHEN ok3 AND length(b3) < length(x) - 1 THEN start + length(b3) + 1 WHEN ok4 THEN start + length(b4) + 1 ELSE start + length(x) END AS fin
FROM (SELECT *, regexp_matches(x, '\n\n') AND octet_length(encode(b1)) >= low AS ok1, regexp_matches(x, '\n') AND octet_length(encode(b2)) >= low AS ok2,
    regexp_matches(x, '[.!?]') AND octet_length(encode(b3)) >= low AS ok3, regexp_matches(x, ' ') AND octet_length(encode(b4)) >= low AS ok4
  FROM (SELECT *, regexp_extract(x, '(?s)^(.*)\n\n', 1) AS b1, regexp_extract(x, '(?s)^(.*)\n', 1) AS b2, regexp_extract(x, '(?s)^(.*)[.!?]', 1) AS b3, regexp_extract(x, '(?s)^(.*) ', 1) AS b4,
      floor(octet_length(encode(x)) * 0.6::DOUBLE) AS low FROM (SELECT *, substr(w, start + 1, 2048) AS x FROM ({0}))))"""


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract(text, '^{WS}*', 0) AS lead, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS w FROM documents),
c AS ({_WINDOW.format("SELECT doc_id, w, length(lead) AS lead, 0 AS n, CAST(0 AS BIGINT) AS start FROM t WHERE w <> ''")}
  UNION ALL {_WINDOW.format("SELECT doc_id, w, lead, n + 1 AS n, CASE WHEN fin - 256 > start THEN fin - 256 ELSE fin END AS start FROM c WHERE fin < length(w)")}),
p AS (SELECT doc_id, n, lead, start, substr(w, start + 1, fin - start) AS x FROM c),
q AS (SELECT doc_id, n, lead + start + length(regexp_extract(x, '^{WS}*', 0)) AS at_, regexp_replace(x, '^{WS}+|{WS}+$', '', 'g') AS passage FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i FROM q WHERE passage <> '')
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(octet_length(encode(substr(text, 1, at_))) AS INTEGER) AS start_byte,
  CAST(octet_length(encode(substr(text, 1, at_ + length(passage)))) AS INTEGER) AS end_byte, sha256(passage) AS slice_sha256 FROM r JOIN documents USING (doc_id)""")
def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    """All passages with their byte ranges and the hash of each slice."""
    out = chunking.chunk(table(spark, d, "documents"))
    return out.select("doc_id", "chunk_index", "start_byte", "end_byte", F.sha2("chunk_text", 256).alias("slice_sha256"))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS a FROM documents)
SELECT doc_id, octet_length(encode(substr(text, 1, a))) AS start_byte, substr(text, a + 1, 500) AS slice FROM w""")
def byte_slice(spark: SparkSession, d: str) -> DataFrame:
    """Every document in windows of 500 characters, each taken by its bytes."""
    t = table(spark, d, "documents").filter("text <> ''").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(500))).alias("a"))
    upto = lambda n: F.octet_length(F.substr("text", F.lit(1), n))
    t = t.select("doc_id", "text", upto(F.col("a")).alias("start_byte"), upto(F.col("a") + 500).alias("end_byte"))
    return t.select("doc_id", F.col("start_byte").cast("long").alias("start_byte"), text.byte_slice(F.col("text"), F.col("start_byte"), F.col("end_byte")).alias("slice"))


@query()
def byte_slice_whole(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of every passage's range, over the whole text of all documents."""
    docs = table(spark, d, "documents")
    c = chunking.chunk(docs).select("doc_id", "start_byte", "end_byte").join(docs.select("doc_id", "text"), "doc_id")
    return c.select("doc_id", "start_byte", "end_byte", text.byte_slice(F.col("text"), F.col("start_byte"), F.col("end_byte")).alias("slice"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_html("html").alias("text"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), ' ' || chr(9) || chr(10)) AS body FROM conversations""")
def email_compact(spark: SparkSession, d: str) -> DataFrame:
    """Replies with a quoted mail below one of five marks, compacted back to the author's own words."""
    marks = ("On Mon, 3 Feb 2025 at 10:00, Someone wrote:", "-----Original Message-----", "_" * 20, "From: Someone\nSent: Monday", "-- ")
    mark = F.element_at(F.array(*map(F.lit, marks)), (F.col("conv_id") % 5 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.compact(F.concat("text", F.lit("\n"), mark, F.lit("\n> "), F.col("text"))).alias("body"))


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '(\\.[A-Za-z0-9_+-]{1,10})$', 1)) AS ext FROM pages""".replace("\\\\", "\\"))
def extensions(spark: SparkSession, d: str) -> DataFrame:
    path = F.split_part(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    host = F.split_part(F.split_part(F.col("url"), F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, d, "pages").select("page_id", host.alias("host"), text.extension(path).alias("ext"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) / 2.0 AS density, len(regexp_extract_all(regexp_replace(text, '\p{Nd}', '', 'g'), '\p{L}{4,}')) >= 5 AS readable FROM documents")
def text_gates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.text_density(F.col("text"), F.lit(2.0)).alias("density"), text.enough_words(F.col("text")).alias("readable"))


@query("""WITH c AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 50 = 0)
SELECT p AS doc_id, CASE r WHEN 1 THEN 'parent' WHEN 2 THEN 'attachment' ELSE 'sibling' END AS relation, a AS anchor_id FROM (
  SELECT p, min(r) AS r, arg_min(a, (r, a)) AS a FROM (
    SELECT 'n' || c_nationkey AS p, 1 AS r, 'c' || c_custkey AS a FROM customer WHERE c_custkey % 50 = 0
    UNION ALL SELECT 'o' || o_orderkey, 2, 'c' || o_custkey FROM orders WHERE o_custkey % 50 = 0
    UNION ALL SELECT 'c' || y.c_custkey, 3, 'c' || x.c_custkey FROM customer x JOIN customer y USING (c_nationkey) WHERE x.c_custkey % 50 = 0 AND y.c_custkey % 50 <> 0)
  GROUP BY p) WHERE NOT (p LIKE 'o%' AND p IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P'))""")
def neighbours_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Customers are documents between their nation and their orders; the matched ones have an id divisible by 50."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    name = lambda k, x: F.concat(F.lit(k), F.col(x).cast("string"))
    edges = c.select(name("n", "c_nationkey").alias("container_id"), name("c", "c_custkey").alias("contained_id"))
    edges = edges.union(o.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    docs = c.select(name("c", "c_custkey").alias("doc_id"), F.lit("COMPLETED").alias("status")).union(o.select(name("o", "o_orderkey"), F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("COMPLETED")))
    docs = docs.union(c.select(name("n", "c_nationkey"), F.lit("COMPLETED")).distinct())
    return retrieval.neighbours(edges, docs, c.filter("c_custkey % 50 = 0").select(name("c", "c_custkey").alias("doc_id")))
