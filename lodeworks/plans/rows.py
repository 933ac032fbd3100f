"""Queries over stored rows: passages, metadata, evaluation, containment and changes."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions import metadata, text
from lodeworks.operators import evaluate, graph, mailbox, store
from lodeworks.operators import jobs as J
from lodeworks.operators.clustered import PageStore
from lodeworks.operators.merges import Bucketed, MailStore
from lodeworks.operators.tables import shared_dir
from lodeworks.plans import browse
from lodeworks.plans.operate import UPSERTED
from lodeworks.plans.registry import query, table
from lodeworks.sources import models
from lodeworks.streaming import ingest, scans


@query(r"""SELECT sha256(trim(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))) AS raw_sha256, bool_or(conv_id % 2 = 0) AS known FROM conversations GROUP BY 1""")
def embeddings_kept(spark: SparkSession, d: str) -> DataFrame:
    """Only passages without a vector are sent: those known before keep the vector they had, one longer than any that the model makes."""
    p = table(spark, d, "conversations").select("conv_id", text.passage_hash(F.col("text")).alias("raw_sha256"), F.col("text").alias("chunk_text"))
    kept = F.array(F.lit(2.0), F.lit(2.0)).cast("array<float>")
    old = p.filter("conv_id % 2 = 0").select(F.lit("m").alias("embed_model"), "raw_sha256").distinct().withColumn("embedding", kept)
    out = models.embed_new(p, old, lambda ts: models.hashed_embedding(ts, 2), name="m", dim=2)
    return out.select("raw_sha256", (F.col("embedding") == kept).alias("known"))


@query("SELECT l_orderkey, l_linenumber, l_partkey >= 8192 AND l_suppkey >= 200 AND l_quantity * 10 >= 200 AND l_suppkey * l_quantity * 10 >= 40000 AS viable FROM (SELECT *, l_partkey * 40 AS l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey * 20 AS l_suppkey, l_quantity FROM lineitem)) t(l_orderkey, l_linenumber, p, l_suppkey, l_quantity, l_partkey)")
def image_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which images are worth reading, by bytes, width and height."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.viable_image(F.col("l_partkey") * 40, F.col("l_suppkey") * 20, F.col("l_quantity") * 10).alias("viable"))


@query("""WITH h AS (SELECT o_orderkey, sha1('content' || chr(10) || o_clerk_) AS h FROM (SELECT o_orderkey, 's' || o_orderkey AS o_clerk_ FROM orders))
SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def component_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.component_id(F.lit("content"), F.concat(F.lit("s"), "o_orderkey")).alias("id"))


@query("SELECT o_orderkey, least(300.0, 60.0 * pow(2, o_orderkey % 5)) * (0.5 + (o_orderkey % 3) / 4.0) AS wait FROM orders")
def backoff_jittered(spark: SparkSession, d: str) -> DataFrame:
    """Waits between half and all of the doubling step, by a given jitter of 0, 0.5 or 1."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", text.backoff_seconds((k % 5 + 1).cast("int"), (k % 3) / 2.0).alias("wait"))


@query("""SELECT o_orderkey, 's' || (o_orderkey % 4) AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'new' WHEN o_orderkey % 3 = 0 THEN 'old' END AS note, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS left_over,
  o_orderstatus IS DISTINCT FROM nullif(o_orderstatus, 'F') AS changed, o_orderkey AS back FROM orders""")
def metadata_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys read, set, merged and cut; values that differ, null being one; references to sources and back."""
    k = F.col("o_orderkey")
    m = F.create_map(F.lit("status"), F.concat(F.lit("s"), (k % 4).cast("string")), F.lit("gone"), F.lit("x"))
    m = F.when(k % 3 == 0, metadata.put(m, "note", F.lit("old"))).otherwise(m)
    both = F.when(k % 2 == 0, metadata.merged(m, F.create_map(F.lit("note"), F.lit("new")))).otherwise(m)
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", both.alias("m"), m.alias("first"))
    ref = metadata.source_doc(metadata.source_ref(k))
    return t.select(
        "o_orderkey", metadata.get(F.col("m"), "status").alias("status"), metadata.get(F.col("m"), "note").alias("note"), F.size(metadata.without(F.col("first"), "gone")).alias("left_over"),
        metadata.changed(F.col("o_orderstatus"), F.nullif("o_orderstatus", F.lit("F"))).alias("changed"), ref.cast("long").alias("back"),
    )


@query("""WITH h AS (SELECT o_orderkey, CAST(o_orderkey % 2 AS INTEGER) a, CAST(o_orderkey % 3 AS INTEGER) b, CAST(o_orderkey % 5 AS INTEGER) c, CAST(o_orderkey % 7 AS INTEGER) e FROM orders)
SELECT o_orderkey, CASE WHEN a = 0 AND b = 0 THEN 'delivery_status' WHEN b = 1 OR c = 1 THEN 'mailing_list' WHEN c > 2 THEN 'auto_submitted' WHEN e < 4 THEN 'bulk' ELSE 'human' END AS class FROM h""")
def automation_classes(spark: SparkSession, d: str) -> DataFrame:
    """Many mixtures of telling headers: a report outranks a list, a list an automatic answer, that bulk mail."""
    k = F.col("o_orderkey")
    value = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    h = F.map_from_arrays(
        F.array(*map(F.lit, ("from", "list-id", "list-unsubscribe", "auto-submitted", "precedence"))),
        F.array(
            F.when((k % 2 == 0) & (k % 3 == 0), "MAILER-DAEMON@x.org").otherwise("A <a@x.org>"), value(3, "", "News <n.x.org>", ""), value(5, "", "<mailto:x>", "", "", ""),
            value(5, "no", "no", "No", "auto-replied", "auto-generated"), value(7, "bulk", "list", "JUNK", "auto_reply", "", "normal", "first-class"),
        ),
    )
    return table(spark, d, "orders").select("o_orderkey", text.automation_class(h).alias("class"))


@query("""WITH p AS (SELECT * FROM (VALUES (1, 3, '1-URGENT'), (2, 5, '5-LOW'), (3, 3, '5-LOW')) t(nth, k, prio))
SELECT nth, o_orderkey FROM orders JOIN p ON o_custkey % 7 = k AND o_orderpriority = prio WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 3 NOT IN (0, 2)""")
def parameter_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parameters as rows, a set that asks for some, an empty one that asks for all, and one that excludes."""
    p = mailbox.asked(spark, "k long, prio string", [3, 5, 3], ["1-URGENT", "5-LOW", "5-LOW"])
    o = table(spark, d, "orders").filter(mailbox.optional(F.col("o_orderstatus"), ("F", "O")) & mailbox.optional(F.col("o_clerk") if "o_clerk" in table(spark, d, "orders").columns else F.lit(""), ()) & mailbox.excluded(F.col("o_orderkey") % 3, (0, 2)))
    return o.join(F.broadcast(p), (F.col("o_custkey") % 7 == F.col("k")) & (F.col("o_orderpriority") == F.col("prio"))).select("nth", "o_orderkey")


@query("SELECT o_custkey AS doc_id, min(o_orderpriority) AS path FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def first_paths(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("path"), (F.col("o_orderstatus") != "P").alias("available"))
    return mailbox.display_paths(o)


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS e, o_orderkey % 3 = 0 AS a, o_orderkey % 4 AS p, o_orderkey % 5 + 1 AS n, (o_orderkey % 3) / 2.0 AS r, (o_orderkey % 2) * ((o_orderkey % 3) / 2.0) AS dl FROM orders),
f AS (SELECT id, list_filter([CASE WHEN e AND p > 0 THEN 'expected nothing, got ' || p || ' packets' END, CASE WHEN NOT e AND a AND r < 1 THEN 'found ' || CAST(round(r * n) AS BIGINT) || ' of ' || n || ' expected documents' END,
  CASE WHEN NOT e AND NOT a AND r = 0 THEN 'found no expected document' END, CASE WHEN NOT e AND r > 0 AND dl = 0 THEN 'found an expected document without its text' END], lambda x: x IS NOT NULL) AS f FROM c)
SELECT id AS case_id, len(f) = 0 AS passed, array_to_string(f, '; ') AS failures FROM f""")
def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(
        k.alias("case_id"), (k % 7 == 0).alias("expected_empty"), (k % 3 == 0).alias("require_all"), (k % 4).alias("packets"), (k % 5 + 1).alias("n_expected"), ((k % 3) / 2).alias("recall"), ((k % 2) * ((k % 3) / 2)).alias("delivered"),
    )
    return evaluate.verdicts(t).select("case_id", "passed", F.array_join("failures", "; ").alias("failures"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS p FROM lineitem WHERE l_quantity > 25), r AS (SELECT l_orderkey AS id, l_partkey AS p, l_linenumber AS k, l_returnflag = 'R' AS own FROM lineitem),
h AS (SELECT id, min(k) AS fe, min(k) FILTER (own) AS fd FROM r SEMI JOIN e USING (id, p) GROUP BY id)
SELECT o_orderkey AS case_id, CAST(coalesce(fe, 0) AS BIGINT) AS first_expected, CAST(coalesce(fd, 0) AS BIGINT) AS first_delivered,
  CASE WHEN fd IS NOT NULL THEN 1.0 / fd WHEN o_orderkey IN (SELECT id FROM e) THEN 0.0 ELSE 1.0 END AS rr_delivered FROM orders LEFT JOIN h ON id = o_orderkey""")
def first_ranks(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("own_text"), "l_quantity")
    return evaluate.delivered_ranks(table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id")), li, li.filter("l_quantity > 25"))


@query("""WITH g AS (SELECT l_orderkey AS id, l_partkey AS p, max(l_linenumber % 4) AS g, min(l_linenumber) AS k FROM lineitem GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, p) AS place, row_number() OVER (PARTITION BY id ORDER BY g DESC, p) AS i FROM g),
s AS (SELECT id, sum(CASE WHEN place <= 3 THEN (pow(2, g) - 1) / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 3 THEN (pow(2, g) - 1) / log2(i + 1) ELSE 0 END) AS ideal, count(*) AS n, count(*) FILTER (place <= 3) AS hit FROM x GROUP BY id)
SELECT id AS case_id, n AS n_expected, round(hit / n, 9) AS recall, 1.0 AS rr, round(CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END, 9) AS ndcg FROM s""")
def graded_gain(spark: SparkSession, d: str) -> DataFrame:
    """Gain with grades 0 to 3 at 3, the parts of an order being expected and found in order of their lines."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("rank"), (F.col("l_linenumber") % 4).cast("int").alias("grade"))
    out = evaluate.scores(li.select("case_id").distinct(), li, li, 3)
    return out.select("case_id", "n_expected", *[F.round(c, 9).alias(c) for c in ("recall", "rr", "ndcg")])


@query(r"""WITH k AS (SELECT conv_id, turn, text, sha256(trim(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))) AS h FROM conversations)
SELECT h AS raw_sha256, count(*) AS placed, count(DISTINCT conv_id) AS docs FROM k WHERE conv_id % 3 <> 0 GROUP BY h""")
def passages_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Every third conversation was cut before and is now without passages of its own: shared ones stay, placed by the others."""
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("chunk_text"), F.lit(0).alias("start_byte"), F.octet_length("text").alias("end_byte"))
    chunks, placements = store.replace_chunks(
        spark.createDataFrame([], "chunk_id string, embed_model string, raw_sha256 string, chunk_text string"),
        spark.createDataFrame([], "placement_id string, doc_id long, chunk_id string, chunk_index int, start_byte int, end_byte int, slice_sha256 string"), p.filter("doc_id % 2 = 0"), "m",
    )
    chunks, placements = store.replace_chunks(chunks, placements, p, "m")
    docs = p.select("doc_id").distinct().withColumn("parent_doc_id", F.lit(None).cast("long"))
    none = spark.createDataFrame([], "container_id long, contained_id long, first_seen_at timestamp")
    _, _, left, kept = store.delete_documents(docs, none, placements, chunks, docs.filter("doc_id % 3 = 0").select("doc_id"))
    return left.join(kept, "chunk_id").groupBy("raw_sha256").agg(F.count("*").alias("placed"), F.count_distinct("doc_id").alias("docs"))


@query("""WITH e AS (SELECT l_orderkey AS c, l_partkey AS p, min(l_shipdate) AS t FROM lineitem GROUP BY ALL),
first AS (SELECT p, arg_min(c, (t, c)) AS c FROM e GROUP BY p), rest AS (SELECT p, arg_min(c, (t, c)) AS c FROM e WHERE c % 3 <> 0 GROUP BY p)
SELECT first.p AS doc_id, CASE WHEN first.c % 3 = 0 THEN rest.c ELSE first.c END AS parent_doc_id FROM first LEFT JOIN rest USING (p)""")
def documents_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose first order is deleted get the earliest that remains."""
    li = table(spark, d, "lineitem")
    edges = store.link(li.select(F.lit(-1).alias("container_id"), F.lit(-1).alias("contained_id"), F.col("l_shipdate").alias("first_seen_at")).limit(0), li.select((F.col("l_orderkey") + 10**9).alias("container_id"), F.col("l_partkey").alias("contained_id"), F.col("l_shipdate").alias("first_seen_at")))
    docs = graph.survivors_parent(edges, spark.createDataFrame([], "doc_id long")).select(F.col("contained_id").alias("doc_id"), F.col("container_id").alias("parent_doc_id"))
    gone = edges.select(F.col("container_id").alias("doc_id")).filter(f"(doc_id - {10**9}) % 3 = 0").distinct()
    none = spark.createDataFrame([], "placement_id string, doc_id long, chunk_id string")
    out, _, _, _ = store.delete_documents(docs, edges, none, none.select("chunk_id"), gone)
    return out.select("doc_id", (F.col("parent_doc_id") - 10**9).alias("parent_doc_id"))


@query("""SELECT o_orderkey AS doc_id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey % 2 = 0 AND o_orderkey % 5 <> 0""")
def resumable_documents(spark: SparkSession, d: str) -> DataFrame:
    """Unfinished orders below customers that the scan found, without a job."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    occ = c.select(F.concat(F.lit("c"), "c_custkey").alias("doc_id"), F.lit("s1").alias("scan_id"), (F.col("c_custkey") % 2 == 0).alias("available"))
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    docs = o.select(F.concat(F.lit("o"), "o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "PENDING").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("COMPLETED").alias("status"), "o_orderkey", "o_orderstatus")
    jobs = o.filter("o_orderkey % 5 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("doc_id"))
    got = graph.resumable(occ, edges, docs, jobs, "s1")
    return got.join(docs.select("doc_id", "o_orderkey", "o_orderstatus"), "doc_id").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_custkey % 3 <> 0) AS unreached, count(DISTINCT l_orderkey) FILTER (l_orderkey % 4 = 0) AS roots, count(DISTINCT l_partkey) FILTER (l_orderkey % 4 = 0) AS contained FROM lineitem""")
def containment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no available customer leads to, and how a deletion plan splits into documents alone and inside others."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    occ = o.select(name("c", "o_custkey").alias("doc_id"), (F.col("o_custkey") % 3 == 0).alias("available")).distinct()
    members = o.select(name("c", "o_custkey").alias("parent_id"), name("o", "o_orderkey").alias("child_id"))
    lost = graph.unreached(occ, members, o.select(name("o", "o_orderkey").alias("doc_id"))).withColumnRenamed("n", "unreached")
    own = li.filter("l_orderkey % 4 = 0")
    edges = own.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"))
    plan = graph.split_plan(edges.select(F.col("src").alias("doc_id")).union(edges.select("dst")), edges)
    return lost.crossJoin(F.broadcast(plan))


@query("""SELECT o_custkey AS doc_id, string_agg(o_orderkey || ':' || (o_orderkey % 3), ' ' ORDER BY o_orderkey) AS open FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def open_work(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "READY").otherwise("RUNNING").alias("state"), (F.col("o_orderkey") % 3).alias("generation"))
    shown = lambda x: F.concat_ws(":", x["job_id"].cast("string"), x["generation"].cast("string"))
    return J.open_jobs(j).select("doc_id", F.array_join(F.transform("open", shown), " ").alias("open"))


@query("""WITH f AS (SELECT o_custkey AS doc_id, string_agg(DISTINCT o_orderpriority, ' ' ORDER BY o_orderpriority) AS files FROM orders GROUP BY 1),
r AS (SELECT s_nationkey AS doc_id, string_agg(DISTINCT 'r' || n_regionkey || '/' || s_suppkey % 3, ' ' ORDER BY 'r' || n_regionkey || '/' || s_suppkey % 3) AS routes FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey AS doc_id, coalesce(files, '') AS files, coalesce(routes, '') AS routes FROM customer LEFT JOIN f ON f.doc_id = c_custkey LEFT JOIN r ON r.doc_id = c_custkey""")
def source_records(spark: SparkSession, d: str) -> DataFrame:
    """Each document's own files and the members that lead to it."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    members = s.select(F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), (F.col("s_suppkey") % 3).cast("string").alias("selector"), F.col("s_nationkey").cast("long").alias("child_id"))
    occ = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("path"))
    out = store.source_records(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")), occ, members)
    return out.select("doc_id", F.array_join("files", " ").alias("files"), F.array_join(F.transform("routes", lambda x: F.concat_ws("/", x["parent_id"], x["selector"])), " ").alias("routes"))


# -- stored tables that change ------------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"


@query(UPSERTED)
def routes_merged(spark: SparkSession, d: str) -> DataFrame:
    """Member routes merged over those stored before, in buckets; when a route was first seen stays."""
    t = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("root_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("first_seen"))
    held = Bucketed(_fresh(spark, "routes"), t.schema, ("root_id", "path"), 16)
    # The last of a key by moment and document, also within a batch.
    held.merge(t.filter("doc_id % 3 = 0"), order=["first_seen", "doc_id"])
    new = store.last_writer(t.filter("doc_id % 3 = 1 AND root_id < 30"), ["root_id", "path"], ["first_seen", "doc_id"])
    held.merge(new.withColumn("first_seen", F.lit(None).cast(t.schema["first_seen"].dataType)), keep=["first_seen"])
    return held.read(spark)


@query(f"""WITH {browse.M}, {browse.A}, a1 AS (SELECT doc_id, count(*) AS boxes, count(*) FILTER (kind <> 'from') AS given FROM a GROUP BY 1)
SELECT m.doc_id, CASE WHEN m.doc_id % 4 = 1 THEN subject || ' again' ELSE subject END AS subject, ingested_at, CASE WHEN m.doc_id % 4 = 1 THEN given ELSE boxes END AS addresses, CASE WHEN m.doc_id % 4 = 1 THEN 1 ELSE 2 END AS refs
FROM m JOIN a1 USING (doc_id)""")
def mail_saved(spark: SparkSession, d: str) -> DataFrame:
    """Mail stored, and every fourth message stored again a month later with another subject, without its sender and with fewer references: the moment of its first coming stays."""
    boxes = browse.addresses(spark, d).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "ordinal", "address", F.lit("").alias("display_name"), "valid")).alias("addresses"))
    refs = F.array(F.lit("r1@x.org"), F.concat(F.lit("r"), F.col("doc_id"), F.lit("@x.org")))
    first = browse.messages(spark, d).join(boxes, "doc_id").withColumns({"references": refs, "automated_class": F.lit("human"), "list_id": F.lit("")})
    again = first.filter("doc_id % 4 = 1").withColumns({"subject": F.concat("subject", F.lit(" again")), "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 30 DAYS"), "addresses": F.filter("addresses", lambda x: x["kind"] != "from"), "references": F.slice("references", 1, 1)})
    mail = MailStore.at(_fresh(spark, "mail"), 16)
    mail.save(first)
    mail.save(again)
    n = lambda t, name: t.read(spark).groupBy("doc_id").agg(F.count("*").alias(name))
    return mail.messages.read(spark).select("doc_id", "subject", "ingested_at").join(n(mail.addresses, "addresses"), "doc_id").join(n(mail.references, "refs"), "doc_id")


@query(f"""WITH {browse.M}, k AS (SELECT sent_at AS t, doc_id AS i FROM m WHERE sent_at <= TIMESTAMP '2024-01-10' ORDER BY sent_at DESC, doc_id DESC LIMIT 1)
SELECT doc_id, sent_at FROM m, k WHERE (sent_at < t OR sent_at IS NULL OR (sent_at = t AND doc_id < i)) AND subject = 'click' ORDER BY sent_at DESC NULLS LAST, doc_id DESC LIMIT 26""")
def keyset_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The page after a boundary, of one subject's messages, from files in page order."""
    m = browse.messages(spark, d)
    pages = PageStore.build(m.select("doc_id", "sent_at", "subject"), rows=5000)
    k = m.filter(F.col("sent_at") <= F.lit(datetime(2024, 1, 10))).orderBy(*mailbox.page_order()).first()
    return pages.frame(after=(k["sent_at"], k["doc_id"]), where=lambda t: t.filter("subject = 'click'")).select("doc_id", "sent_at")


@query("""SELECT event_type AS root_id, 'u' || user_id AS relative_path, arg_max('d' || event_id, (ts, 'd' || event_id)) AS doc_id, max(ts) AS seen_at, max(ts) + INTERVAL 2 DAY > (SELECT max(ts) FROM events) AS available FROM events GROUP BY event_type, user_id""")
def scan_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as observations of files, taken as a stream: each file's last, and whether it is still there two days later."""
    e, at = table(spark, d, "events"), _fresh(spark, "scans")
    folder, _, name = f"{d}/events.parquet".rpartition("/")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", name).parquet(folder)
    seen = stream.select(F.col("event_type").alias("root_id"), F.concat(F.lit("u"), "user_id").alias("relative_path"), F.concat(F.lit("d"), "event_id").alias("doc_id"), F.col("ts").alias("seen_at"))
    run = scans.changes(seen, grace=timedelta(days=2)).writeStream.outputMode("update").foreachBatch(ingest.by_batch(f"{at}/out"))
    run.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(T.StructType.fromDDL(f"{scans.CHANGE}, batch int")).parquet(f"{at}/out")
    return scans.settled(told.drop("batch")).withColumn("seen_at", F.col("seen_at").cast(e.schema["ts"].dataType))
