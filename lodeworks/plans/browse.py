"""Queries over messages, containment and lookups; the tables stand in for mail and containers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import text
from lodeworks.operators import graph, mailbox, store
from lodeworks.plans.registry import query, table

#: Events as messages: every 17th is undated; ids repeat.
M = """m AS (SELECT event_id AS doc_id, CASE WHEN event_id % 17 <> 0 THEN ts END AS sent_at, ts AS ingested_at,
  'm' || (event_id % 900) || '@d' || (user_id % 7) || '.example.com' AS message_id, event_type AS subject, user_id FROM events)"""
A = """a AS (SELECT event_id AS doc_id, 'from' AS kind, 0 AS ordinal, 'u' || user_id || '@d' || (user_id % 7) || '.example.com' AS address, event_id % 31 <> 0 AS valid FROM events
  UNION ALL SELECT event_id, 'to', 0, 'u' || (event_id % 150) || '@d' || (event_id % 150 % 7) || '.example.com', TRUE FROM events
  UNION ALL SELECT event_id, 'cc', n, 'u' || ((event_id + n) % 150) || '@d' || ((event_id + n) % 150 % 7) || '.example.com', TRUE FROM events, unnest(range(CAST(event_id % 4 AS BIGINT))) t(n))"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    mid = F.concat(F.lit("m"), F.col("event_id") % 900, F.lit("@d"), F.col("user_id") % 7, F.lit(".example.com"))
    return e.select(
        F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 17 != 0, F.col("ts")).alias("sent_at"), F.col("ts").alias("ingested_at"),
        mid.alias("message_id"), F.col("event_type").alias("subject"), "user_id",
    )


def addresses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    box = lambda u: F.concat(F.lit("u"), u, F.lit("@d"), u % 7, F.lit(".example.com"))
    row = lambda kind, n, u, ok: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("ordinal"), box(u).alias("address"), ok.alias("valid"))
    one = F.array(row("from", F.lit(0), F.col("user_id"), F.col("event_id") % 31 != 0), row("to", F.lit(0), F.col("event_id") % 150, F.lit(True)))
    copied = F.when(F.col("event_id") % 4 > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 4 - 1), lambda n: row("cc", n, (F.col("event_id") + n) % 150, F.lit(True))))
    every = F.concat(one, F.coalesce(copied, F.slice(one, 1, 0)))
    return e.select(F.col("event_id").alias("doc_id"), F.explode(every).alias("x")).select("doc_id", "x.*")


@query(f"WITH {M} SELECT doc_id, sent_at FROM m ORDER BY sent_at DESC NULLS LAST, doc_id DESC LIMIT 26")
def keyset_newest(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.page(messages(spark, d)).select("doc_id", "sent_at")


@query(f"WITH {M} SELECT doc_id, sent_at FROM m ORDER BY sent_at ASC NULLS FIRST, doc_id ASC LIMIT 26")
def keyset_oldest(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.page(messages(spark, d), newest=False).select("doc_id", "sent_at")


@query(f"""WITH {M}, k AS (SELECT sent_at AS t, doc_id AS i FROM m WHERE sent_at <= TIMESTAMP '2024-01-10' ORDER BY sent_at DESC, doc_id DESC LIMIT 1)
SELECT doc_id, sent_at FROM m, k WHERE sent_at < t OR sent_at IS NULL OR (sent_at = t AND doc_id < i) ORDER BY sent_at DESC NULLS LAST, doc_id DESC LIMIT 26""")
def keyset_page2(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    k = m.filter(F.col("sent_at") <= F.lit(datetime(2024, 1, 10))).orderBy(*mailbox.page_order()).first()
    return mailbox.page(m, after=(k["sent_at"], k["doc_id"])).select("doc_id", "sent_at")


@query(f"WITH {M} SELECT doc_id, sent_at FROM m WHERE sent_at IS NULL AND doc_id < 170 ORDER BY doc_id DESC LIMIT 26")
def keyset_undated(spark: SparkSession, d: str) -> DataFrame:
    """The page after an undated message: undated ones only."""
    return mailbox.page(messages(spark, d), after=(None, 170)).select("doc_id", "sent_at")


@query(f"WITH {M} SELECT doc_id, sent_at FROM m WHERE sent_at >= TIMESTAMP '2024-01-05' AND sent_at < TIMESTAMP '2024-01-06'")
def half_open_window(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.window(messages(spark, d), datetime(2024, 1, 5), datetime(2024, 1, 6)).select("doc_id", "sent_at")


@query(f"WITH {M} SELECT doc_id FROM m WHERE ingested_at <= TIMESTAMP '2024-01-12 12:00:00'")
def snapshot_bound(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.as_of(messages(spark, d), datetime(2024, 1, 12, 12)).select("doc_id")


@query(f"WITH {A} SELECT DISTINCT doc_id FROM a WHERE valid AND kind = 'from' AND address = 'u7@d0.example.com'")
def semi_sender(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.from_sender(messages(spark, d), addresses(spark, d), "u7@d0.example.com").select("doc_id")


@query(f"WITH {A} SELECT DISTINCT doc_id FROM a WHERE valid AND kind IN ('to', 'cc', 'bcc') AND address = 'u7@d0.example.com'")
def semi_recipient(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.to_recipient(messages(spark, d), addresses(spark, d), "u7@d0.example.com").select("doc_id")


@query(f"WITH {A} SELECT DISTINCT doc_id FROM a WHERE valid AND kind = 'from' AND split_part(address, '@', -1) = 'd3.example.com'")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.from_domain(messages(spark, d), addresses(spark, d), "d3.example.com").select("doc_id")


_OWN = "('u7@d0.example.com', 'u8@d1.example.com', 'u9@d2.example.com')"


def _owners(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("u7@d0.example.com",), ("u8@d1.example.com",), ("u9@d2.example.com",)], "address string")


@query(f"""WITH {A} SELECT DISTINCT doc_id FROM a WHERE valid AND kind <> 'from' AND address IN {_OWN}
  AND doc_id NOT IN (SELECT doc_id FROM a WHERE valid AND kind = 'from' AND address IN {_OWN})""")
def anti_inbound(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.direction(messages(spark, d), addresses(spark, d), _owners(spark), "inbound").select("doc_id")


@query(f"WITH {A} SELECT DISTINCT doc_id FROM a WHERE valid AND kind = 'from' AND address IN {_OWN}")
def outbound(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.direction(messages(spark, d), addresses(spark, d), _owners(spark), "outbound").select("doc_id")


@query(f"WITH {M} SELECT message_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1")
def shared_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return mailbox.shared_identifiers(messages(spark, d))


@query(f"""WITH {A}, r AS (SELECT doc_id, address, CASE kind WHEN 'to' THEN 0 WHEN 'cc' THEN 1 ELSE 2 END AS k, ordinal FROM a WHERE valid AND kind IN ('to', 'cc', 'bcc')),
f AS (SELECT doc_id, address, min((k, ordinal)) AS o FROM r GROUP BY ALL)
SELECT doc_id, array_to_string(list(address ORDER BY o)[1:2], ',') AS recipients, CAST(greatest(count(*) - 2, 0) AS INTEGER) AS omitted FROM f GROUP BY 1""")
def recipients_ordered(spark: SparkSession, d: str) -> DataFrame:
    out = mailbox.recipients(addresses(spark, d), cap=2)
    return out.select("doc_id", F.array_join("recipients", ",").alias("recipients"), "omitted")


@query(f"""WITH {M}, {A}, f AS (SELECT doc_id FROM a WHERE valid AND kind = 'from' AND split_part(address, '@', -1) = 'd3.example.com')
SELECT doc_id, sent_at, subject FROM m SEMI JOIN f USING (doc_id) WHERE sent_at >= TIMESTAMP '2024-01-03' ORDER BY sent_at DESC NULLS LAST, doc_id DESC LIMIT 26""")
def browse_composed(spark: SparkSession, d: str) -> DataFrame:
    m = mailbox.from_domain(messages(spark, d), addresses(spark, d), "d3.example.com")
    return mailbox.page(mailbox.window(m, datetime(2024, 1, 3))).select("doc_id", "sent_at", "subject")


@query("""SELECT conv_id, string_agg(role || ':' || length(text), '>' ORDER BY turn) AS thread, count(*) AS n FROM conversations GROUP BY 1""")
def threads(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns in order."""
    part = F.concat_ws(":", "role", F.length("text"))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))).alias("x"), F.count("*").alias("n"))
    return t.select("conv_id", F.array_join(F.transform("x", lambda x: x["p"]), ">").alias("thread"), "n")


@query("""SELECT o_orderkey AS doc_id, o_orderdate AS email_date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-02' AND o_orderdate < TIMESTAMP '1996-01-03'
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 21""")
def find_by_subject_day(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("email_subject"), F.col("o_orderdate").alias("email_date"))
    return mailbox.find_documents(o, subject="1-URGENT", day=datetime(1996, 1, 2)).select("doc_id", "email_date")


# -- containment: orders hold line items' parts, which other orders hold too ------------


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey"), F.col("l_partkey"))
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    n, c, o = (table(spark, d, x) for x in ("nation", "customer", "orders"))
    pair = lambda t, a, x, b, y: t.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return pair(n, "r", "n_regionkey", "n", "n_nationkey").union(pair(c, "n", "c_nationkey", "c", "c_custkey")).union(pair(o, "c", "o_custkey", "o", "o_orderkey"))


_TREE = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""
_HELD = "e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


@query(f"""WITH RECURSIVE {_HELD}, d AS (SELECT src AS n FROM e UNION SELECT dst FROM e),
r AS (SELECT n FROM d WHERE n LIKE 'o%' AND CAST(substr(n, 2) AS BIGINT) % 4 = 0 UNION SELECT dst FROM r JOIN e ON src = n) SELECT n AS doc_id FROM d WHERE n NOT IN (SELECT n FROM r)""")
def unreachable(spark: SparkSession, d: str) -> DataFrame:
    """What no longer has a holder when only every fourth order is staged; shared parts stay."""
    e = _edges(spark, d)
    docs = e.select(F.col("src").alias("doc_id")).union(e.select("dst")).distinct().withColumn("sha", F.col("doc_id"))
    staged = docs.filter(F.startswith("doc_id", F.lit("o")) & (F.substr("doc_id", F.lit(2)).cast("long") % 4 == 0)).select("sha")
    return graph.unreachable(docs, e, staged).select("doc_id")


@query(f"""WITH RECURSIVE {_TREE}, r AS (SELECT 'n3' AS n UNION SELECT dst FROM r JOIN e ON src = n WHERE dst NOT LIKE 'c%5') SELECT n AS node FROM r""")
def closure_retained(spark: SparkSession, d: str) -> DataFrame:
    """All below one nation, passing over customers whose id ends in 5 with what they hold."""
    e = _tree(spark, d)
    stop = e.select(F.col("dst").alias("node")).filter(F.rlike("node", F.lit("^c.*5$")))
    return graph.closure(spark.createDataFrame([("n3",)], "node string"), e, stop=stop)


@query(f"""WITH RECURSIVE {_TREE}, g AS (SELECT * FROM e WHERE NOT (src LIKE 'n%' AND CAST(substr(dst, 2) AS BIGINT) % 4 = 1)
  UNION SELECT 'n3', 'c' || c_custkey FROM customer WHERE c_custkey % 16 = 1 UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber > 1),
r AS (SELECT unnest(['n3', 'n7', 'r2']) AS n UNION SELECT dst FROM r JOIN g ON src = n) SELECT n AS node FROM r""")
def closure_changed(spark: SparkSession, d: str) -> DataFrame:
    """What regions, nations, customers, orders and parts hold, kept while every fourth customer moves away, some to another nation, first lines go and sources change."""
    tree, lines = _tree(spark, d), table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_linenumber")
    one = lambda *names: spark.createDataFrame([(x,) for x in names], "node string")
    held = graph.HeldClosure.of(one("r1", "n3", "r2"), tree.union(lines.select("src", "dst")))
    moved = tree.filter(F.startswith("src", F.lit("n")) & (F.substr("dst", F.lit(2)).cast("long") % 4 == 1))
    to = table(spark, d, "customer").filter("c_custkey % 16 = 1").select(F.lit("n3").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    gone = lines.filter("l_linenumber = 1").select("src", "dst").join(lines.filter("l_linenumber > 1").select("src", "dst"), ["src", "dst"], "left_anti")
    return held.changed(added=to, removed=moved.union(gone), seeded=one("n7"), unseeded=one("r1")).reached


@query("""SELECT event_id AS node FROM (SELECT event_id, max(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS told FROM events) WHERE told = 1""")
def chains_reached(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as one chain of replies: what follows an event whose id is divisible by 50."""
    e = table(spark, d, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(before.alias("src"), F.col("event_id").alias("dst")).filter("src IS NOT NULL")
    return graph.closure(e.filter("event_id % 50 = 0").select(F.col("event_id").alias("node")), edges)


@query(f"""WITH RECURSIVE {_HELD}, b AS (SELECT 'o1' AS n UNION SELECT dst FROM b JOIN e ON src = n),
k AS (SELECT src AS n FROM e WHERE src <> 'o1' UNION SELECT dst FROM k JOIN e ON src = n) SELECT n AS doc_id FROM b WHERE n NOT IN (SELECT n FROM k)""")
def forget_plan(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    docs = e.select(F.col("src").alias("doc_id")).union(e.select("dst")).distinct().withColumn("source_path", F.lit(""))
    return graph.forget_plan(docs, e, spark.createDataFrame([("o1",)], "doc_id string"))


@query(f"""WITH RECURSIVE {_TREE}, r AS (SELECT src AS root, src AS n FROM e WHERE src LIKE 'n%' OR src LIKE 'r%' UNION SELECT root, dst FROM r JOIN e ON src = n)
SELECT root, count(*) - 1 AS descendants FROM r GROUP BY root""")
def subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = _tree(spark, d)
    return graph.subtree_sizes(e.filter(F.rlike("src", F.lit("^[nr]"))).select(F.col("src").alias("node")).distinct(), e)


@query(f"""WITH RECURSIVE {_TREE}, u AS (SELECT dst AS origin, dst AS node, CAST([] AS VARCHAR[]) AS sel FROM e WHERE dst LIKE 'o%'
  UNION ALL SELECT origin, src, list_prepend('s:' || node, sel) FROM u JOIN e ON dst = node)
SELECT origin AS doc_id, node AS path, array_to_string(sel, '/') AS selectors, row_number() OVER (PARTITION BY origin ORDER BY len(sel), node) AS nth FROM u WHERE node LIKE 'r%' OR node LIKE 'n%'""")
def routes_to_files(spark: SparkSession, d: str) -> DataFrame:
    """Routes from all orders up to the nations and regions that stand for source files."""
    e = _tree(spark, d)
    members = e.select(F.col("src").alias("parent_id"), F.concat(F.lit("s:"), "dst").alias("selector"), F.col("dst").alias("child_id"))
    files = e.select(F.col("src").alias("doc_id")).filter(F.rlike("src", F.lit("^[nr]"))).distinct().select("doc_id", F.col("doc_id").alias("path"), F.lit(True).alias("available"))
    ids = e.filter(F.startswith("dst", F.lit("o"))).select(F.col("dst").alias("doc_id"))
    out = graph.routes(ids, members, files)
    return out.select("doc_id", "path", F.array_join("selectors", "/").alias("selectors"), F.col("nth").cast("long").alias("nth"))


@query("""SELECT contained_id, container_id, path FROM (SELECT l_partkey AS contained_id, l_orderkey AS container_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS path,
  row_number() OVER (PARTITION BY l_partkey ORDER BY (o_orderstatus = 'P'), (l_linenumber = 1) DESC, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, l_orderkey) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE n = 1""")
def lateral_top1_container(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("container_id"), F.col("l_partkey").alias("contained_id"), "l_linenumber")
    boxes = table(spark, d, "orders").select(F.col("o_orderkey").alias("container_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("path"))
    return graph.first_container(edges, boxes, F.col("l_linenumber") == 1)


@query("""SELECT contained_id, arg_min(container_id, (t, container_id)) AS container_id FROM (
  SELECT l_partkey AS contained_id, l_orderkey AS container_id, l_shipdate AS t FROM lineitem WHERE l_orderkey % 3 <> 0) GROUP BY 1""")
def survivors_parent(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("contained_id"), F.col("l_orderkey").alias("container_id"), F.col("l_shipdate").alias("first_seen_at"))
    gone = li.filter("container_id % 3 = 0").select(F.col("container_id").alias("doc_id")).distinct()
    return graph.survivors_parent(li, gone)


@query("""SELECT DISTINCT p_partkey FROM part ANTI JOIN (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 16 = 0) USING (p_partkey)""")
def orphan_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no placement carries any more."""
    held = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_orderkey % 16 = 0").select(F.col("l_partkey").alias("p_partkey"))
    return store.orphans(table(spark, d, "part").select("p_partkey"), held, "p_partkey")


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN c_mktsegment <> 'BUILDING' THEN 'o' || o_orderkey || ' in ' || c_mktsegment ELSE 'o' || o_orderkey || ' in ' || c_name END AS location,
  coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END, ''), 'o' || o_orderkey) AS title FROM orders JOIN customer ON c_custkey = o_custkey""")
def display_locations(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    name = F.concat(F.lit("o"), "o_orderkey")
    own = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    path = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    subject = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority"))
    return t.select(F.col("o_orderkey").alias("doc_id"), text.location(own, name, path, F.col("c_name")).alias("location"), text.title(subject, name).alias("title"))
