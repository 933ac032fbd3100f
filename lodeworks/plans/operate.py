"""Queries over the work queue, scans, health and recovery; orders stand for documents and jobs."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import text
from lodeworks.operators import jobs as J
from lodeworks.operators import store
from lodeworks.operators.tables import shared_dir
from lodeworks.plans.registry import ORACLES, query, table
from lodeworks.streaming import ingest
from lodeworks.vocabulary import DECLINE_REASONS, RETRYABLE_REASONS, TERMINAL_REASONS

NOW = datetime(1998, 6, 1)
_NOW = "TIMESTAMP '1998-06-01'"
REASONS = ("EXTRACTION_FAILED", "PDF_ENCRYPTED", "STORE_REJECTED", "UNCLASSIFIED", "OCR_FAILED")
_REASON = "['EXTRACTION_FAILED', 'PDF_ENCRYPTED', 'STORE_REJECTED', 'UNCLASSIFIED', 'OCR_FAILED'][k % 5 + 1]"
#: Orders as jobs of customers; their dates set when they are due and when leases end.
JOBS = f"""j AS (SELECT o_orderkey AS job_id, o_custkey AS doc_id, o_orderpriority AS subject, 'r' || (o_orderkey % 3) AS revision,
  CASE WHEN o_orderkey % 10 < 4 THEN 'READY' WHEN o_orderkey % 10 < 6 THEN 'RUNNING' WHEN o_orderkey % 10 = 6 THEN 'WAITING_SOURCE' WHEN o_orderkey % 10 < 9 THEN 'COMPLETED' ELSE 'FAILED' END AS state,
  o_orderkey % 7 AS generation, CAST(o_orderkey % 4 AS INTEGER) AS attempts, o_orderdate AS available_at, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 10 IN (4, 5) THEN o_orderdate + INTERVAL 700 DAY END AS lease_until, CASE WHEN o_orderkey % 10 >= 7 THEN o_orderdate + INTERVAL 30 DAY END AS finished_at,
  CASE WHEN o_orderkey % 10 = 9 THEN {_REASON.replace("k", "o_orderkey")} END AS reason FROM orders)"""
DOCS = f"""d AS (SELECT c_custkey AS doc_id, ['PENDING', 'PROCESSING', 'COMPLETED', 'SKIPPED', 'FAILED'][c_custkey % 5 + 1] AS status,
  CASE WHEN c_custkey % 5 >= 3 THEN {_REASON.replace("k", "(c_custkey // 5)")} END AS reason, TIMESTAMP '1998-01-01' + to_days(CAST(c_custkey % 200 AS INTEGER)) AS updated_at FROM customer)"""
_LIVE = f"(state = 'RUNNING' AND lease_until > {_NOW})"
_EXPIRED = f"(state = 'RUNNING' AND lease_until <= {_NOW})"
_CLASS = f"CASE WHEN reason IN {DECLINE_REASONS} THEN 'expected_decline' WHEN reason IN {RETRYABLE_REASONS} THEN 'retryable' WHEN reason IN {TERMINAL_REASONS} THEN 'terminal' ELSE 'operator_decision' END"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 10 < 4, "READY").when(k % 10 < 6, "RUNNING").when(k % 10 == 6, "WAITING_SOURCE").when(k % 10 < 9, "COMPLETED").otherwise("FAILED")
    names = F.array(*map(F.lit, REASONS))
    return table(spark, d, "orders").select(
        k.alias("job_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("subject"), F.concat(F.lit("r"), k % 3).alias("revision"), state.alias("state"),
        (k % 7).alias("generation"), (k % 4).cast("int").alias("attempts"), F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("created_at"),
        F.when((k % 10).isin(4, 5), F.col("o_orderdate") + F.expr("INTERVAL 700 DAYS")).alias("lease_until"), F.when(k % 10 >= 7, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("finished_at"),
        F.when(k % 10 == 9, F.element_at(names, (k % 5 + 1).cast("int"))).alias("reason"),
    ).withColumns({"claimed_at": F.col("created_at"), "claimed_by": F.lit(None).cast("string")})


def documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % 5 + 1).cast("int"))
    status = pick(("PENDING", "PROCESSING", "COMPLETED", "SKIPPED", "FAILED"), k)
    reason = F.when(k % 5 >= 3, pick(REASONS, F.floor(k / 5)))
    when = F.make_timestamp_ntz(F.lit(1998), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp") + F.make_dt_interval((k % 200).cast("int"))
    return table(spark, d, "customer").select(k.alias("doc_id"), status.alias("status"), reason.alias("reason"), when.alias("updated_at"))


@query(f"WITH {DOCS} SELECT status, count(*) AS n FROM d GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {DOCS} SELECT status, coalesce(reason, 'UNKNOWN') AS reason, count(*) AS n FROM d WHERE status IN ('FAILED', 'SKIPPED') GROUP BY ALL")
def reasons(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).filter("status IN ('FAILED', 'SKIPPED')")
    return t.groupBy("status", F.coalesce("reason", F.lit("UNKNOWN")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {JOBS} SELECT subject, count(*) AS n, min(available_at) FILTER (state = 'READY') AS next_available, min(lease_until) FILTER (state = 'RUNNING') AS next_expiry
FROM j WHERE state IN ('READY', 'RUNNING', 'WAITING_SOURCE') GROUP BY 1""")
def queue_depths(spark: SparkSession, d: str) -> DataFrame:
    return J.depths(jobs(spark, d))


@query(f"""WITH {JOBS} SELECT state, count(*) AS n, count(*) FILTER ({_EXPIRED}) AS expired, count(*) FILTER (state IN ('READY', 'RUNNING') AND attempts >= 3) AS exhausted FROM j GROUP BY 1""")
def job_stats(spark: SparkSession, d: str) -> DataFrame:
    return J.stats(jobs(spark, d), NOW)


@query(f"""WITH {JOBS} SELECT count(*) FILTER (state IN ('READY', 'RUNNING')) AS unfinished, count(*) FILTER (state = 'WAITING_SOURCE') AS waiting,
count(*) FILTER (state = 'FAILED' AND finished_at >= TIMESTAMP '1997-01-01') AS failed FROM j""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.resolution(jobs(spark, d), datetime(1997, 1, 1))


_CLAIM = f"""o AS (SELECT *, 0 AS f FROM j WHERE subject = '1-URGENT' AND {_EXPIRED} ORDER BY lease_until, job_id LIMIT 1),
r AS (SELECT *, 1 AS f FROM j WHERE subject = '1-URGENT' AND state = 'READY' AND available_at <= {_NOW} ORDER BY available_at, created_at, job_id LIMIT 20),
c AS (SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM r) ORDER BY f, available_at, created_at, job_id LIMIT 20)"""


@query(f"WITH {JOBS}, {_CLAIM} SELECT job_id, state, attempts FROM c")
def claim_ready(spark: SparkSession, d: str) -> DataFrame:
    return J.claimable(jobs(spark, d), "1-URGENT", 20, NOW).select("job_id", "state", "attempts")


@query(f"""WITH {JOBS}, {_CLAIM} SELECT job_id, CASE WHEN k THEN 'RUNNING' ELSE state END AS state, CASE WHEN k THEN least(attempts + 1, 3) ELSE attempts END AS attempts,
CASE WHEN k THEN generation + 1 ELSE generation END AS generation, CASE WHEN k THEN {_NOW} + INTERVAL 300 SECOND ELSE lease_until END AS lease_until
FROM (SELECT *, job_id IN (SELECT job_id FROM c) AS k FROM j)""")
def claim_applied(spark: SparkSession, d: str) -> DataFrame:
    t = jobs(spark, d)
    out = J.claimed(t, J.claimable(t, "1-URGENT", 20, NOW), NOW, "w1")
    return out.select("job_id", "state", "attempts", "generation", "lease_until")


OUTCOMES = ("ok", "declined", "lease_lost", "busy", "deadlock", "source_unavailable", "shutdown", "data_exception", "terminal", "error")
_OUT = str(list(OUTCOMES))


@query(f"""WITH {JOBS}, o AS (SELECT *, {_OUT}[job_id // 10 % 10 + 1] AS o, {_LIVE} AS live FROM j),
v AS (SELECT *, CASE WHEN NOT coalesce(live, FALSE) THEN 'none' WHEN o = 'ok' THEN 'complete' WHEN o = 'declined' THEN 'skip' WHEN o = 'lease_lost' THEN 'none' WHEN o IN ('busy', 'deadlock', 'shutdown') THEN 'release'
  WHEN o = 'source_unavailable' THEN 'wait' WHEN o IN ('data_exception', 'terminal') OR attempts >= 3 THEN 'fail' ELSE 'retry' END AS a FROM o)
SELECT job_id, CASE WHEN a IN ('complete', 'skip') THEN 'COMPLETED' WHEN a = 'fail' THEN 'FAILED' WHEN a = 'wait' THEN 'WAITING_SOURCE' WHEN a IN ('release', 'retry') THEN 'READY' ELSE state END AS state,
  CASE WHEN a IN ('release', 'wait') THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts,
  CASE WHEN a = 'release' THEN {_NOW} + CASE o WHEN 'busy' THEN INTERVAL 30 SECOND WHEN 'deadlock' THEN INTERVAL 2500 MILLISECOND ELSE INTERVAL 0 SECOND END
    WHEN a = 'retry' THEN {_NOW} + to_seconds(CAST(least(300, 60 * pow(2, attempts - 1)) AS BIGINT)) ELSE available_at END AS available_at,
  CASE WHEN a = 'fail' THEN CASE WHEN o = 'data_exception' THEN 'STORE_REJECTED' ELSE 'OCR_FAILED' END WHEN a = 'wait' THEN 'SOURCE_UNAVAILABLE' WHEN a IN ('skip', 'retry') THEN 'OCR_FAILED' ELSE reason END AS reason FROM v""")
def verdict_table(spark: SparkSession, d: str) -> DataFrame:
    """All live jobs settled with outcomes of every kind."""
    t = jobs(spark, d)
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), (F.floor(F.col("job_id") / 10) % 10 + 1).cast("int"))
    out = J.settle(t, t.select("job_id", "generation", outcome.alias("outcome"), F.lit("OCR_FAILED").alias("reason")), NOW)
    return out.select("job_id", "state", "attempts", "available_at", "reason")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN {_LIVE} THEN least({_NOW} + INTERVAL 300 SECOND, created_at + INTERVAL 3600 SECOND) ELSE lease_until END AS lease_until FROM j")
def lease_renewal(spark: SparkSession, d: str) -> DataFrame:
    return J.renewed(jobs(spark, d), NOW).select("job_id", "lease_until")


@query(f"""WITH {JOBS} SELECT job_id, CASE WHEN state = 'WAITING_SOURCE' THEN 'READY' ELSE state END AS state, generation + CASE WHEN state = 'WAITING_SOURCE' THEN 1 ELSE 0 END AS generation FROM j""")
def resume_sources(spark: SparkSession, d: str) -> DataFrame:
    return J.resumed(jobs(spark, d), NOW).select("job_id", "state", "generation")


@query(f"""WITH {JOBS}, n AS (SELECT doc_id, subject, 'r' || ((job_id + 1) % 3) AS revision FROM j WHERE job_id % 2 = 0)
SELECT doc_id, subject, revision FROM j UNION ALL SELECT DISTINCT doc_id, subject, revision FROM n WHERE (doc_id, subject, revision) NOT IN (SELECT doc_id, subject, revision FROM j)""")
def publish_absent(spark: SparkSession, d: str) -> DataFrame:
    t = jobs(spark, d)
    new = t.filter("job_id % 2 = 0").withColumn("revision", F.concat(F.lit("r"), (F.col("job_id") + 1) % 3))
    return J.publish(t, new).select("doc_id", "subject", "revision")


@query(f"""WITH {JOBS}, {DOCS}, x AS (SELECT doc_id, count(*) AS n, bool_or(coalesce({_LIVE}, FALSE)) AS live, bool_or(state = 'FAILED' OR coalesce({_EXPIRED}, FALSE)) AS reset FROM j GROUP BY 1),
p AS (SELECT d.*, coalesce(n, 0) AS n, coalesce(live, FALSE) AS live, coalesce(reset, FALSE) AS reset, {_CLASS} AS k FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, status, reason, CASE WHEN live THEN 'not_recoverable' WHEN status IN ('PENDING', 'PROCESSING') AND n > 0 AND NOT reset THEN 'converged' WHEN status IN ('COMPLETED', 'SKIPPED') THEN 'converged'
  WHEN status IN ('PENDING', 'PROCESSING') THEN 'retryable' WHEN n = 0 OR k IN ('retryable', 'expected_decline') THEN 'retryable' WHEN k = 'terminal' THEN 'terminal' ELSE 'not_recoverable' END AS class,
CASE WHEN live THEN 'refuse' WHEN status IN ('PENDING', 'PROCESSING') AND n > 0 AND NOT reset THEN 'skip' WHEN status IN ('COMPLETED', 'SKIPPED') THEN 'skip' WHEN status = 'PENDING' THEN 'retry_transition'
  WHEN status = 'PROCESSING' THEN 'reset_processing' WHEN n = 0 OR k IN ('retryable', 'expected_decline') THEN 'retry_transition' ELSE 'refuse' END AS action FROM p""")
def recovery_classify(spark: SparkSession, d: str) -> DataFrame:
    return J.recovery(documents(spark, d), jobs(spark, d), NOW)


@query("SELECT class, action, count(*) AS n FROM (" + ORACLES["recovery_classify"] + ") GROUP BY ALL")
def recovery_tally(spark: SparkSession, d: str) -> DataFrame:
    return J.recovery_tally(J.recovery(documents(spark, d), jobs(spark, d), NOW))


@query(f"""WITH {JOBS}, {DOCS} SELECT doc_id, reason FROM (SELECT d.*, {_CLASS} AS k, doc_id NOT IN (SELECT doc_id FROM j) AS jobless FROM d WHERE status = 'FAILED')
WHERE jobless OR k IN ('retryable', 'expected_decline') ORDER BY updated_at, doc_id LIMIT 500""")
def redrivable(spark: SparkSession, d: str) -> DataFrame:
    return J.redrivable(documents(spark, d), jobs(spark, d)).select("doc_id", "reason")


@query(f"""WITH {JOBS}, {DOCS} SELECT doc_id, updated_at FROM d WHERE status = 'PROCESSING' AND updated_at < TIMESTAMP '1998-05-02' AND doc_id NOT IN (SELECT doc_id FROM j WHERE {_LIVE}) ORDER BY updated_at, doc_id LIMIT 500""")
def stale_processing(spark: SparkSession, d: str) -> DataFrame:
    return J.stale(documents(spark, d), jobs(spark, d), "PROCESSING", timedelta(days=30), NOW).select("doc_id", "updated_at")


@query(f"""WITH {JOBS}, {DOCS}, lv AS (SELECT DISTINCT doc_id FROM j WHERE {_LIVE}), c AS (
  SELECT CASE WHEN status IN ('PENDING', 'PROCESSING') THEN 'STALE_' || status ELSE status || '_REASON_' || coalesce(reason, 'UNKNOWN') END AS code FROM d
    WHERE status IN ('FAILED', 'SKIPPED') OR (status IN ('PENDING', 'PROCESSING') AND updated_at < TIMESTAMP '1998-05-02' AND doc_id NOT IN (SELECT doc_id FROM lv))
  UNION ALL SELECT 'JOBS_EXPIRED_LEASES' FROM j WHERE {_EXPIRED} UNION ALL SELECT 'JOBS_EXHAUSTED_BUDGET' FROM j WHERE state IN ('READY', 'RUNNING') AND attempts >= 3
  UNION ALL SELECT 'SOURCE_WAITING_JOBS' FROM j WHERE state = 'WAITING_SOURCE' UNION ALL SELECT 'JOBS_FAILED_REASON_' || coalesce(reason, 'UNKNOWN') FROM j WHERE state = 'FAILED')
SELECT code, CASE WHEN starts_with(code, 'SKIPPED_') THEN 'info' WHEN code IN ('STALE_PENDING', 'JOBS_EXPIRED_LEASES', 'SOURCE_WAITING_JOBS') THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM c GROUP BY code""")
def health_findings(spark: SparkSession, d: str) -> DataFrame:
    return J.findings(documents(spark, d), jobs(spark, d), NOW, timedelta(days=30))


@query(f"""WITH {JOBS} SELECT doc_id, job_id, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY finished_at DESC NULLS LAST, job_id) AS n FROM j) WHERE n = 1""")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_by_job(jobs(spark, d)).select("doc_id", "job_id", "finished_at")


@query(f"""WITH {DOCS} SELECT reason, doc_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY updated_at DESC, doc_id) AS nth FROM d WHERE status = 'FAILED') WHERE nth <= 3""")
def examples_per_group(spark: SparkSession, d: str) -> DataFrame:
    return J.examples(documents(spark, d).filter("status = 'FAILED'"), "reason", 3).select("reason", "doc_id", F.col("nth").cast("long").alias("nth"))


@query("""WITH p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS mime, p_brand AS ext, DATE '1998-01-01' + CAST(p_size AS INTEGER) AS t FROM part)
SELECT mime, ext, p_partkey AS doc_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY mime, ext ORDER BY t DESC, p_partkey) AS nth FROM p) WHERE nth <= 2""")
def examples_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """The newest two of every pair of type and extension."""
    when = F.date_add(F.lit(datetime(1998, 1, 1)).cast("date"), F.col("p_size").cast("int"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("mime"), F.col("p_brand").alias("ext"), when.alias("updated_at"))
    return J.examples(p, ["mime", "ext"], 2).select("mime", "ext", "doc_id", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {JOBS}, {DOCS}, t AS (SELECT DISTINCT doc_id FROM j WHERE finished_at >= TIMESTAMP '1997-01-01' OR created_at >= TIMESTAMP '1997-01-01'), x AS (SELECT d.* FROM d SEMI JOIN t USING (doc_id))
SELECT 'documents' AS section, status AS name, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'reasons', status || ':' || coalesce(reason, 'UNKNOWN'), count(*) FROM x WHERE status IN ('FAILED', 'SKIPPED') GROUP BY ALL
UNION ALL SELECT 'queues', subject, count(*) FROM j WHERE state IN ('READY', 'RUNNING', 'WAITING_SOURCE') GROUP BY ALL
UNION ALL SELECT 'unsettled', unnest(['unfinished', 'waiting', 'failed']), unnest([count(*) FILTER (state IN ('READY', 'RUNNING')), count(*) FILTER (state = 'WAITING_SOURCE'), count(*) FILTER (state = 'FAILED' AND finished_at >= TIMESTAMP '1997-01-01')]) FROM j""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    return J.run_report(documents(spark, d), jobs(spark, d), datetime(1997, 1, 1))


@query(f"""WITH {JOBS}, {DOCS}, t AS (SELECT doc_id FROM j WHERE finished_at >= TIMESTAMP '1997-01-01' UNION SELECT doc_id FROM j WHERE created_at >= TIMESTAMP '1998-01-01')
SELECT status, coalesce(reason, '') AS reason, count(*) AS n FROM d SEMI JOIN t USING (doc_id) GROUP BY ALL""")
def settled_tallies(spark: SparkSession, d: str) -> DataFrame:
    return J.touched_tallies(documents(spark, d), jobs(spark, d), datetime(1997, 1, 1), datetime(1998, 1, 1))


@query(f"""WITH {DOCS} SELECT doc_id, n FROM (SELECT doc_id, updated_at, count(*) OVER () AS n FROM d WHERE status = 'SKIPPED') ORDER BY updated_at, doc_id LIMIT 10""")
def total_with_limit(spark: SparkSession, d: str) -> DataFrame:
    """Ten rows with the number of all: the count is a row of its own, not a window over all rows."""
    t = documents(spark, d).filter("status = 'SKIPPED'")
    return t.orderBy("updated_at", "doc_id").limit(10).select("doc_id").crossJoin(F.broadcast(t.agg(F.count("*").alias("n"))))


@query("""WITH k AS (SELECT o_custkey % 4 AS root_id, 'f' || o_orderkey AS relative_path, o_orderkey AS doc_id FROM orders), s AS (SELECT * FROM k WHERE doc_id % 3 <> 0)
SELECT root_id, relative_path, doc_id, doc_id % 3 <> 0 AS available FROM k""")
def scan_availability_flip(spark: SparkSession, d: str) -> DataFrame:
    """A complete scan that misses every third file."""
    k = table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("root_id"), F.concat(F.lit("f"), "o_orderkey").alias("relative_path"), F.col("o_orderkey").alias("doc_id"), F.lit(True).alias("available"))
    return J.observed(k, k.filter("doc_id % 3 <> 0"), complete=True)


@query("""WITH k AS (SELECT o_custkey % 4 AS root_id, 'f' || o_orderkey AS relative_path, o_orderkey AS doc_id FROM orders) SELECT root_id, relative_path, doc_id, TRUE AS available FROM k""")
def scan_incomplete(spark: SparkSession, d: str) -> DataFrame:
    """An incomplete scan proves no absence."""
    k = table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("root_id"), F.concat(F.lit("f"), "o_orderkey").alias("relative_path"), F.col("o_orderkey").alias("doc_id"), F.lit(True).alias("available"))
    return J.observed(k, k.filter("doc_id % 3 <> 0"), complete=False)


UPSERTED = """WITH o AS (SELECT o_custkey % 50 AS root_id, o_orderpriority AS path, o_orderkey AS doc_id, o_orderdate AS t FROM orders),
a AS (SELECT root_id, path, arg_max(doc_id, (t, doc_id)) AS doc_id, max(t) AS t FROM o WHERE doc_id % 3 = 0 GROUP BY ALL), b AS (SELECT root_id, path, arg_max(doc_id, (t, doc_id)) AS doc_id FROM o WHERE doc_id % 3 = 1 AND root_id < 30 GROUP BY ALL)
SELECT root_id, path, coalesce(b.doc_id, a.doc_id) AS doc_id, a.t AS first_seen FROM a FULL JOIN b USING (root_id, path)"""


@query(UPSERTED)
def upsert_last_writer(spark: SparkSession, d: str) -> DataFrame:
    """Member routes over those stored before; when a route was first seen stays."""
    t = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("root_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("first_seen"))
    key = ["root_id", "path"]
    old = store.last_writer(t.filter("doc_id % 3 = 0"), key, ["first_seen", "doc_id"])
    new = store.last_writer(t.filter("doc_id % 3 = 1 AND root_id < 30"), key, ["first_seen", "doc_id"]).withColumn("first_seen", F.lit(None).cast(t.schema["first_seen"].dataType))
    return store.upsert(old, new, key, keep=("first_seen",))


@query("""SELECT split_part(t, ';', 1) AS mime, ext, count(*) AS n FROM (SELECT p_type || '; charset=x' AS t, lower(regexp_extract(replace(p_name, ' ', '.'), '(\\.[A-Za-z0-9_+-]{1,10})$', 1)) AS ext FROM part) GROUP BY ALL""".replace("\\\\", "\\"))
def extension_groups(spark: SparkSession, d: str) -> DataFrame:
    return J.unsupported_by_kind(table(spark, d, "part").select(F.concat("p_type", F.lit("; charset=x")).alias("mime"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("filename")))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'delivery_status' WHEN 1 THEN 'mailing_list' WHEN 2 THEN 'auto_submitted' WHEN 3 THEN 'bulk' WHEN 4 THEN 'human' ELSE 'delivery_status' END AS class FROM events""")
def automation_class(spark: SparkSession, d: str) -> DataFrame:
    """Messages with one telling header each, and one with both a report and a list."""
    h = lambda **x: F.create_map(*[F.lit(y) for k, v in x.items() for y in (k.replace("_", "-"), v)])
    every = F.array(
        h(from_="A <a@x.org>", return_path="<>"), h(list_id="News <news.x.org>"), h(auto_submitted="auto-replied"), h(precedence="bulk"), h(auto_submitted="no"),
        h(content_type='multipart/report; report-type="delivery-status"', list_unsubscribe="<x>"),
    )
    e = table(spark, d, "events")
    return e.select("event_id", text.automation_class(F.element_at(every, (F.col("event_id") % 6 + 1).cast("int"))).alias("class"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def grouped_totals(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit(datetime(1998, 9, 2)))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return ingest.counted(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events taken as a stream until none is left, merged batch by batch, then counted."""
    base = f"{shared_dir(spark)}/lodeworks/stream-{uuid.uuid4().hex}"
    source = f"{d}/events.parquet"
    run = ingest.drained(spark, source, table(spark, d, "events").schema, f"{base}/checkpoint", ingest.by_batch(f"{base}/out"))
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))
