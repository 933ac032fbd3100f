"""The durable work queue as table transitions, and the reports on it.

Times are parameters, so that a run can be replayed. One writer at a time applies
transitions; a lease and a generation number fence out a worker that lost its job.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.text import backoff_seconds, bare_mime, extension, reason_class
from lodeworks.vocabulary import BUSY_S, HANDLER_S, LEASE_S, MAX_ATTEMPTS


def live(now: datetime) -> Column:
    return (F.col("state") == "RUNNING") & (F.col("lease_until") > F.lit(now))


def expired(now: datetime) -> Column:
    return (F.col("state") == "RUNNING") & (F.col("lease_until") <= F.lit(now))


def publish(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``jobs`` with those of ``new`` whose document, subject and revision are not there yet."""
    key = ["doc_id", "subject", "revision"]
    return jobs.unionByName(new.dropDuplicates(key).join(jobs, key, "left_anti"), allowMissingColumns=True)


def claimable(jobs: DataFrame, subject: str, limit: int, now: datetime, turn: int = 0) -> DataFrame:
    """The jobs that a claim takes: one whose lease expired first, then ready ones by age.

    A claim of one job would never come to the other kind, so with ``limit`` 1 odd
    values of ``turn``, the claimer's count, look for an expired job first and even
    ones for a ready job first.
    """
    ready = (F.col("state") == "READY") & (F.col("available_at") <= F.lit(now))
    own = jobs.filter(F.col("subject") == subject)
    old = own.filter(expired(now)).orderBy("lease_until", "job_id").limit(1)
    due = own.filter(ready).orderBy("available_at", "created_at", "job_id").limit(limit)
    both = old.withColumn("_first", F.lit(0 if limit > 1 or turn % 2 else 2)).unionByName(due.withColumn("_first", F.lit(1)))
    return both.orderBy("_first", "available_at", "created_at", "job_id").limit(limit).drop("_first")


def claimed(jobs: DataFrame, chosen: DataFrame, now: datetime, owner: str) -> DataFrame:
    """``jobs`` after ``chosen`` (job_id) were claimed."""
    t = jobs.join(F.broadcast(chosen.select("job_id", F.lit(True).alias("_c"))), "job_id", "left")
    take = F.coalesce("_c", F.lit(False))
    put = lambda c, v: F.when(take, v).otherwise(F.col(c)).alias(c)
    new = {
        "state": F.lit("RUNNING"), "attempts": F.least(F.col("attempts") + 1, F.lit(MAX_ATTEMPTS)), "generation": F.col("generation") + 1,
        "lease_until": F.lit(now + timedelta(seconds=LEASE_S)), "claimed_at": F.lit(now), "claimed_by": F.lit(owner),
    }
    return t.select(*[put(c, new[c]) if c in new else F.col(c) for c in jobs.columns])


def renewed(jobs: DataFrame, now: datetime) -> DataFrame:
    """Live leases run five minutes from now, but not past an hour after the claim."""
    until = F.least(F.lit(now + timedelta(seconds=LEASE_S)), F.col("claimed_at") + F.expr(f"INTERVAL {HANDLER_S} SECONDS"))
    return jobs.withColumn("lease_until", F.when(live(now), until).otherwise(F.col("lease_until")))


def verdict(outcome: Column, reason: Column, attempts: Column) -> Column:
    """(action, delay_s, reason) for how a handler ended.

    ``outcome``: ok, declined, lease_lost, busy, deadlock, source_unavailable,
    source_changed, shutdown, pruned, data_exception, terminal or error.
    """
    spent = attempts >= MAX_ATTEMPTS
    what = lambda action, delay=0.0, why=None: F.struct(F.lit(action).alias("action"), (F.lit(delay) if not isinstance(delay, Column) else delay).cast("double").alias("delay_s"), (reason if why is None else F.lit(why)).alias("reason"))
    return (
        F.when(outcome == "ok", what("complete", why="")).when(outcome == "declined", what("skip"))
        .when(outcome == "lease_lost", what("none", why="")).when(outcome == "busy", what("release", float(BUSY_S), ""))
        .when(outcome == "deadlock", what("release", 2.5, "")).when(outcome == "source_unavailable", what("wait", why="SOURCE_UNAVAILABLE"))
        .when(outcome == "source_changed", what("wait", why="SOURCE_CHANGED")).when(outcome == "shutdown", what("release", 0.0, ""))
        .when(outcome == "pruned", what("discard", why="DOCUMENT_PRUNED")).when(outcome == "data_exception", what("fail", why="STORE_REJECTED"))
        .when((outcome == "terminal") | spent, what("fail")).otherwise(what("retry", backoff_seconds(attempts)))
    )


def settle(jobs: DataFrame, outcomes: DataFrame, now: datetime) -> DataFrame:
    """``jobs`` after ``outcomes`` (job_id, generation, outcome, reason). Outcomes of a lost lease or an older claim change nothing.

    Returning a job without a verdict refunds the attempt its claim charged. Of
    several outcomes of one claim the least by name and reason counts.
    """
    one = outcomes.groupBy("job_id", F.col("generation").alias("_g")).agg(F.min(F.struct("outcome", "reason")).alias("_m"))
    o = one.select(F.col("job_id").alias("_j"), "_g", F.col("_m.outcome").alias("_o"), F.col("_m.reason").alias("_r"))
    t = jobs.join(o, (F.col("job_id") == F.col("_j")) & (F.col("generation") == F.col("_g")), "left").withColumn("_v", verdict(F.col("_o"), F.col("_r"), F.col("attempts")))
    fenced = F.coalesce(live(now) & (F.col("generation") == F.col("_g")), F.lit(False))
    action = F.when(fenced, F.col("_v.action")).otherwise("none")
    state = (
        F.when(action.isin("complete", "skip"), "COMPLETED").when(action == "fail", "FAILED").when(action == "wait", "WAITING_SOURCE")
        .when(action.isin("release", "retry"), "READY").otherwise(F.col("state"))
    )
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_v.delay_s").cast("decimal(18,6)"))
    moved = action.isin("release", "retry")
    ended = action.isin("complete", "skip", "fail")
    new = {
        "state": state,
        "attempts": F.when(action.isin("release", "wait"), F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")),
        "available_at": F.when(moved, F.lit(now) + delay).otherwise(F.col("available_at")),
        "lease_until": F.when(action != "none", None).otherwise(F.col("lease_until")),
        "finished_at": F.when(ended, F.lit(now)).otherwise(F.col("finished_at")),
        "reason": F.when(action.isin("fail", "retry", "wait", "skip"), F.col("_v.reason")).otherwise(F.col("reason")),
    }
    kept = t.filter(action != "discard")
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def resumed(jobs: DataFrame, now: datetime) -> DataFrame:
    """Jobs that waited for a source are ready again, under a new generation."""
    waits = F.col("state") == "WAITING_SOURCE"
    return jobs.withColumn("generation", F.when(waits, F.col("generation") + 1).otherwise(F.col("generation"))).withColumn("available_at", F.when(waits, F.lit(now)).otherwise(F.col("available_at"))).withColumn("state", F.when(waits, "READY").otherwise(F.col("state")))


def depths(jobs: DataFrame) -> DataFrame:
    """For each subject: open jobs, when the next one is due, and when the next lease ends."""
    open_ = jobs.filter(F.col("state").isin("READY", "RUNNING", "WAITING_SOURCE"))
    return open_.groupBy("subject").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("state") == "READY", F.col("available_at"))).alias("next_available"),
        F.min(F.when(F.col("state") == "RUNNING", F.col("lease_until"))).alias("next_expiry"),
    )


def stats(jobs: DataFrame, now: datetime) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"), F.count_if(expired(now)).alias("expired"), F.count_if(F.col("state").isin("READY", "RUNNING") & (F.col("attempts") >= MAX_ATTEMPTS)).alias("exhausted"))


def resolution(jobs: DataFrame, since: datetime) -> DataFrame:
    """One row: what keeps a run from being settled."""
    return jobs.agg(
        F.count_if(F.col("state").isin("READY", "RUNNING")).alias("unfinished"), F.count_if(F.col("state") == "WAITING_SOURCE").alias("waiting"),
        F.count_if((F.col("state") == "FAILED") & (F.col("finished_at") >= F.lit(since))).alias("failed"),
    )


def recovery(documents: DataFrame, jobs: DataFrame, now: datetime, *, reasons: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """(doc_id, status, reason, class, action): what recovery would do with each document. Changes nothing."""
    j = jobs.groupBy("doc_id").agg(F.count("*").alias("_n"), F.max(live(now)).alias("_live"), F.max((F.col("state") == "FAILED") | expired(now)).alias("_reset"))
    t = documents.join(j, "doc_id", "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_live": F.coalesce("_live", F.lit(False)), "_reset": F.coalesce("_reset", F.lit(False))})
    status, kind = F.col("status"), reason_class(F.col("reason"))
    say = lambda c, a: F.struct(F.lit(c).alias("class"), F.lit(a).alias("action"))
    named = F.lit(every) | F.col("reason").isin(*reasons) if reasons else F.lit(every)
    plan = (
        F.when(F.col("_live"), say("not_recoverable", "refuse"))
        .when(status.isin("PENDING", "PROCESSING") & (F.col("_n") > 0) & ~F.col("_reset"), say("converged", "skip"))
        .when(status.isin("COMPLETED", "SKIPPED"), say("converged", "skip"))
        .when(status == "PENDING", say("retryable", "retry_transition"))
        .when(status == "PROCESSING", say("retryable", "reset_processing"))
        .when((status == "FAILED") & ((F.col("_n") == 0) | named), say("retryable", "retry_transition"))
        .when((status == "FAILED") & kind.isin("retryable", "expected_decline"), say("retryable", "retry_transition"))
        .when((status == "FAILED") & (kind == "terminal"), say("terminal", "refuse"))
        .otherwise(say("not_recoverable", "refuse"))
    )
    return t.withColumn("_p", plan).select("doc_id", "status", "reason", F.col("_p.class").alias("class"), F.col("_p.action").alias("action"))


def recovered(jobs: DataFrame, expected: DataFrame, now: datetime) -> DataFrame:
    """``jobs`` with failed and expired ones of the expected set ready for a fresh cycle. Fails if the set has changed or a lease is live."""
    key = ["job_id", "state", "generation"]
    own = jobs.join(expected.select("doc_id").distinct(), "doc_id", "left_semi")
    changed = own.select(*key).exceptAll(expected.select(*key)).union(expected.select(*key).exceptAll(own.select(*key)))
    if not changed.isEmpty() or not own.filter(live(now)).isEmpty():
        raise RuntimeError("the jobs changed since the plan was made, or one is running")
    mark = jobs.join(expected.select("job_id", F.lit(True).alias("_e")), "job_id", "left")
    hit = F.coalesce("_e", F.lit(False)) & ((F.col("state") == "FAILED") | expired(now))
    new = {"state": F.lit("READY"), "attempts": F.lit(0), "generation": F.col("generation") + 1, "available_at": F.lit(now), "lease_until": F.lit(None)}
    return mark.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def redrivable(documents: DataFrame, jobs: DataFrame, most: int = 500) -> DataFrame:
    """Failed documents worth another run: by reason, or because they never had a job. Oldest first."""
    jobless = documents.join(jobs, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("_jobless"))
    t = documents.filter("status = 'FAILED'").join(jobless, "doc_id", "left")
    keep = F.coalesce("_jobless", F.lit(False)) | reason_class(F.col("reason")).isin("retryable", "expected_decline")
    return t.filter(keep).drop("_jobless").orderBy("updated_at", "doc_id").limit(most)


def stale(documents: DataFrame, jobs: DataFrame, status: str, age: timedelta, now: datetime, most: int = 500) -> DataFrame:
    """Documents that stood in ``status`` for longer than ``age`` and have no live job. Oldest first."""
    t = documents.filter((F.col("status") == status) & (F.col("updated_at") < F.lit(now - age)))
    return t.join(jobs.filter(live(now)), "doc_id", "left_anti").orderBy("updated_at", "doc_id").limit(most)


def findings(documents: DataFrame, jobs: DataFrame, now: datetime, age: timedelta) -> DataFrame:
    """(code, severity, n) of everything that is not in order or worth knowing; counts of nothing are left out."""
    old = F.col("updated_at") < F.lit(now - age)
    docs = documents.join(jobs.filter(live(now)).select("doc_id", F.lit(True).alias("_live")).distinct(), "doc_id", "left")
    stuck = old & F.col("_live").isNull()
    code = (
        F.when((F.col("status") == "PENDING") & stuck, F.lit("STALE_PENDING")).when((F.col("status") == "PROCESSING") & stuck, F.lit("STALE_PROCESSING"))
        .when(F.col("status") == "FAILED", F.concat(F.lit("FAILED_REASON_"), F.upper(F.coalesce("reason", F.lit("UNKNOWN")))))
        .when(F.col("status") == "SKIPPED", F.concat(F.lit("SKIPPED_REASON_"), F.upper(F.coalesce("reason", F.lit("UNKNOWN")))))
    )
    work = F.array_compact(
        F.array(
            F.when(expired(now), F.lit("JOBS_EXPIRED_LEASES")),
            F.when(F.col("state").isin("READY", "RUNNING") & (F.col("attempts") >= MAX_ATTEMPTS), F.lit("JOBS_EXHAUSTED_BUDGET")),
            F.when(F.col("state") == "WAITING_SOURCE", F.lit("SOURCE_WAITING_JOBS")),
            F.when(F.col("state") == "FAILED", F.concat(F.lit("JOBS_FAILED_REASON_"), F.upper(F.coalesce("reason", F.lit("UNKNOWN"))))),
        )
    )
    every = docs.select(code.alias("code")).filter("code IS NOT NULL").union(jobs.select(F.explode(work).alias("code")))
    grade = (
        F.when(F.startswith("code", F.lit("SKIPPED_")), "info").when(F.col("code").isin("STALE_PENDING", "JOBS_EXPIRED_LEASES", "SOURCE_WAITING_JOBS"), "warning").otherwise("error")
    )
    return every.groupBy("code").agg(F.count("*").alias("n")).select("code", grade.alias("severity"), "n")


def observed(known: DataFrame, seen: DataFrame, *, complete: bool) -> DataFrame:
    """Source occurrences after a scan. Only a complete scan proves that what it did not see is gone."""
    key = ["root_id", "relative_path"]
    rest = known.join(seen.select(*key), key, "left_anti")
    if complete:
        rest = rest.withColumn("available", F.lit(False))
    return seen.select(*known.columns).unionByName(rest)


def latest_by_job(jobs: DataFrame) -> DataFrame:
    """Each document's last finished job; unfinished ones come after all finished."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("finished_at").desc_nulls_last(), "job_id"))
    return jobs.withColumn("_n", nth).filter("_n = 1").drop("_n")


def examples(documents: DataFrame, group: str | list[str], most: int) -> DataFrame:
    """The newest ``most`` documents of each group, numbered."""
    nth = F.row_number().over(W.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(F.col("updated_at").desc(), F.col("doc_id").asc()))
    return documents.withColumn("nth", nth).filter(F.col("nth") <= most)




OPEN = ("READY", "RUNNING", "WAITING_SOURCE")


def open_jobs(jobs: DataFrame) -> DataFrame:
    """(doc_id, open): each document's jobs that are not finished, as (job_id, state, generation) by id."""
    own = jobs.filter(F.col("state").isin(*OPEN))
    return own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("job_id", "state", "generation"))).alias("open"))


def recovery_tally(plan: DataFrame) -> DataFrame:
    """(class, action, n) of a recovery plan."""
    return plan.groupBy("class", "action").agg(F.count("*").alias("n"))


def containers_after(documents: DataFrame, after: str | None, most: int) -> DataFrame:
    """The next ``most`` documents that can hold others (doc_id, doc_type), by id."""
    own = documents.filter(F.col("doc_type").isin("email", "archive"))
    return (own if after is None else own.filter(F.col("doc_id") > after)).orderBy("doc_id").limit(most)


def rerouted(documents: DataFrame, jobs: DataFrame, routes: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(documents, jobs) after documents were routed anew: open jobs of another stage go, the new stage's job is published.

    ``routes``: doc_id, doc_type, subject (null: declined, which skips the document).
    Fails if one of them has a running job.
    """
    chosen = jobs.join(routes.select("doc_id"), "doc_id", "left_semi")
    if not chosen.filter("state = 'RUNNING'").isEmpty():
        raise RuntimeError("a document to be routed anew has a running job")
    r = routes.select("doc_id", F.col("doc_type").alias("_t"), F.col("subject").alias("_s"), F.lit(True).alias("_c"))
    put = lambda c, v: F.when(F.col("_c"), v).otherwise(F.col(c)).alias(c)
    new = {
        "doc_type": F.col("_t"), "status": F.when(F.col("_s").isNull(), "SKIPPED").otherwise("PENDING"),
        "reason": F.when(F.col("_s").isNull(), "UNSUPPORTED_FORMAT"), "updated_at": F.lit(now),
    }
    docs = documents.join(r, "doc_id", "left").select(*[put(c, new[c]) if c in new else F.col(c) for c in documents.columns])
    left = jobs.join(r.select("doc_id", "_c"), "doc_id", "left").filter(F.col("_c").isNull() | ~F.col("state").isin(*OPEN)).select(*jobs.columns)
    due = r.filter("_s IS NOT NULL").select(
        F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), "_s", F.lit("reroute"), F.lit(now.isoformat())), 256).alias("job_id"), "doc_id", F.col("_s").alias("subject"),
        F.lit(f"reroute:{now.isoformat()}").alias("revision"), F.lit("READY").alias("state"), F.lit(0).cast("long").alias("generation"), F.lit(0).alias("attempts"),
        F.lit(now).alias("available_at"), F.lit(now).alias("created_at"),
    )
    return docs, publish(left.withColumn("job_id", F.col("job_id").cast("string")), due)


def touched_tallies(documents: DataFrame, jobs: DataFrame, since: datetime, created: datetime) -> DataFrame:
    """(status, reason, n) of the documents with a job that finished since ``since`` or was made since ``created``."""
    ended = jobs.filter(F.col("finished_at") >= F.lit(since)).select("doc_id")
    t = documents.join(ended.union(jobs.filter(F.col("created_at") >= F.lit(created)).select("doc_id")).distinct(), "doc_id", "left_semi")
    return t.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def unsupported_by_kind(files: DataFrame) -> DataFrame:
    """(mime, ext, n) of files (mime, filename)."""
    return files.groupBy(bare_mime(F.col("mime")).alias("mime"), extension(F.col("filename")).alias("ext")).agg(F.count("*").alias("n"))


def run_report(documents: DataFrame, jobs: DataFrame, since: datetime) -> DataFrame:
    """(section, name, n): one table of all that a run since ``since`` left behind: documents by status, failures and skips by reason, open jobs by subject, and what is unsettled."""
    def part(section: str, df: DataFrame, name: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.col("n").cast("long").alias("n"))

    touched = touched_tallies(documents, jobs, since, since)
    by_status = touched.groupBy("status").agg(F.sum("n").alias("n"))
    why = touched.filter("status IN ('FAILED', 'SKIPPED')").groupBy("status", "reason").agg(F.sum("n").alias("n"))
    left = resolution(jobs, since).select(F.explode(F.create_map(*[x for c in ("unfinished", "waiting", "failed") for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    return (
        part("documents", by_status, F.col("status")).union(part("reasons", why, F.concat_ws(":", "status", F.when(F.col("reason") == "", "UNKNOWN").otherwise(F.col("reason")))))
        .union(part("queues", depths(jobs), F.col("subject"))).union(part("unsettled", left, F.col("name")))
    )
