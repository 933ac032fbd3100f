"""Exact browsing of messages: filters, stable keyset pages and opaque cursors.

Order: newest first with undated messages last, ties by id downwards; oldest first
is the exact reverse.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.text import around, collapsed, sender_domain
from lodeworks.operators.tables import stored
from lodeworks.vocabulary import PAGE_DEFAULT, PAGE_MAX


#: Literal searches in one request.
MAX_NEEDLES = 10_000


def from_sender(messages: DataFrame, addresses: DataFrame, sender: str) -> DataFrame:
    own = addresses.filter(F.col("valid") & (F.col("kind") == "from") & (F.col("address") == sender))
    return messages.join(own.select("doc_id").distinct(), "doc_id", "left_semi")


def to_recipient(messages: DataFrame, addresses: DataFrame, recipient: str) -> DataFrame:
    own = addresses.filter(F.col("valid") & F.col("kind").isin("to", "cc", "bcc") & (F.col("address") == recipient))
    return messages.join(own.select("doc_id").distinct(), "doc_id", "left_semi")


def from_domain(messages: DataFrame, addresses: DataFrame, domain: str) -> DataFrame:
    own = addresses.filter(F.col("valid") & (F.col("kind") == "from") & (sender_domain(F.col("address")) == domain))
    return messages.join(own.select("doc_id").distinct(), "doc_id", "left_semi")


def direction(messages: DataFrame, addresses: DataFrame, owners: DataFrame, way: str) -> DataFrame:
    """``outbound``: an owner sent it. ``inbound``: an owner received it and none sent it. Else all."""
    held = addresses.filter("valid").join(F.broadcast(owners.select("address").distinct()), "address", "left_semi")
    sent = held.filter("kind = 'from'").select("doc_id")
    if way == "outbound":
        return messages.join(sent, "doc_id", "left_semi")
    if way == "inbound":
        got = held.filter("kind IN ('to', 'cc', 'bcc')").select("doc_id")
        return messages.join(got, "doc_id", "left_semi").join(sent, "doc_id", "left_anti")
    return messages


def window(messages: DataFrame, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """Sent at or after ``after`` and before ``before``; a bound drops undated messages."""
    if after is not None:
        messages = messages.filter(F.col("sent_at") >= F.lit(after))
    return messages.filter(F.col("sent_at") < F.lit(before)) if before is not None else messages


def as_of(messages: DataFrame, snapshot: datetime) -> DataFrame:
    """What was ingested up to a page series' start."""
    return messages.filter(F.col("ingested_at") <= F.lit(snapshot))


def page_order(newest: bool = True) -> list[Column]:
    if newest:
        return [F.col("sent_at").desc_nulls_last(), F.col("doc_id").desc()]
    return [F.col("sent_at").asc_nulls_first(), F.col("doc_id").asc()]


def reading_order() -> list[Column]:
    """A conversation as it is read: oldest first, undated messages last, where they are visibly without a place."""
    return [F.col("sent_at").asc_nulls_last(), F.col("doc_id").asc()]


def comes_before(a: tuple[datetime | None, object], b: tuple[datetime | None, object], newest: bool = True) -> bool:
    """Whether key (sent_at, doc_id) ``a`` stands before ``b`` in the page order."""
    if not newest:
        a, b = b, a
    if (a[0] is None) != (b[0] is None):
        return b[0] is None
    return a[1] > b[1] if a[0] == b[0] else a[0] > b[0]


def verified(rows: Sequence, newest: bool = True, after: tuple[datetime | None, object] | None = None) -> None:
    """Refuses a page that repeats its boundary or is out of order: pages would skip or repeat messages unseen."""
    keys = ([] if after is None else [after]) + [(r["sent_at"], r["doc_id"]) for r in rows]
    for a, b in itertools.pairwise(keys):
        if not comes_before(a, b, newest):
            raise RuntimeError(f"{b[1]!r} does not come after {a[1]!r} in the page order")


def past(sent_at: datetime | None, doc_id: object, newest: bool = True) -> Column:
    """Rows after the keyset position in the page order."""
    at, own = F.col("sent_at"), F.col("doc_id")
    tie = (own < F.lit(doc_id)) if newest else (own > F.lit(doc_id))
    if sent_at is None:
        return (at.isNull() & tie) if newest else (at.isNotNull() | tie)
    when = F.lit(sent_at)
    later = (at < when) | at.isNull() if newest else at > when
    return F.coalesce(later | ((at == when) & tie), F.lit(False))


def page(messages: DataFrame, *, newest: bool = True, after: tuple[datetime | None, object] | None = None, limit: int = PAGE_DEFAULT) -> DataFrame:
    """The next ``limit`` rows and one more, which says that there are more."""
    rows = messages if after is None else messages.filter(past(*after, newest))
    return rows.orderBy(*page_order(newest)).limit(limit + 1)


def numbered(messages: DataFrame, *, by: str, size: int = PAGE_DEFAULT) -> DataFrame:
    """``messages`` with their place and page in their mailbox, newest first, and their place as a conversation is read.

    A null mailbox is one of its own; messages that tie wholly have places one after the other.
    """
    both = _placed(_placed(messages, by, page_order(), "place"), by, reading_order(), "reading")
    return both.withColumn("page", F.floor((F.col("place") - 1) / size) + 1)


def _placed(rows: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Places from 1 in each ``by``, in tasks that hold ranges of the order: a large group is in several, whose sizes are added up."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = stored(rows.repartitionByRange(parts, F.col(by), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    size = t.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size = size.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), before.alias("_before"))
    own = t.withColumn("_nth", F.row_number().over(W.partitionBy(by, "_range").orderBy(*order)))
    out = own.join(size, own[by].eqNullSafe(size["_by"]) & (own["_range"] == size["_of"]))
    return out.select(*rows.columns, (F.col("_before") + F.col("_nth")).alias(name))


def text_pages(documents: DataFrame, *, key: str, text: str, most: int) -> DataFrame:
    """(key, page, part): every text in parts of at most ``most`` bytes, as ``page_bytes`` cuts them; an empty or null text has one empty part."""
    t = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                whole, at, parts = b.column(1)[n].as_py(), 0, []
                while at is not None:
                    part, at = page_bytes(whole, most, at)
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([n] * len(parts))), pa.array(range(1, len(parts) + 1), pa.int32()), pa.array(parts)], ["k", "page", "part"])

    out = t.mapInArrow(run, f"k {t.schema['k'].dataType.simpleString()}, page int, part string")
    return out.withColumnRenamed("k", key)


def recipients(addresses: DataFrame, cap: int = 20) -> DataFrame:
    """(doc_id, recipients, omitted): different addresses in the order to, cc, bcc, and how many the cap left out."""
    own = addresses.filter(F.col("valid") & F.col("kind").isin("to", "cc", "bcc"))
    rank = F.when(F.col("kind") == "to", 0).when(F.col("kind") == "cc", 1).otherwise(2)
    t = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("k"), "ordinal", "address"))).alias("_a"))
    every = F.array_distinct(F.transform("_a", lambda x: x["address"]))
    return t.select("doc_id", F.slice(every, 1, cap).alias("recipients"), F.greatest(F.size(every) - cap, F.lit(0)).alias("omitted"))


def shared_identifiers(messages: DataFrame) -> DataFrame:
    """Message ids that more than one document carries, with how many."""
    return messages.filter("message_id != ''").groupBy("message_id").agg(F.count("*").alias("n")).filter("n > 1")


# -- cursors --------------------------------------------------------------------------


def fingerprint(filters: dict[str, object]) -> str:
    """Digest of the filters; names and values carry their lengths, so that no two sets read alike."""
    h = hashlib.sha256()
    for k in sorted(filters):
        for part in (k, json.dumps(filters[k], default=str, sort_keys=True)):
            h.update(f"{len(part)}:{part}".encode())
    return h.hexdigest()


def cursor(filters: dict[str, object], newest: bool, sent_at: datetime | None, doc_id: object, snapshot: datetime) -> str:
    body = {"v": 1, "o": "newest" if newest else "oldest", "f": fingerprint(filters), "t": sent_at and sent_at.isoformat(), "d": doc_id, "s": snapshot.isoformat()}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def read_cursor(text: str, filters: dict[str, object], newest: bool) -> tuple[datetime | None, object, datetime]:
    """Position and snapshot; a cursor of other filters, order or version is refused."""
    try:
        body = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if body["v"] != 1 or body["o"] != ("newest" if newest else "oldest") or body["f"] != fingerprint(filters):
            raise ValueError
        at = datetime.fromisoformat(body["t"]) if body["t"] else None
        return at, body["d"], datetime.fromisoformat(body["s"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("the cursor does not belong to this request") from e


@dataclass
class Listing:
    rows: list
    more: bool
    cursor: str | None
    warnings: list[str] = field(default_factory=list)
    #: Makes the cursor after a row of this request.
    after: Callable[[object], str] | None = None

    def truncated(self, n: int) -> Listing:
        """The first ``n`` rows with a cursor after the last of them: what is dropped begins the next page."""
        if not 1 <= n < len(self.rows):
            raise ValueError(f"a page of {len(self.rows)} rows cannot be cut to {n}")
        return Listing(self.rows[:n], True, self.after(self.rows[n - 1]), self.warnings, self.after)

    def within(self, size: int, measure: Callable[[object], int]) -> Listing:
        """As many of the first rows as have ``size`` bytes together, one at least."""
        total, n = 0, 0
        for r in self.rows:
            total += measure(r)
            if n and total > size:
                return self.truncated(n)
            n += 1
        return self


def list_messages(
    messages: DataFrame, addresses: DataFrame, *, now: datetime, limit: int | None = None, newest: bool = True, sender: str | None = None, recipient: str | None = None,
    domain: str | None = None, way: str | None = None, owners: DataFrame | None = None, after: datetime | None = None, before: datetime | None = None, at: str | None = None,
) -> Listing:
    """One page with its cursor; later pages see what the first one's snapshot saw."""
    filters = {"sender": sender, "recipient": recipient, "domain": domain, "way": way, "after": after, "before": before}
    warnings: list[str] = []
    size = PAGE_DEFAULT if limit is None else max(1, limit)
    if size > PAGE_MAX:
        size, _ = PAGE_MAX, warnings.append("limit_clamped")
    if way in ("inbound", "outbound") and owners is None:
        raise ValueError("a direction needs owner addresses")
    position, snapshot = None, now
    if at:
        *key, snapshot = read_cursor(at, filters, newest)
        position = tuple(key)
    rows = as_of(messages, snapshot)
    for f, value in ((from_sender, sender), (to_recipient, recipient), (from_domain, domain)):
        rows = f(rows, addresses, value) if value else rows
    if way:
        rows = direction(rows, addresses, owners, way)
    if after or before:
        warnings.append("undated_excluded")
    found = page(window(rows, after, before), newest=newest, after=position, limit=size)
    got = found.collect()
    more, got = len(got) > size, got[:size]
    verified(got, newest, position)
    after_row = lambda r: cursor(filters, newest, r["sent_at"], r["doc_id"], snapshot)
    return Listing(got, more, after_row(got[-1]) if more and got else None, warnings, after_row)


#: What a reading of a document goes through, in order.
PHASES = ("text", "related")


def document_cursor(request: dict[str, object], doc_id: str, text: str, phase: str, offset: int) -> str:
    """Where the reading of a document goes on; it holds for this request and this text only."""
    body = {"v": 1, "f": fingerprint(request), "d": doc_id, "h": hashlib.sha256(text.encode()).hexdigest(), "p": PHASES.index(phase), "o": offset}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def read_document_cursor(at: str, request: dict[str, object], doc_id: str, text: str) -> tuple[str, int]:
    """Phase and byte offset; a cursor of another request, document or text, or beyond its end, is refused."""
    try:
        body = json.loads(base64.urlsafe_b64decode(at + "=" * (-len(at) % 4)))
        same = (body["v"], body["f"], body["d"], body["h"]) == (1, fingerprint(request), doc_id, hashlib.sha256(text.encode()).hexdigest())
        phase, offset = PHASES[body["p"]], body["o"]
        if not same or not isinstance(offset, int) or not 0 <= offset <= len(text.encode()) or body["p"] < 0:
            raise ValueError
        return phase, offset
    except (ValueError, KeyError, TypeError, IndexError) as e:
        raise ValueError("the cursor does not belong to this document") from e


def find_documents(documents: DataFrame, *, filename: str | None = None, sender: str | None = None, subject: str | None = None, day: datetime | None = None, most: int = 20) -> DataFrame:
    """Documents by file name, or by sender or subject on a day (UTC); newest first, at most ``most`` and one more."""
    t = documents
    for c, v in (("source_filename", filename), ("email_from", sender), ("email_subject", subject)):
        t = t.filter(F.col(c) == v) if v is not None else t
    if day is not None:
        t = t.filter((F.col("email_date") >= F.lit(day)) & (F.col("email_date") < F.lit(day) + F.expr("INTERVAL 1 DAY")))
    return t.orderBy(F.col("email_date").desc_nulls_last(), F.col("doc_id").asc()).limit(most + 1)


def page_bytes(text: str, most: int, at: int = 0) -> tuple[str, int | None]:
    """The next part of a text of at most ``most`` bytes, ending between characters and, in its later half, after a paragraph; and where the rest begins."""
    raw = text.encode()
    end = min(len(raw), at + most)
    while at < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    if end < len(raw) and (i := raw.rfind(b"\n\n", at + (end - at) // 2, end)) >= 0:
        end = i + 2
    return raw[at:end].decode(), end if end < len(raw) else None


def asked(spark: SparkSession, schema: str, *arrays: Sequence) -> DataFrame:
    """Parameters that come as arrays of one length, as rows with their place ``nth``; at most ``MAX_NEEDLES``."""
    rows = [(n, *x) for n, x in enumerate(zip(*arrays, strict=True), 1)]
    if len(rows) > MAX_NEEDLES:
        raise ValueError(f"at most {MAX_NEEDLES} rows in one request")
    return spark.createDataFrame(rows, f"nth int, {schema}")


def optional(c: Column, values: Sequence) -> Column:
    """One of ``values``; an empty set asks for nothing and takes all."""
    return c.isin(*values) if values else F.lit(True)


def excluded(c: Column, values: Sequence) -> Column:
    """None of ``values``."""
    return ~c.isin(*values) if values else F.lit(True)


def display_paths(occurrences: DataFrame) -> DataFrame:
    """(doc_id, path): of each document's available files the first by path."""
    return occurrences.filter("available").groupBy("doc_id").agg(F.min("path").alias("path"))


def needles_in(documents: DataFrame, needles: DataFrame, *, text: Column, key: Sequence[str], fold: bool = False, context: int = 240) -> DataFrame:
    """(needle_id, keys, position, context) of the first literal occurrence of each needle, white space collapsed on both sides.

    All needles in one pass over the texts: the needles, a request's parameters, are
    broadcast, at most ``MAX_NEEDLES`` of them.
    """
    if needles.limit(MAX_NEEDLES + 1).count() > MAX_NEEDLES:
        raise ValueError(f"at most {MAX_NEEDLES} needles in one request")
    t = documents.select(*key, collapsed(text).alias("_t"))
    n = F.broadcast(needles.select("needle_id", F.trim(collapsed(F.col("needle"))).alias("_n")).filter("_n != ''"))
    hay, pin = (F.lower("_t"), F.lower("_n")) if fold else (F.col("_t"), F.col("_n"))
    found = t.join(n, F.contains(hay, pin)).withColumn("position", F.expr("locate(lower(_n), lower(_t))" if fold else "locate(_n, _t)"))
    return found.select("needle_id", *key, "position", around(F.col("_t"), F.col("position"), context).alias("context"))
