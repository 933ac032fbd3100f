"""Text functions as column expressions; Python only where no built-in can say it."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.vocabulary import BACKOFF_MAX_S, BACKOFF_S, CONTEXT_CHARS, DECLINE_REASONS, RETRYABLE_REASONS, SNIPPET_BYTES, TERMINAL_REASONS

#: Unicode white space. Java's own classes miss some of it.
SPACE = r"[\p{IsWhite_Space}]+"
TERM = r"[^\p{L}\p{Nd}]+"


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, ends kept."""
    return F.regexp_replace(c, SPACE, " ")


def content_key(c: Column) -> Column:
    """Identity of a text up to white space; the empty string for a blank text."""
    plain = F.trim(collapsed(c))
    return F.when(plain == "", F.lit("")).otherwise(F.sha2(plain, 256))


def passage_hash(c: Column) -> Column:
    return F.sha2(F.trim(collapsed(c)), 256)


def byte_slice(c: Column, start: Column, end: Column) -> Column:
    """The text in bytes ``start`` to ``end`` of the UTF-8 form."""
    return F.decode(F.substr(F.encode(c, "UTF-8"), start + 1, end - start), "UTF-8")


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def around(c: Column, at: Column, chars: int = CONTEXT_CHARS) -> Column:
    """Characters around a 1-based position."""
    return F.substr(c, F.greatest(F.lit(1), at - chars), F.lit(2 * chars))


def snippet(c: Column, limit: int = SNIPPET_BYTES) -> Column:
    """At most ``limit`` bytes, cut between characters and, past half the limit, between words."""
    plain = F.trim(collapsed(c))
    raw = F.substr(F.encode(plain, "UTF-8"), F.lit(1), F.lit(limit))
    # A cut inside a character leaves its first bytes, which decode to replacements; those go.
    cut = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+$", "")
    # The last space, found in the reversed text; by bytes it must lie beyond half the limit.
    head = F.substring_index(cut, " ", -1)
    kept = F.substr(cut, F.lit(1), F.length(cut) - F.length(head) - 1)
    cut = F.when(F.contains(cut, F.lit(" ")) & (F.octet_length(kept) > limit // 2), kept).otherwise(cut)
    return F.when(F.octet_length(plain) <= limit, plain).otherwise(F.concat(cut, F.lit("…")))


# Fixed values of mail bodies: the first and last word of a line that tells who wrote, and how long it is; a title between dashes;
# a rule of underscores; a mail's own first two headers; what stands above a signature; and how long a generated link is.
WHO_WROTE, WHO_WROTE_CHARS = ("on", "wrote:"), (14, 129)
TITLE, DASHES, RULE = "original message", "--", "_____"
HEADERS = ("from:", "sent:")
SIGNATURE = "--"
LINK_CHARS = 120


def _introduces(line: Column, after: Column) -> Column:
    """Whether a quoted mail begins at a line, which is told by its words, or stands there whole with its headers."""
    words = lambda c: F.split(F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t"))), "[ \t]+")
    own, next_ = words(line), words(after)
    text = F.array_join(own, " ")
    header = lambda w, name: (F.get(w, 0) == name) & (F.size(w) > 1)
    return (
        (header(own, HEADERS[0]) & header(next_, HEADERS[1]))
        | ((F.get(own, 0) == WHO_WROTE[0]) & (F.element_at(own, -1) == WHO_WROTE[1]) & F.length(text).between(*WHO_WROTE_CHARS))
        | (F.startswith(text, F.lit(RULE)) & (F.btrim(text, F.lit(RULE[0])) == ""))
        | (F.startswith(text, F.lit(DASHES)) & F.endswith(text, F.lit(DASHES)) & (F.btrim(text, F.lit(DASHES[0] + " ")) == TITLE))
    )


def _upto(lines: Column, ends: Column) -> Column:
    """The lines before the first one marked in ``ends``."""
    at = F.array_position(ends, True).cast("int")
    return F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)


def _unquoted(line: Column) -> Column:
    """Without marks of quotation and one blank behind them."""
    body = F.ltrim(line, F.lit(" \t"))
    said = F.ltrim(body, F.lit(">"))
    said = F.when(F.substr(said, F.lit(1), F.lit(1)).isin(" ", "\t"), F.substr(said, F.lit(2))).otherwise(said)
    return F.when(F.startswith(body, F.lit(">")), said).otherwise(line)


def _unlinked(line: Column) -> Column:
    """Without links whose part behind the scheme has ``LINK_CHARS`` characters or more."""
    def rest(part: Column) -> Column:
        link = F.regexp_extract(part, r"^https?://([^\s\])>]*)", 1)
        scheme = F.position(F.lit("://"), part) + 2
        return F.when(F.length(link) >= LINK_CHARS, F.substr(part, scheme + F.length(link) + 1)).otherwise(part)

    return F.when(F.contains(line, F.lit("://")), F.array_join(F.transform(F.split(line, "(?=https?://)"), rest), "")).otherwise(line)


def compact(c: Column) -> Column:
    """A mail body without quoted mails, signature, marks of quotation and generated links; the words left are the author's.

    Works line by line; of several empty lines in a row one stays.
    """
    lines = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    own = _upto(lines, F.transform(lines, lambda x, i: _introduces(x, F.get(lines, i + 1))))
    own = _upto(own, F.transform(own, lambda x: F.rtrim(x, F.lit(" \t")) == SIGNATURE))
    own = F.transform(own, lambda x: F.regexp_replace(_unlinked(_unquoted(x)), "[ \t][ \t]+", " "))
    own = F.filter(own, lambda x, i: (x != "") | (i == 0) | (F.get(own, i - 1) != ""))
    text = F.array_join(F.transform(own, lambda x: F.rtrim(x, F.lit(" \t"))), "\n")
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


class _Plain(HTMLParser):
    """Text of a page: breaks at blocks, tabs at cells, nothing of scripts, styles and the head."""

    BREAKS = frozenset(("br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6"))
    HIDDEN = frozenset(("script", "style", "head"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden.clear()
        elif not self.hidden:
            self.out.append("\n" if tag in self.BREAKS else "\t" if tag in ("td", "th") else "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in self.HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _Plain()
    parser.feed(page)
    parser.close()
    return "".join(parser.out)


@F.pandas_udf(T.StringType())
def strip_html(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)


def storable(c: Column) -> Column:
    """Without NUL, and valid UTF-8."""
    return F.make_valid_utf8(F.replace(c, F.lit("\0"), F.lit("")))


def normal_address(c: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(c), "^<", ""), ">$", "")
    return F.lower(F.trim(inner))


def sender_domain(c: Column) -> Column:
    """What stands after the last @."""
    return F.split_part(c, F.lit("@"), F.lit(-1))


def valid_domain(c: Column) -> Column:
    label = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return (F.length(c) <= 253) & F.rlike(c, F.lit(rf"^{label}(?:\.{label})*$"))


def bare_mime(c: Column) -> Column:
    return F.trim(F.split_part(c, F.lit(";"), F.lit(1)))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9_+-]{1,10})$", 1))


def last_component(name: Column) -> Column:
    return F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)


def location(own_path: Column, name: Column, container_path: Column, container_name: Column) -> Column:
    """Where a document can be looked up: its own path, else its name in its container."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when(blank(own_path) != "", own_path)
        .when(blank(container_path) != "", F.concat(name, F.lit(" in "), container_path))
        .when(blank(container_name) != "", F.concat(name, F.lit(" in "), container_name))
        .otherwise(name)
    )


def title(subject: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(subject, F.lit("")), filename)


def automation_class(h: Column) -> Column:
    """Class of a message from a map of lower-cased header names to values.

    A report outranks a list, a list an automatic answer, that bulk mail.
    """
    value = lambda k: F.trim(F.coalesce(F.element_at(h, k), F.lit("")))
    kind = F.lower(value("content-type"))
    sender = F.regexp_extract(F.lower(value("from")), r"([a-z-]+)@[^@>\s]*>?\s*$", 1)
    report = F.rlike(kind, F.lit(r"^message/(delivery-status|disposition-notification)\b"))
    report = report | F.rlike(kind, F.lit(r"^multipart/report\b.*report-type=\"?(delivery-status|disposition-notification)"))
    report = report | sender.isin("mailer-daemon", "mail-daemon", "postmaster")
    report = report | (F.map_contains_key(h, "return-path") & value("return-path").isin("", "<>"))
    listed = (value("list-id") != "") | (value("list-unsubscribe") != "")
    auto = F.lower(value("auto-submitted"))
    bulk = F.lower(value("precedence")).isin("bulk", "list", "junk", "auto_reply")
    return (
        F.when(report, "delivery_status").when(listed, "mailing_list")
        .when((auto != "") & ~F.startswith(auto, F.lit("no")), "auto_submitted").when(bulk, "bulk").otherwise("human")
    )


def list_id(c: Column) -> Column:
    """The identifier in the last angle brackets, or the whole value."""
    inner = F.regexp_extract(c, r"<([^<>]+)>[^<]*$", 1)
    return F.lower(F.trim(F.when(inner != "", inner).otherwise(c)))


def reason_class(c: Column) -> Column:
    return (
        F.when(c.isin(*DECLINE_REASONS), "expected_decline").when(c.isin(*RETRYABLE_REASONS), "retryable")
        .when(c.isin(*TERMINAL_REASONS), "terminal").otherwise("operator_decision")
    )


def backoff_seconds(attempts: Column, jitter: Column | float = 1.0) -> Column:
    """The wait before another attempt; ``jitter`` in 0 to 1 spreads it over its later half, so that jobs that failed together come back apart."""
    share = F.lit(0.5) + (F.lit(jitter) if isinstance(jitter, float) else jitter) / 2
    return share * F.least(F.lit(float(BACKOFF_MAX_S)), F.lit(float(BACKOFF_S)) * F.pow(F.lit(2.0), attempts - 1))


def clean_query(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"^[-*0-9. \t]+", ""))


def text_density(c: Column, pages: Column) -> Column:
    """Letters and digits a page."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "")) / pages


def enough_words(c: Column) -> Column:
    """Five words of four letters or more, digits aside."""
    return F.size(F.regexp_extract_all(F.regexp_replace(c, r"\p{Nd}", ""), F.lit(r"\p{L}{4,}"), F.lit(0))) >= 5


def viable_image(size: Column, width: Column, height: Column) -> Column:
    return (size >= 8192) & (width >= 200) & (height >= 200) & (width * height >= 40_000)


def component_id(parent: Column, selector: Column) -> Column:
    """An identifier in UUID form that depends on parent and selector alone (version 4 bits over a SHA-1)."""
    h = F.sha1(F.concat_ws("\n", parent, selector).cast("binary"))
    nibble = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1).cast("int"))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), nibble, part(18, 3), F.lit("-"), part(21, 12))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine, not below 0; null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TERM), lambda t: t != "")
