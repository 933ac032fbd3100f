"""Verdicts on URLs by pattern rules that are fetched by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that
every match must hold. Each rule is filed under the one of its tokens that the
fewest URLs hold. The tokens of a URL fetch candidate rules; only those run.

Defined results: a null URL, or one without ``://``, has empty host and path and
can match no rule; a very long URL is judged whole; an empty table gives an empty
result; repeated rows give repeated rows; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import LOWER, UPPER, Scratch, Spread, block_join, stored

#: Up to this many rules the index is a literal in the plan; more are broadcast in blocks of so many (some 200 bytes each).
INLINE_RULES, BLOCK_RULES = 256, 200_000


@dataclass(frozen=True)
class Rule:
    """``rank``: the matching rule of least rank decides."""

    label: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: tuple = ()


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for ``host``, its subdomains, and paths that start with ``path``.

    Longer rules decide before shorter ones.
    """
    whole = re.findall(r"[a-z0-9]+", host.lower())
    # A token of the path is sure to be whole only if the rule's path ends after it.
    whole += re.findall(r"[a-z0-9]+(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", path.lower())
    pattern = rf"(?s)^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}"
    return Rule(host + path, verdict, pattern, tuple(dict.fromkeys(whole)), (0, -len(host + path), -len(host), host))


def pattern_rule(verdict: str, *words: str) -> Rule:
    """A rule for hosts with a label that is ``words`` joined by hyphens."""
    joined = "-".join(words)
    return Rule(None, verdict, rf"(?s)^(?:[^/]*[.])?(?:www[.])?{_quoted(joined)}[.]", tuple(words), (1, joined))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_tokens(host: Column, path: Column) -> Column:
    lowered = F.concat(host, F.translate(path, UPPER, LOWER))
    return F.filter(F.array_distinct(F.split(lowered, "[^a-z0-9]+")), lambda t: t != "")


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs hold each token of the rules; as many rows as the rules have tokens."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r.tokens})], "token string")
    held = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    held = held.join(F.broadcast(wanted), "token", "left_semi") if len(rules) <= INLINE_RULES else held.join(wanted, "token", "left_semi")
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).toLocalIterator()}


def filter_urls(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key``, host, path, rule (the deciding rule's label) and verdict of each page."""
    rules = sorted(rules, key=lambda r: r.rank)
    host, path = split_url(F.col(url))
    urls = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    if not rules:
        return urls.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    counts = token_counts(urls, rules)
    filed = [min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None) for r in rules]
    found = _inline(urls, rules, filed) if len(rules) <= INLINE_RULES else _joined(urls, rules, filed)
    return found.select(key, "host", "path", F.col("_hit.label").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))


def _inline(urls: DataFrame, rules: list[Rule], filed: list[str | None]) -> DataFrame:
    by_token: dict[str, list[int]] = {}
    always = [i for i, t in enumerate(filed) if t is None]
    for i, t in enumerate(filed):
        if t is not None:
            by_token.setdefault(t, []).append(i)
    none = F.array().cast("array<int>")
    fetched = none
    if by_token:
        index = F.create_map(*[x for t, ids in by_token.items() for x in (F.lit(t), F.array(*map(F.lit, ids)))])
        fetched = F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), lambda t: F.coalesce(F.element_at(index, t), none)))
    patterns = F.array(*[F.lit(r.pattern) for r in rules])
    infos = F.array(*[F.struct(F.lit(r.label).cast("string").alias("label"), F.lit(r.verdict).alias("verdict")) for r in rules])
    fetched = F.concat(F.array(*map(F.lit, always)).cast("array<int>"), fetched)
    run = F.filter(fetched, lambda i: F.regexp_like(F.concat("host", "path"), F.element_at(patterns, i + 1)))
    return urls.withColumn("_first", F.array_min(run)).withColumn("_hit", F.when(F.col("_first").isNotNull(), F.element_at(infos, F.col("_first") + 1)))


def _joined(urls: DataFrame, rules: list[Rule], filed: list[str | None]) -> DataFrame:
    """For rule sets of any size: the tokens of each different URL fetch their rules."""
    spark = urls.sparkSession
    rows = [(t or "", i, r.pattern, r.label, r.verdict) for i, (t, r) in enumerate(zip(filed, rules, strict=True))]
    urls = urls.withColumn("_url", F.concat("host", "path"))
    different = urls.groupBy("_url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("_n"))
    tokens = url_tokens(F.col("host"), F.col("path"))
    tokens = tokens if all(filed) else F.concat(F.array(F.lit("")), tokens)
    with Scratch() as scratch:
        index = stored(spark.createDataFrame(rows, "token string, rank long, pattern string, label string, verdict string"), "url-rules")
        asked = stored(different.select("_url", "_n", F.explode(tokens).alias("token")), "url-tokens")
        run = block_join(asked, index, "token", BLOCK_RULES).filter(F.regexp_like("_url", F.col("pattern")))
        best = scratch.result(run.groupBy("_url").agg(F.min(F.struct("rank", "label", "verdict")).alias("_hit"), F.max("_n").alias("_n")), "url-hits")
    return Spread(best, "_url", "_n", "hot-urls").join(urls, best.drop("_n"), "left")
