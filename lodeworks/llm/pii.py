"""Personal data by weak supervision.

Patterns propose spans of four kinds (email, ip, card, phone). Those of the base
patterns that pass their check are base spans and always stay. Looser patterns
propose more: addresses spelled with [at] and [dot], and grouped phone numbers
without a plus sign.

Four labelers vote for, against or abstain on each span: the strict pattern with
its check, a gazetteer (top-level domains, country codes, issuer prefixes, routed
networks), the words before the span, and the span's form. Expectation-
maximisation over the vote patterns estimates how reliable each labeler is and how
likely each pattern is personal data; a logistic model per kind is then trained on
those probabilities and alone decides on spans beyond the base ones. The votes and forms have a fixed number
of values, so the counts that both are fitted on have at most ``MAX_PATTERNS``
rows, whatever the corpus.

Defined results: null text is the empty text; an empty table gives an empty result
and a model of priors; repeated rows are answered alike; other columns are neither
read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import let, running, text_of

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive quantifiers and the look-behind (or the end of the
#: match before) give the same matches in time linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[({](?:at|AT)[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?)[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.\x2D/=])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z@/=-]|\.[0-9])"

# Gazetteers and context words.
TLDS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "ca", "au", "ch", "at", "be", "br", "cn", "in", "jp", "mx", "pl", "pt", "ru", "se")
COUNTRY_CODES = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|2[1-689][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|85[0-9]|88[06]|96[0-9]|97[0-9]|99[2-8])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
BEFORE = {
    "email": r"(?:mail|contact|write|reach|address|kontakt|correo|courriel|from|cc)\W{0,3}(?:\w+\W+){0,3}$",
    "ip": r"(?:\bip|host|server|client|addr|address|login|from|peer)\W{0,3}(?:\w+\W+){0,3}$",
    "card": r"(?:card|visa|mastercard|amex|credit|payment|pay|tarjeta|karte|carte)\W{0,3}(?:\w+\W+){0,3}$",
    "phone": r"(?:phone|tel|call|mobile|cell|fax|whatsapp|sms|telefon|tel[eé]fono|t[eé]l[eé]phone)\W{0,3}(?:\w+\W+){0,3}$",
}
AGAINST = r"(?:version|\bv|isbn|issn|order|invoice|section|figure|\bfig|table|chapter|build|release|serial|part|page|no|doi)[.:#]?\s{0,2}$"
CONTEXT = 48
VOTES = 4
#: What is held of a labeler before any data, as counts (given personal data, given none) of its votes: right four times in five, the strict check 19 in 20.
START = [{"+": (9.5, 0.5), "-": (0.5, 9.5), "0": (5.0, 5.0)}] + [{"+": (8.0, 2.0), "-": (2.0, 8.0), "0": (5.0, 5.0)}] * (VOTES - 1)
MAX_PATTERNS = len(KINDS) * 2 * 3**VOTES * 4


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + d

    return (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10) == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets_pass(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def base_check(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets_pass(m)
    digits = F.length(_digits(m))
    return (digits.between(14, 19) & luhn(_digits(m))) if kind == "card" else digits.between(10, 15)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, m, before) of the leftmost non-overlapping matches, in code points; ``before`` is the ``CONTEXT`` characters before."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = let(matches, lambda ms: F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))))
    last = lambda c: F.right(c, F.lit(CONTEXT))

    def placed(pairs: Column) -> Column:
        starts = running(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["m"])), lambda a, b: a + b, F.lit(0))
        # A match has five characters or more, so as many pairs hold the context.
        parts = F.transform(pairs, lambda x, i: F.concat(F.coalesce(last(F.get(pairs, i - 1)["m"]), F.lit("")), last(x["gap"])))
        many = CONTEXT // 5 + 1
        before = lambda p, i: last(F.array_join(F.slice(p, F.greatest(i - many + 2, F.lit(1)), F.least(i + 1, F.lit(many))), ""))

        def span(x: Column, at: Column, p: Column, i: Column) -> Column:
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), before(p, i).alias("before"))

        return let(starts, lambda at: let(parts, lambda p: F.transform(pairs, lambda x, i: span(x, F.get(at, i), p, i))))

    return let(both, placed)


def _vote(positive: Column, negative: Column | None = None) -> Column:
    v = F.when(positive, F.lit("+"))
    return v.otherwise("-") if negative is None else v.when(negative, F.lit("-")).otherwise("0")


def votes(kind: str, x: Column, strict: bool) -> Column:
    m = x["m"]
    digits = _digits(m)
    regex = _vote(base_check(kind, m)) if strict else F.lit("0")
    if kind == "email":
        known = F.lower(F.regexp_extract(m, r"[A-Za-z0-9-]+$", 0)).isin(*TLDS)
        gazetteer, form = _vote(known), _vote(F.rlike(m, F.lit("^[^@\\[({]*[A-Za-z0-9]")))
    elif kind == "ip":
        gazetteer, form = _vote(~F.rlike(m, F.lit(r"^(?:0|127|255)\."))), _vote(~F.rlike(m, F.lit(r"(?:^|\.)0[0-9]")))
    elif kind == "card":
        gazetteer, form = _vote(F.rlike(digits, F.lit(ISSUERS))), _vote(F.rlike(m, F.lit(r"^(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,4})?)$")))
    else:
        plus = F.startswith(m, F.lit("+"))
        gazetteer = F.when(~plus, F.lit("0")).otherwise(_vote(F.rlike(digits, F.lit(COUNTRY_CODES.replace(r"\+", "")))))
        form = _vote(F.length(digits).between(10, 13))
    context = let(F.lower(x["before"]), lambda b: _vote(F.rlike(b, F.lit(BEFORE[kind])), F.rlike(b, F.lit(AGAINST))))
    return F.concat(regex, gazetteer, context, form)


def _proposal(kind: str, strict: bool) -> Callable[[Column], Column]:
    k = KINDS.index(kind)

    def one(x: Column) -> Column:
        size = F.least(F.floor((x["end"] - x["start"]) / 8), F.lit(3)).cast("string")
        base = base_check(kind, x["m"]) if strict else F.lit(False)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind"), base.alias("base"),
            F.concat(F.lit(f"{k}{int(strict)}"), votes(kind, x, strict), size).alias("pattern"),
        )

    return one


def proposals(text: Column) -> Column:
    """Array of (start, end, kind, base, pattern) in order; ``pattern`` is kind, votes and a class of length."""
    none = F.array().cast("array<struct<start:int,end:int,kind:int,base:boolean,pattern:string>>")
    at, plus = F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    long_number = F.rlike(text, F.lit(CARD))
    parts = []
    for kind, pattern, strict, may in (
        ("email", EMAIL, True, at), ("ip", IP, True, F.rlike(text, F.lit(IP))), ("card", CARD, True, long_number), ("phone", PHONE, True, plus),
        ("email", LOOSE_EMAIL, False, F.rlike(text, F.lit(r"[\[({](?:at|AT)[\])}]"))), ("phone", LOOSE_PHONE, False, F.rlike(text, F.lit(LOOSE_PHONE))),
    ):
        parts.append(F.when(may, F.transform(located(text, pattern), _proposal(kind, strict))).otherwise(none))

    def apart(every: Column) -> Column:
        """Without looser spans that overlap a base span: they say nothing of their own."""
        base = F.filter(every, lambda x: x["base"])
        ends = running(F.transform(every, lambda x: F.when(x["base"], x["end"]).otherwise(0)), F.greatest, F.lit(0))
        nth = running(F.transform(every, lambda x: x["base"].cast("int")), lambda a, b: a + b, F.lit(0))
        # Of the base spans that start later the next one starts first.
        free = lambda x, i, b, e, n: (F.get(e, i) <= x["start"]) & F.coalesce(F.get(b, F.get(n, i))["start"] >= x["end"], F.lit(True))
        return let(base, lambda b: let(ends, lambda e: let(nth, lambda n: F.filter(every, lambda x, i: x["base"] | free(x, i, b, e, n)))))

    return let(F.sort_array(F.concat(*parts)), lambda every: F.when(F.forall(every, lambda x: x["base"]), every).otherwise(apart(every)))


@dataclass(frozen=True)
class Model:
    """``prior`` and ``reliable[kind][labeler][vote]`` = (given personal data, given none); ``weights`` of the classifier."""

    prior: dict[int, float]
    reliable: dict[int, list[dict[str, tuple[float, float]]]]
    weights: dict[int, dict[str, float]]

    def probability(self, pattern: str) -> float:
        w = self.weights[int(pattern[0])]
        return 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in features(pattern))))


def features(pattern: str) -> list[str]:
    return ["bias", f"strict{pattern[1]}", f"size{pattern[-1]}", *(f"{j}{v}" for j, v in enumerate(pattern[2:-1]))]


def fit(counts: dict[str, int], rounds: int = 40, steps: int = 400) -> Model:
    """EM on counts of vote patterns, then a logistic model on its posteriors.

    Priors keep it from turning over: each labeler starts at ``START`` and is held by it.
    """
    prior, reliable, weights = {}, {}, {}
    for k in range(len(KINDS)):
        own = {p: n for p, n in counts.items() if int(p[0]) == k}
        pi = 0.5
        rel = [{v: (a / 10, b / 10) for v, (a, b) in start.items()} for start in START]
        post: dict[str, float] = {}
        for _ in range(rounds):
            for p in own:
                yes, no = math.log(pi), math.log(1 - pi)
                for j, v in enumerate(p[2:-1]):
                    yes, no = yes + math.log(rel[j][v][0]), no + math.log(rel[j][v][1])
                post[p] = 1 / (1 + math.exp(min(700.0, no - yes)))
            total, good = sum(own.values()), sum(n * post[p] for p, n in own.items())
            pi = (good + 5) / (total + 10)
            for j in range(VOTES):
                held = {v: (sum(n * post[p] for p, n in own.items() if p[2 + j] == v), sum(n * (1 - post[p]) for p, n in own.items() if p[2 + j] == v)) for v in "+-0"}
                rel[j] = {v: ((held[v][0] + START[j][v][0]) / (good + 15), (held[v][1] + START[j][v][1]) / (total - good + 15)) for v in "+-0"}
        names = sorted({f for p in own for f in features(p)})
        w = dict.fromkeys(names, 0.0)
        total = sum(own.values()) or 1
        for _ in range(steps):
            grad = {f: 0.02 * w[f] for f in names}
            for p, n in own.items():
                fs = features(p)
                err = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in fs))))) - post[p])
                for f in fs:
                    grad[f] += err
            for f in names:
                w[f] -= 0.8 * grad[f]
        prior[k], reliable[k], weights[k] = pi, rel, w
    return Model(prior, reliable, weights)


def pattern_counts(found: DataFrame, column: str = "_found") -> dict[str, int]:
    """Counts of the vote patterns: at most ``MAX_PATTERNS`` rows come to the driver."""
    t = found.select(F.explode(F.transform(column, lambda x: x["pattern"])).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return {r["p"]: r["n"] for r in t.limit(MAX_PATTERNS).collect()}


def accepted(found: Column, model: Model, least: float = 0.9) -> Column:
    """Base spans, and the spans that the classifier gives ``least`` or more."""

    def likely(x: Column) -> Column:
        p, k = x["pattern"], x["kind"]
        score = F.lit(0.0)
        for kind, w in model.weights.items():
            own = F.lit(w.get("bias", 0.0))
            parts = [(F.substr(p, F.lit(2), F.lit(1)), "strict"), (F.substr(p, F.length(p), F.lit(1)), "size")]
            parts += [(F.substr(p, F.lit(3 + j), F.lit(1)), str(j)) for j in range(VOTES)]
            for c, name in parts:
                known = {f[len(name):]: v for f, v in w.items() if f.startswith(name) and len(f) == len(name) + 1}
                for value, v in known.items():
                    own = own + F.when(c == value, v).otherwise(0.0)
            score = F.when(k == kind, own).otherwise(score)
        return score >= math.log(least / (1 - least))

    return F.filter(found, lambda x: x["base"] | likely(x))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with spans, which stand in order, replaced by their kind in brackets; spans that overlap go together, by the kind of the first."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def regions(xs: Column) -> Column:
        """(start, end of the region before, kind) of the runs of overlapping spans, then the end of the last."""
        ends = running(F.transform(xs, lambda x: x["end"]), F.greatest, F.lit(0))
        first = lambda e: F.filter(F.transform(xs, lambda x, i: F.struct(x["start"].alias("start"), F.get(e, i).alias("upto"), x["kind"].alias("kind"))), lambda r: r["start"] >= r["upto"])
        return let(ends, first)

    def rebuilt(rs: Column, end: Column) -> Column:
        # Cutting from the whole text counts its characters anew, so cut parts of some regions first.
        each = F.ceil(F.sqrt(F.size(rs))).cast("int")

        def part(own: Column) -> Column:
            lo, hi = F.get(own, 0)["upto"], F.element_at(own, -1)["start"]
            cut = lambda t: F.transform(own, lambda r: F.concat(F.substr(t, r["upto"] - lo + 1, r["start"] - r["upto"]), F.element_at(tags, r["kind"] + 1)))
            return F.array_join(let(F.substr(text, lo + 1, hi - lo), cut), "")

        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(rs) / each).cast("int") - 1), lambda k: let(F.slice(rs, k * each + 1, each), part))
        return F.concat(F.array_join(blocks, ""), F.substr(text, end + 1))

    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(let(regions(spans), lambda rs: rebuilt(rs, last)))


def fit_documents(docs: DataFrame, *, text: str = "text") -> Model:
    return fit(pattern_counts(docs.select(proposals(text_of(text)).alias("_found"))))


def redact(docs: DataFrame, *, text: str = "text", least: float = 0.9) -> DataFrame:
    """The documents with the spans found in their texts replaced; null texts stay null, other columns as they are."""
    model = fit_documents(docs, text=text)
    # In steps, so that each is a plan of bearable depth.
    t = docs.select(F.struct(*docs.columns).alias("row"), text_of(text).alias("text")).withColumn("found", proposals(F.col("text")))
    t = t.withColumn("spans", accepted(F.col("found"), model, least))
    new = F.when(F.col("row")[text].isNotNull(), redacted(F.col("text"), F.col("spans")))
    return t.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
