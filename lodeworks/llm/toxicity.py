"""Toxicity by class-conditional Kneser-Ney models of words in sequence and of their spelling.

Two pairs of models, one for each class: over pairs of words, so that an expression
counts as a whole, and over the bytes of a word between word marks, so that a word
never seen is judged by its parts. N-grams are counted by class in labelled training
texts, those that stand there once too, on which discounts and contexts rest. Each class has an interpolated Kneser-Ney model (token counts at the highest
order, numbers of left contexts below) which backs off half to its own lower order
and half to a model of the pooled counts of both classes, so that a rare expression
weighs little unless one class really prefers it.

A text's evidence is the difference of the toxic and the ordinary log-likelihood, of
spelling per word and per square root of the words and over its ``TOP`` strongest
words (against the logarithm of its length, with which the strongest grow), and of
words in sequence per square root of the words. A logistic curve fitted on training rows whose texts
were not counted turns these into a score.

Fitted on at most about ``max_rows`` labelled rows of ``max_chars`` characters in
all, chosen by a hash of the id; all rows are scored, on their whole texts.

Defined results: null and empty texts get the score of no evidence; documents with
several labels count as toxic if any says so; null labels and null ids are no
labels; very long texts are scored whole; with no labels of a class the score is the training rate (0.5 without
any); an empty table gives an empty result; repeated rows are scored alike; other
columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, discard, stored

MAX_ROWS, MAX_CHARS, ORDER, TOP = 20_000, 200_000_000, 6, 5
#: Bits of a word's hash in a pair.
WORD_BITS = 31
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
FEATURES = 6
#: N-grams that are fetched at a time.
SLICE = 500_000
#: Texts a worker has in hand, and words whose evidence and hash it remembers.
TEXTS, CACHE_WORDS = 256, 200_000


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words, packed into integers with the last byte lowest, and how many each word has."""
    data = np.frombuffer(b"".join(b"\x01" * (ORDER - 1) + w + b"\x02" for w in words), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    key = np.zeros(len(data) - ORDER + 1, np.int64)
    for k in range(ORDER):
        key = (key << 8) | data[k : len(data) - ORDER + 1 + k]
    first = np.cumsum(size + ORDER - 1) - (size + ORDER - 1)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return key[at], size


def hash_of(word: bytes) -> int:
    """Not 0, which stands before the first word."""
    return xxhash.xxh3_64_intdigest(word) % ((1 << WORD_BITS) - 1) + 1


def paired(hashes: np.ndarray) -> np.ndarray:
    """Each word's hash after that of the word before."""
    return np.concatenate([[0], hashes[:-1]]) << WORD_BITS | hashes


def ngram_counts(train: DataFrame) -> DataFrame:
    """(words, key, c0, c1): how often an n-gram of spelling or a pair of words stands in ordinary and in toxic training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 4 * TEXTS) for x in batches for at in range(0, x.num_rows, 4 * TEXTS)):
            for c in range(2):
                seen, pairs = Counter(), []
                for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    if toxic == c and (words := words_of(text.as_py())):
                        seen.update(words)
                        pairs.append(paired(np.fromiter(map(hash_of, words), np.int64, len(words))))
                if not seen:
                    continue
                keys, size = spelled(list(seen))
                keys, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, np.repeat(np.fromiter(seen.values(), float, len(seen)), size)).astype(np.int64)
                for words, (k, m) in enumerate(((keys, n), np.unique(np.concatenate(pairs), return_counts=True))):
                    none = np.zeros_like(m)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), words)), *(pa.array(x) for x in (k, none if c else m, m if c else none))], ["words", "key", "c0", "c1"])

    part = train.select("_text", "_toxic").mapInArrow(run, "words long, key long, c0 long, c1 long")
    return part.groupBy("words", "key").agg(F.sum("c0").cast("int").alias("c0"), F.sum("c1").cast("int").alias("c1"))


def collected(found: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their counts (ordinary, toxic), fetched ``SLICE`` n-grams at a time; their number is bounded by the characters that are fitted on."""
    own = found.filter(F.col("words") == words)
    slices = max(1, -(-own.count() // SLICE))
    keys, counts = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int32)]
    for i in range(slices):
        t = own.filter(F.pmod(F.xxhash64("key"), F.lit(slices)) == i).select("key", "c0", "c1").toArrow()
        keys.append(t.column("key").to_numpy())
        counts.append(np.column_stack([t.column(f"c{c}").to_numpy() for c in range(2)]))
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    return key[order], count[order]


@dataclass
class Order:
    """Of one order, for ordinary, toxic and pooled counts: n-grams and contexts with their counts, sorted, and discounts."""

    keys: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    follows: np.ndarray
    discount: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, n: np.ndarray, bits: int) -> Order:
        contexts, first = np.unique(keys >> bits, return_index=True)
        add = lambda x: np.add.reduceat(x, first, axis=0, dtype=np.int32) if len(first) else np.zeros((0, 3), np.int32)
        one, two = (n == 1).sum(0), (n == 2).sum(0)
        return Order(keys, n, contexts, add(n), add(n > 0), (one + 1) / (one + 2 * two + 2))


@dataclass
class Grams:
    """The class-conditional models of n-grams of symbols of ``bits`` bits.

    ``told``: the ratios of all counted n-grams, so that only others go through the back-off,
    to which none of them has a count of the highest order; those counts are not kept.
    """

    orders: list[Order]
    bits: int
    even: float
    told: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, c: np.ndarray, bits: int, order: int) -> Grams:
        """``keys`` sorted, ``c`` (ordinary, toxic) counts of the highest order."""
        n = np.empty((len(keys), 3), np.int32)
        n[:, :2], n[:, 2] = c, c.sum(1)
        orders = [Order.of(keys, n, bits)]
        have = np.column_stack([c > 0, c.any(1)])
        for k in range(order - 1, 0, -1):
            keys, at = np.unique(keys & ((1 << bits * k) - 1), return_inverse=True)
            # In how many contexts one symbol longer each n-gram stands, by class.
            n = np.column_stack([np.bincount(at, have[:, j], len(keys)) for j in range(3)]).astype(np.int32)
            have = n > 0
            orders.append(Order.of(keys, n, bits))
        model = Grams(orders[::-1], bits, 1 / max(256, len(keys) + 1), np.zeros(0))
        top = model.orders[-1].keys
        model.told = np.concatenate([model.ratios(top[i : i + 50_000]).astype(np.float32) for i in range(0, len(top), 50_000)] or [model.told.astype(np.float32)])
        model.orders[-1] = replace(model.orders[-1], n=np.zeros((0, 3), np.int32))
        return model

    def __getstate__(self) -> dict:
        """Travels with the highest order's n-grams as places of their last symbols, context by context, which is half of their size."""
        top = self.orders[-1]
        last = np.searchsorted(self.orders[0].keys, top.keys & ((1 << self.bits) - 1)).astype(np.uint32)
        return self.__dict__ | {"orders": [*self.orders[:-1], replace(top, keys=last)]}

    def __setstate__(self, state: dict) -> None:
        *lower, top = state["orders"]
        # A context is followed by as many n-grams as follow it in either class.
        keys = np.repeat(top.contexts, top.follows[:, 2]) << state["bits"] | lower[0].keys[top.keys]
        self.__dict__.update(state | {"orders": [*lower, replace(top, keys=keys)]})

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Logarithm of the toxic over the ordinary probability of each n-gram's last symbol."""
        p = np.full((len(keys), 3), self.even)
        for k, o in enumerate(self.orders, 1):
            g = keys & ((1 << self.bits * k) - 1)
            n = _rows(o.n, _find(o.keys, g)) if len(o.n) else np.zeros((len(keys), 3))
            at = _find(o.contexts, g >> self.bits)
            total, follow = _rows(o.totals, at), _rows(o.follows, at)
            each = np.maximum(total, 1)
            mix = lambda lower, n=n, total=total, follow=follow, each=each, d=o.discount: np.where(total > 0, np.maximum(n - d, 0) / each + np.minimum(1, d * follow / each) * lower, lower)
            pooled = mix(p)[:, 2]
            p = mix(np.column_stack([(p[:, 0] + pooled) / 2, (p[:, 1] + pooled) / 2, p[:, 2]]))
        return np.log(np.maximum(p[:, 1], 1e-300)) - np.log(np.maximum(p[:, 0], 1e-300))

    def evidence(self, keys: np.ndarray) -> np.ndarray:
        """As ``ratios``, looked up for n-grams that were counted."""
        top = self.orders[-1].keys
        if not len(top):
            return np.zeros(len(keys))
        at = _find(top, keys)
        out = np.append(self.told, 0)[at]
        new = at == len(top)
        if new.any():
            different, back = np.unique(keys[new], return_inverse=True)
            out[new] = self.ratios(different)[back]
        return out


@dataclass
class Model:
    spelling: Grams
    pairs: Grams

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word's spelling."""
        if not words:
            return np.zeros(0)
        keys, size = spelled(words)
        return np.add.reduceat(self.spelling.evidence(keys), np.cumsum(size) - size)

    def features(self, texts: list[str | None], known: dict[bytes, tuple[float, int]]) -> np.ndarray:
        """A row for each text; ``known`` remembers evidence and hashes between calls."""
        parts = [self._features(texts[i : i + TEXTS], known) for i in range(0, len(texts), TEXTS)]
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES))

    def _features(self, texts: list[str | None], known: dict[bytes, tuple[float, int]]) -> np.ndarray:
        if len(known) > CACHE_WORDS:
            known.clear()
        told = [words_of(t) for t in texts]
        new = list({w for ws in told for w in ws if w not in known})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            known.update(zip(part, zip(self.of_words(part).tolist(), map(hash_of, part), strict=True), strict=True))
        out = np.zeros((len(texts), FEATURES))
        out[:, 0] = 1
        rows = [i for i, ws in enumerate(told) if ws]
        if not rows:
            return out
        size = np.array([len(told[i]) for i in rows])
        seen = [known[w] for i in rows for w in told[i]]
        every = np.fromiter((x[0] for x in seen), float, len(seen))
        hashes = np.fromiter((x[1] for x in seen), np.int64, len(seen))
        first = np.cumsum(size) - size
        keys = paired(hashes)
        keys[first] = hashes[first]
        keys, back = np.unique(keys, return_inverse=True)
        pairs = self.pairs.evidence(keys)[back]
        for i, at, n in zip(rows, first, size, strict=True):
            e = every[at : at + n]
            s, p = e.sum(), pairs[at : at + n].sum()
            out[i, 1:] = s / n, s / np.sqrt(n), np.partition(e, max(0, n - TOP))[-TOP:].sum() / TOP, p / np.sqrt(n), np.log1p(n) / 10
        return out


@dataclass
class Fitted:
    """The model as it was sent to the executors, once for fitting the curve and scoring, and the curve."""

    model: Model
    sent: Broadcast
    curve: np.ndarray


def _rows(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of ``a`` at places that ``_find`` gave, zeros where nothing was found."""
    return np.where((at < len(a))[:, None], a[np.minimum(at, len(a) - 1)], 0)


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in sorted ``keys``, or their number."""
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, len(keys))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised log-likelihood; the constant is not penalised."""
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    pen = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + pen, z.T @ (y - p) - pen @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, *, key: str, label_key: str, label: str, text: str, folds: int, max_rows: int, max_chars: int) -> Fitted:
    """Learns from labelled rows of folds other than 0; fold 1 fits the curve, the others the counts."""
    spark = docs.sparkSession
    known = labels.select(F.col(label_key).alias("_id"), F.col(label).alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL")
    known = known.groupBy("_id").agg((F.max("_label") > 0).cast("int").alias("_toxic"))
    known = known.withColumn("_fold", F.crc32(F.col("_id").cast("string").cast("binary")) % folds).filter("_fold != 0")
    known = stored(known, "labels")
    total = known.count()
    # The expected number is max_rows, with a few in a hundred to spare.
    chance = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20))
    chosen = known.filter(chance < int(min(1.0, max_rows / max(1, total)) * (1 << 20)))
    t = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    t = stored(t, "labelled-texts")
    chars = t.agg(F.sum(F.length("_text"))).first()[0] or 0
    if chars > max_chars:
        t = t.filter(chance < int(min(1.0, max_rows / max(1, total)) * max_chars / chars * (1 << 20)))
    found, parts = stored(ngram_counts(t.filter("_fold != 1")), "ngrams"), []
    for words, (bits, order) in enumerate(((8, ORDER), (WORD_BITS, 2))):
        keys, counts = collected(found, words)
        parts.append(Grams.of(keys, counts, bits, order))
        both = (counts.sum(0) > 0).all()
        del keys, counts
    discard(found)
    rate = t.agg(F.avg("_toxic").alias("r")).first()["r"]
    model = Model(*parts)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, int]] = {}
        for b in batches:
            x = sent.value.features(b.column(0).to_pylist(), known).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    held = t.filter("_fold = 1").select("_text", "_toxic").mapInArrow(run, "x array<double>, y int").toArrow()
    y = held.column("y").to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y) and both:
        curve = logistic(np.array(held.column("x").to_pylist()), y)
    else:
        r = min(max(0.5 if rate is None else float(rate), 1e-6), 1 - 1e-6)
        curve = np.array([np.log(r / (1 - r))] + [0.0] * (FEATURES - 1))
    return Fitted(model, sent, curve)


def score(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label_key: str = "doc_id", label: str = "toxic", text: str = "text", folds: int = 5, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS
) -> DataFrame:
    """One row per document: key, held_out, score and predicted."""
    with Scratch():
        fitted = fit(docs, labels, key=key, label_key=label_key, label=label, text=text, folds=folds, max_rows=max_rows, max_chars=max_chars)
    sent, curve = fitted.sent, fitted.curve
    t = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = t.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, int]] = {}
        for b in batches:
            x = 1 / (1 + np.exp(-np.clip(sent.value.features(b.column(1).to_pylist(), known) @ curve, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64())], ["k", "score"])

    out = t.mapInArrow(run, f"k {kind}, score double")
    fold = F.crc32(F.coalesce(F.col("k").cast("string"), F.lit("")).cast("binary")) % folds
    return out.select(F.col("k").alias(key), (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
