"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

``P(word | history) = P(class | history) * P(word | class)``. The class factor is a
softmax over ``CLASSES`` whose weights are rows of a hashed table: the word before,
the two before, the words two and three before (skips), and the classes of all
three. The word factor is the class's smoothed unigram. The commonest words and the
end of a text are classes of their own; all other words, seen or not, fall to the
nearest of ``CLUSTERS`` centres of spelling, so every string has a probability.

Counts of all training tokens are a distributed table. The commonest ``HEAD`` tokens
(ties by hash) travel to the workers; the counts of all others come by a join on the
token, so the vocabulary may grow with the corpus. As context every token is itself:
its place in the head, or its own hash.

Training is one pass over all training texts in ``ROUNDS`` synchronised rounds. A hash
of the row deals it to a round and a shard; in a round each shard takes mini-batch
gradient steps from the common weights, and the new common weights are the shards'
own, averaged by how often each touched a row (their changes travel at half precision). Rounds, shards and the order in them
depend on the rows alone, so any cluster gives the same model. The shards and the
table of weights grow with the corpus, up to ``MAX_SHARDS`` and ``MAX_ROWS``, which a
worker can hold.

Defined results: null and empty texts are one end token; an empty table gives an
empty result; without training tokens every word has base probability 1; a null id
counts as the empty text for the fold; repeated rows are scored alike; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, stored

#: Bounds of the model: tokens that travel to workers (17 bytes each), and words that shape the clusters.
HEAD, SHAPED = 1 << 20, 20_000
SINGLES, CLUSTERS = 31, 32
CLASSES = 1 + SINGLES + CLUSTERS
DIMS, BATCH = 256, 4096
#: Rows of weights (256 bytes each): ``ROWS`` up to ``ROW_TOKENS`` training tokens, twice as many for four times the tokens.
ROWS, ROW_TOKENS, MAX_ROWS = 1 << 15, 1 << 25, 1 << 19
ROUNDS, SHARD_TOKENS, MAX_SHARDS = 4, 1 << 22, 4096
#: What workers hold at once: tokens counted, texts.
COUNTED_TOKENS, TEXTS = 2_000_000, 512
RATE, CALM = 4.0, 32.0
#: The end of a text as a token; no word is empty.
END = b""
SMOOTH = 0.1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, size = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        at = np.repeat(np.arange(len(size)), size)
        words, size = words.filter(pa.array(real)), np.bincount(at[real], minlength=len(size))
    return words, size


def hash_of(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# -- classes by spelling --------------------------------------------------------------


def shapes(tokens: list[bytes]) -> np.ndarray:
    """Unit vectors of hashed byte pairs, with the word's edges."""
    data = np.frombuffer(b"".join(b"\x01" + t + b"\x02" for t in tokens), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    pair = (mixed(data[:-1] * np.uint64(256) + data[1:]) % np.uint64(DIMS)).astype(np.int64)
    at = np.repeat(np.arange(len(tokens)), size)
    place = np.arange(size.sum()) + at
    x = np.bincount(at * DIMS + pair[place], minlength=len(tokens) * DIMS).reshape(len(tokens), DIMS).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centres(tokens: list[bytes], weight: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spaced starts; a word's weight is the logarithm of its count."""
    if not tokens:
        return np.zeros((CLUSTERS, DIMS), np.float32)
    x = shapes(tokens)
    c = x[np.linspace(0, len(x) - 1, CLUSTERS).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for k in range(CLUSTERS):
            own = near == k
            if own.any():
                m = (x[own] * weight[own, None]).sum(0)
                c[k] = m / max(1e-9, np.linalg.norm(m))
    return c


class Classes:
    """The class of any token: 0 is the end, then single words, then clusters."""

    def __init__(self, singles: list[bytes], centre: np.ndarray):
        self.singles, self.centre = {t: i + 1 for i, t in enumerate(singles)} | {END: 0}, centre

    def of(self, tokens: list[bytes]) -> np.ndarray:
        out = np.empty(len(tokens), np.uint8)
        for i in range(0, len(tokens), 20_000):
            part = tokens[i : i + 20_000]
            out[i : i + 20_000] = (shapes(part) @ self.centre.T).argmax(1) + 1 + SINGLES
        for i, t in enumerate(tokens):
            if t in self.singles:
                out[i] = self.singles[t]
        return out


# -- counts -----------------------------------------------------------------------------


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) of all training tokens, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        ends = 0

        def told() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.string()).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["token", "c"])

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                held.append(words_of(b.column(0).slice(at, TEXTS))[0])
                if sum(map(len, held)) > COUNTED_TOKENS:
                    yield told()
            ends += b.num_rows
        if held:
            yield told()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends])], ["token", "c"])

    return train.select("_text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def classed(counts: DataFrame, classes: Classes) -> DataFrame:
    """(token, c, cls, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(0).to_pylist()
            cls, h = classes.of(tokens).astype(np.int32), hash_of(tokens).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls), pa.array(h)], ["token", "c", "cls", "hash"])

    return counts.mapInArrow(run, "token binary, c long, cls int, hash long")


def commonest(counts: DataFrame, most: int, tie: str) -> pa.Table:
    """The ``most`` rows of greatest ``c``, ties by ``tie``.

    A histogram of counts with 11 leading bits finds the step in which the last of
    them stands; only that step is sorted.
    """
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.col("c").cast("double"))).cast("int") - 10)
    step = F.call_function("shiftleft", F.call_function("shiftright", F.col("c"), shift), shift)
    tally = counts.groupBy(step.alias("c")).agg(F.count("*").alias("n")).toArrow().to_pydict()
    whole, held = None, 0
    for c, n in sorted(zip(tally["c"], tally["n"], strict=True), reverse=True):
        if held + n > most:
            rest = counts.filter(step == c).orderBy(F.col("c").desc(), tie).limit(most - held).toArrow()
            return rest if whole is None else pa.concat_tables([counts.filter(step >= whole).toArrow(), rest])
        whole, held = c, held + n
    return counts.toArrow()


class Head:
    """The commonest tokens by hash: place, logarithm of count and class."""

    def __init__(self, t: pa.Table):
        h = t.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(h)
        self.hash, self.log, self.cls = h[order], np.log10(t.column("c").to_numpy()[order] + SMOOTH), t.column("cls").to_numpy()[order].astype(np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)


# -- encoding ---------------------------------------------------------------------------


def codes_of(tokens: list[bytes], head: Head, classes: Classes) -> np.ndarray:
    """Places in the head; for others ``HEAD`` and more: 25 bits of hash, then 6 of class."""
    h = hash_of(tokens)
    at = head.find(h)
    tail = np.flatnonzero(at < 0)
    if len(tail):
        c = classes.of([tokens[i] for i in tail]).astype(np.int64)
        at[tail] = HEAD + ((h[tail] >> np.uint64(39)).astype(np.int64) << 6 | c)
    return at.astype(np.uint32)


def encoded(docs: DataFrame, head: Head, classes: Classes) -> DataFrame:
    """Rows of documents with their tokens' codes; tail tokens apart."""
    sent = docs.sparkSession.sparkContext.broadcast((head, classes))
    kind = docs.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes = sent.value
        row = TaskContext.get().partitionId() << 33
        end = codes_of([END], head, classes)[0]
        log = np.append(head.log, 0.0)
        for b in (x.slice(at, TEXTS) for x in batches for at in range(0, x.num_rows, TEXTS)):
            if not b.num_rows:
                continue
            words, size = words_of(b.column(1))
            d = words.dictionary_encode()
            tokens = d.dictionary.cast(pa.binary())
            index = d.indices.to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(size)), size)
            code = np.full(len(index) + len(size), end, np.uint32)
            code[np.arange(len(index)) + text] = codes_of(tokens.to_pylist(), head, classes)[index]
            ends = np.cumsum(size + 1)
            first = ends - size - 1
            inside = code < HEAD
            tail = np.flatnonzero(~inside[np.arange(len(index)) + text])
            pair, n = np.unique(text[tail] * max(1, len(tokens)) + index[tail], return_counts=True)
            cut = np.searchsorted(pair, np.arange(len(size) + 1) * max(1, len(tokens))).astype(np.int32)
            raw = code.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + b.num_rows)), b.column(0), *b.columns[2:], pa.array(size + 1), pa.array(np.add.reduceat(inside.astype(np.int64), first)),
                    pa.array(np.add.reduceat(log[np.where(inside, code, len(log) - 1)], first)), pa.array([raw[4 * x : 4 * y] for x, y in zip(first, ends, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut), tokens.take(pa.array(pair % max(1, len(tokens))))), pa.ListArray.from_arrays(pa.array(cut), pa.array(n.astype(np.int64))),
                ],
                ["row", "_key", "held_out", "_mark", "_shard", "_round", "n_tokens", "inside", "log_head", "ids", "tail", "tail_n"],
            )
            row += b.num_rows

    return docs.select("_key", "_text", "held_out", "_mark", "_shard", "_round").mapInArrow(
        run,
        f"row long, _key {kind}, held_out boolean, _mark long, _shard int, _round int, n_tokens long, inside long, log_head double, ids binary, tail array<binary>, tail_n array<long>",
    )


# -- the model --------------------------------------------------------------------------


def contexts(ids: list[bytes], head_cls: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows (tokens x 5), classes and sizes of the texts' tokens."""
    size = np.array([len(x) // 4 for x in ids])
    code = np.frombuffer(b"".join(ids), np.uint32)
    word, inside = code.astype(np.uint64), code < HEAD
    c = ((code - np.uint32(HEAD)) & np.uint32(63)).astype(np.uint8)
    c[inside] = head_cls[code[inside]]
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(c))
    start = np.uint64(1 << 33)

    def back(x: np.ndarray, k: int, none: np.uint64) -> np.ndarray:
        return np.where(at - k >= first, np.concatenate([np.full(k, none, np.uint64), x[: len(x) - k]])[: len(x)], none)

    w1, w2, w3 = (back(word, k, start) for k in (1, 2, 3))
    c1, c2, c3 = (back(c.astype(np.uint64), k, np.uint64(255)) for k in (1, 2, 3))
    keys = [w1, mixed(w1) ^ w2, w2, w3, (((c1 << np.uint64(8)) | c2) << np.uint64(8)) | c3]
    found = [(mixed(k ^ (np.uint64(j + 1) << np.uint64(56))) % np.uint64(rows)).astype(np.int64) for j, k in enumerate(keys)]
    return np.stack(found, 1), c, size


def exponents(w: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, their exponentials and the sums of these for each token."""
    z = np.take(w, rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        z += np.take(w, rows[:, j], axis=0)
    z += bias
    # Scores are far below what overflows; the batch's greatest is taken off where they are not.
    if (top := z.max()) > 60:
        z -= top
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], e.dtype)


def log_softmax(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Logarithms of the probabilities of the classes ``c``."""
    z, _, total = exponents(w, bias, rows)
    return z[np.arange(len(c)), c] - np.log(np.maximum(total, np.float32(1e-37)))


def step(w: np.ndarray, seen: np.ndarray, bias: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
    """One mini-batch update in place; a row's rate falls with how often it was seen."""
    _, g, total = exponents(w, bias, rows)
    g *= (1 / np.maximum(total, np.float32(1e-37)))[:, None]
    g[np.arange(len(c)), c] -= 1
    # Sums over equal rows: indexed addition is fast in one dimension.
    flat, each = w.reshape(-1), np.arange(CLASSES)
    np.add.at(seen, rows.ravel(), 1)
    for j in range(rows.shape[1]):
        own = rows[:, j]
        np.add.at(flat, (own[:, None] * CLASSES + each).ravel(), (g * (-RATE / (CALM + seen[own])).astype(np.float32)[:, None]).ravel())


def train(rows: DataFrame, bias: np.ndarray, head_cls: np.ndarray, many: int, shards: int) -> np.ndarray:
    """Weights (``many`` x CLASSES) after ``ROUNDS`` rounds over ``rows``, each of which stands in one of them."""
    spark = rows.sparkSession
    block = 128
    w, seen = np.zeros((many, CLASSES), np.float32), np.zeros(many, np.int64)
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast((w, seen))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            shard, w, seen = None, None, None

            def told() -> Iterator[pa.RecordBatch]:
                new, change = seen - sent.value[1], (w - sent.value[0]).astype(np.float16)
                for at in range(0, many, block):
                    if (n := new[at : at + block]).any():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([at]), pa.array([shard]), pa.array([n.tobytes()], pa.binary()), pa.array([change[at : at + block].tobytes()], pa.binary())], ["at", "shard", "n", "w"]
                        )

            for b in batches:
                own = b.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(own, prepend=own[:1])) if len(own) else []
                for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True):
                    if lo == hi:
                        continue
                    if own[lo] != shard:
                        if shard is not None:
                            yield from told()
                        shard, w, seen = int(own[lo]), sent.value[0].copy(), sent.value[1].copy()
                    for at in range(lo, hi, TEXTS):
                        x, c, _ = contexts(b.column(1).slice(at, min(TEXTS, hi - at)).to_pylist(), head_cls, many)
                        for i in range(0, len(c), BATCH):
                            step(w, seen, bias, x[i : i + BATCH], c[i : i + BATCH])
            if shard is not None:
                yield from told()

        def averaged(p: pd.DataFrame) -> pd.DataFrame:
            """The change of one block of rows, of which a shard sends at most one."""
            n, w, by = np.zeros(block), np.zeros((block, CLASSES)), np.zeros(block)
            for _, x, y in sorted(zip(p["shard"], p["n"], p["w"], strict=True)):
                own = np.frombuffer(x, np.int64)
                n, by = n + own, by + (own > 0)
                w += np.frombuffer(y, np.float16).reshape(block, CLASSES) * own[:, None]
            w = (w / np.maximum(n, 1)[:, None]).astype(np.float32)
            return pd.DataFrame({"at": p["at"].iloc[:1], "n": [(n / np.maximum(by, 1)).astype(np.int64).tobytes()], "w": [w.tobytes()]})

        own = rows.filter(F.col("_round") == k).select("_shard", "ids", "_mark").repartition(shards, "_shard").sortWithinPartitions("_shard", "_mark").select("_shard", "ids")
        found = own.mapInArrow(run, "at long, shard long, n binary, w binary").groupBy("at").applyInPandas(averaged, "at long, n binary, w binary")
        w, seen = w.copy(), seen.copy()
        for r in found.toLocalIterator():
            at, n = r["at"], np.frombuffer(r["n"], np.int64)
            w[at : at + block] += np.frombuffer(r["w"], np.float32).reshape(block, CLASSES)
            seen[at : at + block] += n
        sent.destroy()
    return w


def scores(rows: DataFrame, w: np.ndarray, bias: np.ndarray, within: np.ndarray, head_cls: np.ndarray) -> DataFrame:
    """``rows`` without tokens and with class_score: log10 probability of the classes less the log10 sizes of the classes' words."""
    sent = rows.sparkSession.sparkContext.broadcast((w, bias, within, head_cls))
    t = rows.select("ids", "row", "_key", "held_out", "n_tokens", "inside", "log_head")
    names = t.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, within, head_cls = sent.value
        for b in batches:
            out = []
            for at in range(0, b.num_rows, TEXTS):
                x, c, size = contexts(b.column(0).slice(at, TEXTS).to_pylist(), head_cls, len(w))
                p = np.empty(len(c))
                for i in range(0, len(c), BATCH):
                    p[i : i + BATCH] = log_softmax(w, bias, x[i : i + BATCH], c[i : i + BATCH])
                p = p / np.log(10) - within[c]
                out.append(np.add.reduceat(p, np.cumsum(size) - size))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.concatenate(out) if out else np.empty(0))], [*names, "class_score"])

    kind = t.schema["_key"].dataType.simpleString()
    return t.mapInArrow(run, f"row long, _key {kind}, held_out boolean, n_tokens long, inside long, log_head double, class_score double")


def grown(tokens: int) -> tuple[int, int]:
    """Rows of weights and shards for so many training tokens."""
    rows = ROWS
    while rows < MAX_ROWS and tokens >= ROW_TOKENS * (2 * rows // ROWS) ** 2:
        rows *= 2
    return rows, min(MAX_SHARDS, max(1, -(-tokens // SHARD_TOKENS)))


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    with Scratch() as scratch:
        fold = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
        t = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), (fold == 0).alias("held_out"), F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")).alias("_mark"))
        counts = stored(token_counts(t.filter("NOT held_out")), "counts")
        common = commonest(counts, SHAPED, "token").to_pydict()
        words = sorted((-c, t) for t, c in zip(common["token"], common["c"], strict=True) if t != END)
        shaped = words[SINGLES:]
        classes = Classes([t for _, t in words[:SINGLES]], centres([t for _, t in shaped], np.log1p(np.array([-c for c, _ in shaped], float))))
        counts = stored(classed(counts, classes), "classed")
        per = {r["cls"]: r for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
        n = np.array([per[k]["n"] if k in per else 0 for k in range(CLASSES)], float)
        v = np.array([per[k]["v"] if k in per else 0 for k in range(CLASSES)], float)
        bias = np.log((n + SMOOTH) / (n.sum() + SMOOTH * CLASSES)).astype(np.float32)
        within = np.log10(n + SMOOTH * (v + 1))
        total, kinds = int(n.sum()), int(v.sum())
        head = Head(commonest(counts.select("hash", "c", "cls"), HEAD, "hash"))
        many, shards = grown(total)
        part = F.pmod("_mark", F.lit(ROUNDS * shards)).cast("int")
        t = t.withColumn("_shard", (part / ROUNDS).cast("int")).withColumn("_round", F.when(F.col("held_out"), -1).otherwise(part % ROUNDS))
        rows = stored(encoded(t, head, classes), "encoded", by="_round")
        w = train(rows, bias, head.cls, many, shards)
        tail = rows.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("_t")).select("row", F.col("_t.tail").alias("token"), F.col("_t.tail_n").alias("_n"))
        found = tail.join(counts.select("token", "c"), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        found = found.groupBy("row").agg(F.sum(F.col("_n") * F.log10(F.col("c") + SMOOTH)).alias("_log"), F.sum(F.when(F.col("c") > 0, F.col("_n")).otherwise(0)).alias("_known"))
        out = scores(rows, w, bias, within, head.cls).join(found, "row", "left")
        logs = F.col("log_head") + F.coalesce("_log", F.lit(0.0))
        size = float(np.log10(total + SMOOTH * (kinds + 1)))
        out = out.select(
            F.col("_key").alias(key), "held_out", "n_tokens", (F.col("inside") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * size).alias("base_score"), (logs + F.col("class_score")).alias("score"),
        )
        return scratch.result(out, "lm-scores")
