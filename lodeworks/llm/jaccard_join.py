"""Near-duplicate join of documents by n-gram Jaccard similarity with Bayesian pruning.

A document is its set of shingles (five words; a text of fewer words is one
shingle). Documents with the same set are one node, whatever their number.

1. Each node gets ``HASHES`` MinHash values, and bands of ``ROWS`` of them; nodes
   that agree on a band are candidates.
2. Candidate pairs are compared value by value, ``STEP`` at a time. With a flat
   prior, after m matches in n values the chance that their similarity reaches the
   threshold is P(Bin(n + 1, t) <= m); pairs under ``TOLERANCE`` are dropped.
   Nodes linked by what is left form families.
3. Within a family all pairs are verified exactly, so that a pair missed by one
   band or pruned is still found if the family holds both. Verified pairs are links.
4. Linked nodes form classes.

No pair leaves its task: blocks of a bucket or family answer with a count of
links and one root for each node, so a family of thousands costs counts, not
rows. Large buckets and families are dealt out as pairs of blocks, and joins on sets,
buckets and families deal the rows of hot keys to several tasks.

Defined results: null text and texts without words have no shingles, no links and
a class of their own rows; repeated rows are copies of each other; the class id is
the least document id of the class (null only if all its ids are); an empty table
gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, Spread, stored, text_of, trimmed, within, without

SHINGLE, HASHES, ROWS, STEP = 5, 128, 4, 16
#: Nodes in a block where signatures are compared, and where texts are; bytes of texts in a block.
BLOCK_SIGS, BLOCK_TEXTS, BLOCK_BYTES = 1024, 256, 1 << 20
#: Family members are broadcast to fetch their texts up to this many (50 bytes each); beyond it both sides are shuffled.
BROADCAST_MEMBERS = 500_000
TOLERANCE = 1e-5
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Rows whose shingle sets stand at once.
SKETCHED = 1024
#: Words whose hashes a worker remembers.
CACHE_WORDS = 200_000


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - size + 1)
    key = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for k in range(min(size, len(h))):
        key = mixed(key * _MULT + h[k : k + n])
    return np.unique(key)


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, HASHES, np.uint32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """``HASHES`` values of 32 bits for each set, none of them empty; works in pieces that stay in the cache."""
    a, b = _permutations()
    out = np.empty((len(sets), HASHES), np.uint32)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(size)
    at = 0
    while at < len(sets):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + 16_384, "right")))
        s = np.concatenate(sets[at:upto])
        low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        fold = low >> np.uint32(15)
        starts = np.cumsum(size[at:upto]) - size[at:upto]
        for j in range(HASHES):
            out[at:upto, j] = np.minimum.reduceat((low * a[j] + b[j]) ^ fold, starts)
        at = upto
    return out


@cache
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For n = STEP, 2 STEP, ...: the fewest matches that keep a pair."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p = np.array([1.0])
        for _ in range(n + 1):
            p = np.convolve(p, [1 - threshold, threshold])
        out.append(int(np.searchsorted(np.cumsum(p), tolerance)))
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of signatures are kept, comparing values incrementally."""
    alive, matches = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.uint8)
    for step, least in enumerate(least_matches(threshold, TOLERANCE)):
        left = np.count_nonzero(alive)
        if not left:
            break
        cut = range(step * STEP, (step + 1) * STEP)
        if left * 8 > alive.size:
            for h in cut:
                matches += a[:, h, None] == b[None, :, h]
        else:
            i, j = np.nonzero(alive)
            for h in cut:
                matches[i, j] += a[i, h] == b[j, h]
        alive &= matches >= least
    return alive


def roots(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least member of each row's component."""
    root = np.arange(n)
    i, j = pairs
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def common(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exact, through products of 0/1 matrices over the shingles that both sides hold."""
    ids, at = np.unique(np.concatenate([*sets_a, *sets_b]), return_inverse=True)
    row_a = np.repeat(np.arange(len(sets_a)), [len(x) for x in sets_a])
    row_b = np.repeat(np.arange(len(sets_b)), [len(x) for x in sets_b])
    at_a, at_b = at[: len(row_a)], at[len(row_a) :]
    shared = (np.bincount(at_a, minlength=len(ids)) > 0) & (np.bincount(at_b, minlength=len(ids)) > 0)
    new = np.cumsum(shared) - 1
    ka, kb = shared[at_a], shared[at_b]
    row_a, at_a, row_b, at_b = row_a[ka], new[at_a[ka]], row_b[kb], new[at_b[kb]]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    row_a, at_a, row_b, at_b = row_a[order_a], at_a[order_a], row_b[order_b], at_b[order_b]
    out = np.zeros((len(sets_a), len(sets_b)), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        x, y = np.zeros((len(sets_a), width), np.float32), np.zeros((len(sets_b), width), np.float32)
        i, j = np.searchsorted(at_a, [lo, lo + width])
        x[row_a[i:j], at_a[i:j] - lo] = 1
        i, j = np.searchsorted(at_b, [lo, lo + width])
        y[row_b[i:j], at_b[i:j] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _id (hash of the text), node (hash of the shingle set; null if empty), sig (MinHash values as bytes)."""
    t = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), F.xxhash64(text_of(text)).alias("_id"))
    kind = t.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        # Batches hold as many rows whatever their texts; sets of a part of them stand at once.
        for b in (x.slice(at, SKETCHED) for x in batches for at in range(0, x.num_rows, SKETCHED)):
            sets = [shingles(x.as_py(), words) for x in b.column(1)]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            found = iter(minhash([s for s in sets if len(s)]))
            sigs = [next(found).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["_key", "_id", "node", "sig"])

    return t.mapInArrow(trimmed(run), f"_key {kind}, _id long, node binary, sig binary")


def dealt(members: DataFrame, group: str, payload: list[str], block: int) -> DataFrame:
    """Members of groups of two or more (group, _n, _bytes, payload) as (unit, side, payload): a unit is a pair of blocks of a group.

    A member of block b stands in the units of all pairs with b; ``side`` is 0 in
    the first block of the pair, 1 in the second, 2 if the blocks are the same.
    """
    t = members.withColumn("_blocks", F.ceil(F.greatest(F.col("_n") / block, F.col("_bytes") / BLOCK_BYTES)).cast("int"))
    t = t.withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda o: F.struct(
            F.least("_b", o).alias("x"), F.greatest("_b", o).alias("y"),
            F.when(o == F.col("_b"), 2).when(F.col("_b") < o, 0).otherwise(1).alias("side"),
        ),
    )
    t = t.select(group, F.explode(pairs).alias("_p"), *payload)
    return t.select(F.xxhash64(group, "_p.x", "_p.y").alias("unit"), F.col("_p.side").alias("side"), *payload)


def by_units(units: DataFrame, answer: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``answer`` of tables that hold whole units, in order of unit and node.

    A partition's units come sorted and in batches, so that thousands of small
    units cost one call; the last unit of a batch waits for its rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            unit = t.column("unit").to_numpy()
            last = int(np.searchsorted(unit, unit[-1], "left"))
            if last:
                yield answer(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield answer(held)

    return units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(trimmed(run), schema)


def _runs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units begin, their sizes, and the rows' sides."""
    unit = t.column("unit").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    return first, np.diff(np.append(first, len(unit))), t.column("side").to_numpy()


def _edges(node: list[bytes], root: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    own = np.flatnonzero(root != np.arange(len(root)))
    return [node[i] for i in own], [node[i] for i in root[own]]


def probable_edges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, root) edges that span the nodes whose signatures probably reach the threshold."""
    width = 4 * ROWS
    band = lambda i: F.xxhash64(i, F.substr(F.col("sig"), i * width + 1, F.lit(width)))
    rows = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), band)).alias("bucket"))
    size = rows.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    size = stored(size.withColumn("_bytes", F.lit(0)), "bucket-sizes")
    met = stored(Spread(size, "bucket", "_n", "hot-buckets").join(rows, size), "buckets").join(nodes.select("node", "sig"), "node")
    least = least_matches(threshold, TOLERANCE)

    def compare(t: pa.Table) -> pa.RecordBatch:
        first, size, side = _runs(t)
        node = t.column("node").to_pylist()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(node), HASHES)
        left, right = [], []
        # Small units of one block: all their pairs at once, by size.
        whole = np.add.reduceat(side == 2, first) == size
        small = whole & (size <= 64)
        for n in np.unique(size[small]):
            x, y = np.triu_indices(n, 1)
            at = first[small & (size == n)][:, None]
            left.append((at + x).ravel())
            right.append((at + y).ravel())
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        kept_i, kept_j = [], []
        for at in range(0, len(i), 65_536):
            x, y = i[at : at + 65_536], j[at : at + 65_536]
            m = np.zeros(len(x), np.int64)
            for k in range(len(least)):
                cut = slice(k * STEP, (k + 1) * STEP)
                m += (sig[x, cut] == sig[y, cut]).sum(1)
                ok = m >= least[k]
                x, y, m = x[ok], y[ok], m[ok]
            kept_i.append(x)
            kept_j.append(y)
        for at, n, one in zip(first[~small], size[~small], whole[~small], strict=True):
            rows = np.arange(at, at + n)
            a, b = (rows, rows) if one else (rows[side[at : at + n] == 0], rows[side[at : at + n] == 1])
            if len(a) and len(b):
                x, y = np.nonzero(surviving(sig[a], sig[b], threshold))
                kept_i.append(a[x])
                kept_j.append(b[y])
        pairs = tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (kept_i, kept_j))
        edges = _edges(node, roots(len(node), pairs))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in edges], ["node", "root"])

    return by_units(dealt(met, "bucket", ["node", "sig"], BLOCK_SIGS), compare, "node binary, root binary").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node that each node of an edge is joined to.

    Alternates each node's least neighbour with a hop to that one's own root, and
    ends when nothing changes; every round is a table in the shared folder.
    """
    both = stored(edges.select("node", "root").union(edges.select("root", "node")).toDF("node", "other").distinct(), f"{name}-edges")
    spread = Spread(both.groupBy("other").agg(F.count("*").alias("n")), "other", "n", f"{name}-hubs")
    dealt_out = stored(spread.rows(both), f"{name}-dealt") if spread.any else both
    state = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), f"{name}-roots")
    while True:
        far = state.withColumnsRenamed({"node": "other", "root": "far"})
        near = (dealt_out.join(spread.facts(far), ["other", "_part"]) if spread.any else both.join(far, "other")).groupBy("node").agg(F.min("far").alias("far"))
        step = stored(state.join(near, "node").select("node", F.least("root", "far").alias("new"), "root"), f"{name}-steps")
        hop = step.select(F.col("node").alias("new"), F.col("new").alias("_f"))
        step = Spread(step.groupBy("new").agg(F.count("*").alias("n")), "new", "n", f"{name}-hot").join(step, hop).select("node", F.least("new", "_f").alias("new"), "root")
        step = stored(step, f"{name}-roots")
        state = step.select("node", F.col("new").alias("root"))
        if step.filter("new != root").isEmpty():
            return state


def links(member: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links, texts): exact links within families, in parts by block pair, and edges that span them.

    ``links`` counts documents, ``texts`` different shingle sets. ``member`` has
    node, family, _copies and _text.
    """
    size = stored(member.groupBy("family").agg(F.count("*").alias("_n"), F.sum(F.octet_length("_text")).alias("_bytes")).filter("_n > 1"), "family-sizes")
    units = dealt(Spread(size, "family", "_n", "hot-families").join(member, size), "family", ["node", "_copies", "_text"], BLOCK_TEXTS)

    def verify(t: pa.Table) -> pa.RecordBatch:
        words = _Words()
        first, sizes, side = _runs(t)
        node, copies = t.column("node").to_pylist(), t.column("_copies").to_numpy()
        n, texts, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.arange(len(node))
        for at, many in zip(first, sizes, strict=True):
            rows, own = np.arange(at, at + many), side[at : at + many]
            same = bool((own == 2).any())
            a, b = (rows, rows) if same else (rows[own == 0], rows[own == 1])
            if not len(a) or not len(b):
                continue
            sets = dict(zip(rows, (shingles(x, words) for x in t.column("_text").slice(at, many).to_pylist()), strict=True))
            size = {k: len(v) for k, v in sets.items()}
            size_a, size_b = (np.array([size[k] for k in x]) for x in (a, b))
            inter = common([sets[k] for k in a], [sets[k] for k in b])
            linked = inter >= threshold * (size_a[:, None] + size_b[None, :] - inter) - 1e-9
            if same:
                np.fill_diagonal(linked, False)
            else:
                n[b] += copies[a] @ linked
                texts[b] += linked.sum(0)
            n[a] += linked @ copies[b]
            texts[a] += linked.sum(1)
            i, j = np.nonzero(linked)
            root[at : at + many] = at + roots(many, (a[i] - at, b[j] - at))
        own = np.flatnonzero(texts)
        cols = [pa.array([node[k] for k in own], pa.binary()), pa.array([node[k] for k in root[own]], pa.binary()), pa.array(n[own]), pa.array(texts[own])]
        return pa.RecordBatch.from_arrays(cols, ["node", "root", "links", "texts"])

    return by_units(units, verify, "node binary, root binary, links long, texts long")


def joined(docs: DataFrame, *, key: str, text: str, threshold: float) -> DataFrame:
    """As ``join``, with the key as _key and the hash of the text as _id; class ids as _class."""
    with Scratch() as scratch:
        rows = stored(sketch(docs, key, text), "sketch")
        full = rows.filter("node IS NOT NULL")
        nodes = stored(full.groupBy("node").agg(F.first("sig").alias("sig"), F.count("*").alias("_copies"), F.min("_key").alias("_least"), F.min(F.struct("_key", "_id")).alias("_row")), "nodes")
        edges = stored(probable_edges(nodes, threshold), "probable")
        families = components(edges, "families")
        # A text for each node in a family: that of the least row with its shingle set.
        chosen = families.join(nodes.select("node", "_row"), "node")
        chosen = stored(chosen.select("node", F.col("root").alias("family"), F.col("_row._key").alias("_k"), F.col("_row._id").alias("_i")), "members")
        texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
        same = F.col("_key").eqNullSafe(F.col("_k")) & (F.xxhash64(text_of("_text")) == F.col("_i"))
        member = texts.join(F.broadcast(chosen) if within(chosen, BROADCAST_MEMBERS) else chosen, same)
        member = member.dropDuplicates(["node"]).join(nodes.select("node", "_copies"), "node").select("node", "family", "_copies", "_text")
        found = stored(links(stored(member, "member-texts"), threshold), "links")
        counts = found.groupBy("node").agg(F.sum("links").alias("_links"), F.sum("texts").alias("_texts"))
        spanning = found.select("node", "root").filter("node != root").distinct()
        classes = components(spanning, "classes")
        least = classes.join(nodes.select("node", "_least"), "node").groupBy("root").agg(F.min("_least").alias("_class"))
        classed = classes.join(least, "root").select("node", "_class")
        facts = nodes.select("node", "_copies", "_least").join(counts, "node", "left").join(classed, "node", "left")
        facts = facts.select("node", "_copies", F.coalesce("_class", "_least").alias("_class"), F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_texts", F.lit(0)).alias("_texts"))
        # Rows without shingles have no node and need no facts.
        named, bare = rows.select("_key", "_id", "node").filter("node IS NOT NULL"), rows.select("_key", "_id", "node").filter("node IS NULL")
        found = Spread(nodes, "node", "_copies", "hot-nodes").join(named, facts)
        out = found.unionByName(bare, allowMissingColumns=True)
        zero = F.lit(0)
        out = out.select(
            "_key", "_id", "node",
            F.coalesce("_class", "_key").alias("_class"),
            (F.coalesce("_links", zero) + F.coalesce(F.col("_copies") - 1, zero)).cast("long").alias("n_links"),
            F.coalesce("_copies", F.lit(1)).cast("long").alias("n_copies"),
            F.coalesce("_texts", zero).cast("long").alias("n_texts"),
        )
        return scratch.result(out, "join")


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: key, class_id, n_links (documents it is linked to, copies too), n_copies and n_texts (different shingle sets linked to)."""
    out = joined(docs, key=key, text=text, threshold=threshold)
    return out.select(F.col("_key").alias(key), F.col("_class").alias("class_id"), "n_links", "n_copies", "n_texts")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The document of least key (then least hash) of each class; documents without words stay."""
    out = stored(joined(docs, key=key, text=text, threshold=threshold).filter("node IS NOT NULL AND n_links > 0").select("_key", "_id", "_class"), "joined")
    least = out.groupBy("_class").agg(F.min(F.struct("_key", "_id")).alias("_first")).withColumnRenamed("_class", "_of")
    marked = out.join(least, F.col("_class").eqNullSafe(F.col("_of"))).withColumn("_stays", F.struct("_key", "_id").eqNullSafe(F.col("_first")))
    left = without(docs, marked.filter("NOT _stays"), key, text)
    # Rows that repeat a document wholly share key and hash; one of them stays.
    again = stored(marked.filter("_stays").groupBy("_key", "_id").agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated")
    if again.isEmpty():
        return left
    once = without(left, again, key, text, "left_semi")
    return without(left, again, key, text).union(once.dropDuplicates([key, text]))
