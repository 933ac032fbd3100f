"""Closures over containment graphs of any depth, cycles allowed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.operators.tables import discard, stored
from lodeworks.vocabulary import MAX_DEPTH, MAX_ROUTES


#: Rounds of a breadth-first closure after which chains are folded, and rounds whose tables are read as one.
DEEP, MERGED = 12, 6


def closure(seeds: DataFrame, edges: DataFrame, *, stop: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """Nodes reached from ``seeds`` (node, and other columns that are carried along) over ``edges`` (src, dst).

    Breadth first; each round joins only the nodes found in the round before, and
    ends when it finds none. Nodes in ``stop`` (node) are neither reached nor passed. A graph
    that is still not through after ``DEEP`` rounds has long chains; where nothing is carried
    along, these are folded (see ``folded``). ``kept``: the edges are a stored table of different
    rows already, which is read as it is and stays.
    """
    keys = seeds.columns
    barred = stop.select("node").distinct() if stop is not None else None

    def open_(df: DataFrame) -> DataFrame:
        return df.join(barred, "node", "left_anti") if barred is not None else df

    # Read anew in every round, so its own lineage ends here.
    edges = edges if kept else stored(edges.select("src", "dst").distinct(), "edges")
    own = [] if kept else [edges]
    tables = [stored(open_(seeds.distinct()), "closure")]
    reached = frontier = tables[0]
    n = 0
    while not frontier.isEmpty():
        if (n := n + 1) > DEEP and keys == ["node"]:
            passed = edges if barred is None else edges.join(barred.withColumnRenamed("node", "dst"), "dst", "left_anti")
            out = folded(reached, passed)
            discard(*own, *tables)
            return out
        step = frontier.withColumnRenamed("node", "src").join(edges, "src").select(*[F.col("dst").alias("node") if k == "node" else F.col(k) for k in keys]).distinct()
        frontier = stored(open_(step).join(reached, keys, "left_anti"), "frontier")
        tables.append(frontier)
        if len(tables) > MERGED:
            # What was found so far becomes one table again.
            whole = stored(reached.unionByName(frontier), "closure")
            discard(*tables[:-1])
            tables, reached = [whole, frontier], whole
        else:
            reached = reached.unionByName(frontier)
    out = stored(reached, "closure") if len(tables) > 2 else reached
    if out is not reached:
        discard(*tables)
    discard(*own)
    return out


def folded(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes reached from ``seeds`` (node) over ``edges`` (src, dst), in a number of rounds that grows with the logarithm of the chains.

    A node with one edge into it is reached if it is a seed or if the node before it
    is. Such nodes point to the one before, and in each round to where that one
    points, noting whether a seed lies between: so they come to the head of their
    chain, a node with no edge into it or several. Only heads are then searched breadth
    first, over the edges into heads, and the chains follow from theirs. A ring of such nodes
    has no head; when the pointers have gone round it, the notes tell all of it.
    """
    seeds, edges = stored(seeds.select("node").distinct(), "seeds"), stored(edges.select("src", "dst").distinct(), "folded-edges")
    mark = seeds.select("node", F.lit(True).alias("_s"))
    into = stored(edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("at")), "into")
    chain = into.filter("n = 1").select(F.col("dst").alias("node"), "at").join(mark, "node", "left").select("node", "at", F.coalesce("_s", F.lit(False)).alias("seed"))
    chain = stored(chain, "chain")
    for _ in range(max(1, chain.count()).bit_length() + 1):
        # ``seed``: whether one lies between the node itself and the one that it points to, that one not counted.
        on = chain.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("seed").alias("_seed"))
        more = chain.join(on, "at")
        if more.isEmpty():
            break
        jumped = stored(chain.join(on, "at", "left").select("node", F.coalesce("_at", "at").alias("at"), (F.col("seed") | F.coalesce("_seed", F.lit(False))).alias("seed")), "chain")
        discard(chain)
        chain = jumped
    heads = into.filter("n > 1").select(F.col("dst").alias("node"))
    told = chain.select(F.col("node").alias("src"), F.col("at").alias("_head"), "seed")
    across = edges.join(heads.withColumnRenamed("node", "dst"), "dst", "left_semi").join(told, "src", "left")
    # An edge into a head comes from the head of its chain; after a seed on the chain it needs no more.
    start = seeds.union(across.filter("seed").select("dst")).distinct()
    held = closure_of_heads(start, across.select(F.coalesce("_head", "src").alias("src"), "dst").distinct())
    on_chain = chain.join(held.select(F.col("node").alias("at"), F.lit(True).alias("_r")), "at", "left").filter("seed OR _r").select("node")
    out = stored(held.select("node").union(on_chain).distinct(), "closure")
    discard(seeds, edges, into, chain)
    return out


def closure_of_heads(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth first, without folding again."""
    edges, reached = stored(edges, "edges"), stored(seeds, "closure")
    frontier = reached
    while not frontier.isEmpty():
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(reached, "node", "left_anti"), "frontier")
        reached = stored(reached.union(frontier), "closure")
    return reached


@dataclass(frozen=True)
class HeldClosure:
    """A closure that is kept while its graph changes: seeds (node), edges (src, dst) and what is reached (node), all stored."""

    seeds: DataFrame
    edges: DataFrame
    reached: DataFrame

    @staticmethod
    def of(seeds: DataFrame, edges: DataFrame) -> HeldClosure:
        seeds, edges = stored(seeds.select("node").distinct(), "seeds"), stored(edges.select("src", "dst").distinct(), "held-edges")
        return HeldClosure(seeds, edges, stored(closure(seeds, edges, kept=True), "held"))

    def changed(self, *, added: DataFrame | None = None, removed: DataFrame | None = None, seeded: DataFrame | None = None, unseeded: DataFrame | None = None) -> HeldClosure:
        """After a batch of edges and seeds that went and came; what is in both stays.

        Nodes that were reached through what went are suspects, and all reached from them;
        of these, those come back that are seeds or have an edge from a node that is
        surely reached, and all reached from them among the suspects. Then what came is
        followed. Only suspects and new nodes are searched, however large the rest is.
        """
        none_e, none_n = self.edges.limit(0), self.seeds.limit(0)
        added, removed = (stored(none_e if x is None else x.select("src", "dst").distinct(), "change") for x in (added, removed))
        seeded, unseeded = (none_n if x is None else x.select("node").distinct() for x in (seeded, unseeded))
        edges = stored(self.edges.join(removed.union(added), ["src", "dst"], "left_anti").union(added), "held-edges")
        seeds = stored(self.seeds.join(unseeded, "node", "left_anti").union(seeded).distinct(), "seeds")
        lost = self.edges.join(removed.join(added, ["src", "dst"], "left_anti"), ["src", "dst"], "left_semi")
        touched = lost.join(self.reached.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
        touched = touched.union(self.seeds.join(seeds, "node", "left_anti")).distinct()
        suspects = stored(closure(touched, self.edges, kept=True), "suspects")
        sure = stored(self.reached.join(suspects, "node", "left_anti"), "sure")
        kept_edges = edges.join(suspects.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        back = kept_edges.join(sure.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).union(suspects.join(seeds, "node", "left_semi")).distinct()
        again = stored(closure(back, kept_edges), "again")
        held = stored(sure.union(again).distinct(), "held")
        known = self.edges.join(added, ["src", "dst"], "left_semi")
        fresh = added.join(known, ["src", "dst"], "left_anti").join(held.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
        fresh = fresh.union(seeds).join(held, "node", "left_anti").distinct()
        new = stored(closure(fresh, edges, stop=held, kept=True), "new")
        out = HeldClosure(seeds, edges, stored(held.union(new).distinct(), "held"))
        discard(added, removed, suspects, sure, again, held, new)
        return out


def unreachable(documents: DataFrame, edges: DataFrame, staged: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Documents that nothing staged still carries. ``documents``: doc_id, sha. ``staged``, ``ignored``: sha."""
    seeds = documents.join(staged, "sha", "left_semi").select(F.col("doc_id").alias("node"))
    stop = documents.join(ignored, "sha", "left_semi").select(F.col("doc_id").alias("node")) if ignored is not None else None
    held = closure(seeds, edges, stop=stop)
    return documents.join(held.withColumnRenamed("node", "doc_id"), "doc_id", "left_anti")


def resumable(occurrences: DataFrame, edges: DataFrame, documents: DataFrame, jobs: DataFrame, scan: str) -> DataFrame:
    """Documents (doc_id, status) without a job that were left unfinished and are reachable from what one scan found available.

    ``occurrences``: doc_id, scan_id, available. Documents whose originals are gone
    are not taken up: they could only fail.
    """
    seeds = occurrences.filter((F.col("scan_id") == scan) & F.col("available")).select(F.col("doc_id").alias("node"))
    held = closure(seeds, edges).withColumnRenamed("node", "doc_id")
    open_ = documents.filter(F.col("status").isin("PENDING", "PROCESSING"))
    return open_.join(held, "doc_id", "left_semi").join(jobs, "doc_id", "left_anti").select("doc_id", "status")


def unreached(occurrences: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: how many documents no available source leads to, over member routes (parent_id, child_id)."""
    seeds = occurrences.filter("available").select(F.col("doc_id").alias("node"))
    held = closure(seeds, members.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst"))).withColumnRenamed("node", "doc_id")
    return documents.join(held, "doc_id", "left_anti").agg(F.count("*").alias("n"))


def split_plan(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many documents of a deletion plan (doc_id) stand alone, and how many inside another of the plan."""
    own = edges.join(plan.select(F.col("doc_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("doc_id"), F.lit(True).alias("_in")).distinct()
    return plan.select("doc_id").distinct().join(own, "doc_id", "left").agg(F.count_if(F.col("_in").isNull()).alias("roots"), F.count_if(F.col("_in")).alias("contained"))


def backfilled(found: DataFrame, documents: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containment derived anew from originals: (edges, completeness of one row).

    ``found``: parent_sha, child_sha of what the originals hold. ``documents``:
    doc_id, sha. ``reads``: sha, readable, parsed, had_children of each container. It
    is complete only if every original could be read, and none that has children
    stayed unparsed.
    """
    by = lambda name, sha: documents.select(F.col("sha").alias(sha), F.col("doc_id").alias(name))
    edges = found.join(by("container_id", "parent_sha"), "parent_sha").join(by("contained_id", "child_sha"), "child_sha")
    edges = edges.filter("container_id <> contained_id").select("container_id", "contained_id").distinct()
    bad = ~F.col("readable") | (~F.col("parsed") & F.col("had_children"))
    return edges, reads.agg(F.count("*").alias("containers"), F.count_if(bad).alias("incomplete")).withColumn("complete", F.col("incomplete") == 0)


def forget_plan(documents: DataFrame, edges: DataFrame, target: DataFrame) -> DataFrame:
    """Documents to delete with ``target`` (doc_id): what it holds, save what others or an own source still hold.

    ``documents``: doc_id, source_path (empty or null without an own source).
    """
    start = target.select(F.col("doc_id").alias("node"))
    below = stored(closure(start, edges), "below")
    own = F.coalesce("source_path", F.lit("")) != ""
    outside = documents.join(below.withColumnRenamed("node", "doc_id"), "doc_id", "left_anti")
    seeds = outside.select("doc_id").union(documents.filter(own).select("doc_id")).distinct().withColumnRenamed("doc_id", "node")
    kept = closure(seeds, edges, stop=start)
    return below.join(kept, "node", "left_anti").withColumnRenamed("node", "doc_id")


def subtree_sizes(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, descendants) for each of ``roots`` (node)."""
    seeds = roots.select(F.col("node").alias("root"), "node")
    reached = closure(seeds, edges)
    return reached.groupBy("root").agg((F.count("*") - 1).alias("descendants"))


def on_rings(edges: DataFrame, rounds: int) -> DataFrame:
    """(node) of a superset of the nodes that lie on a ring of edges: what is left after nodes without edges in or out were taken off, round by round. A graph without rings and with longer ways keeps its middle."""
    left = stored(edges.select("src", "dst").distinct(), "rings")
    n = left.count()
    for _ in range(rounds):
        ends = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        rest = stored(left.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst"), "rings")
        discard(left)
        left, before, n = rest, n, rest.count()
        if n in (0, before):
            break
    return left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()


def routes(ids: DataFrame, members: DataFrame, occurrences: DataFrame, *, depth: int = MAX_DEPTH, most: int = MAX_ROUTES) -> DataFrame:
    """The first ``most`` routes from each document up to source files: (doc_id, nth, available, path, selectors).

    ``members``: parent_id, selector, child_id. ``occurrences``: doc_id, path,
    available. A route passes no document twice and fewer than ``depth`` selectors;
    available files come first, then short routes, then by path and selectors.

    Whatever comes above a node, routes that stand at it with as many selectors keep
    their order. So of each origin's routes at a node only the first ``most`` go on: rows are
    bounded by the nodes above, not by the routes through them. Where rings let one route
    go on and bar another, only routes that passed the same nodes of rings are compared.
    """
    none = F.array().cast("array<string>")
    up = stored(members.select(F.col("parent_id").cast("string").alias("_p"), "selector", F.col("child_id").cast("string").alias("_c")).distinct(), "members")
    rings = stored(on_rings(up.select(F.col("_c").alias("src"), F.col("_p").alias("dst")), 4 * depth), "on-rings")
    ring = rings.select(F.col("node").alias("_p"), F.lit(True).alias("_ring"))
    up = up.join(ring, "_p", "left").select("_p", "selector", "_c", F.coalesce("_ring", F.lit(False)).alias("_ring")) if not rings.isEmpty() else up.withColumn("_ring", F.lit(False))
    at = ids.select(F.col("doc_id").alias("origin"), F.col("doc_id").cast("string").alias("node")).distinct()
    own = at.join(rings, "node", "left_semi").select("node", F.lit(True).alias("_own")).distinct()
    at = at.join(own, "node", "left").select("origin", "node", F.when(F.col("_own"), F.array("node")).otherwise(none).alias("ringed"), none.alias("selectors"))
    every, tables = at, []
    place = F.row_number().over(W.partitionBy("origin", "node", "ringed").orderBy("selectors"))
    for _ in range(depth - 1):
        # Off the rings no node comes twice on a way up.
        at = at.join(up, (F.col("node") == F.col("_c")) & ~F.array_contains("ringed", F.col("_p")))
        ringed = F.when(F.col("_ring"), F.array_sort(F.array_append("ringed", F.col("_p")))).otherwise(F.col("ringed"))
        at = at.select("origin", F.col("_p").alias("node"), ringed.alias("ringed"), F.concat(F.array("selector"), "selectors").alias("selectors"))
        at = stored(at.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n"), "routes")
        tables.append(at)
        if at.isEmpty():
            break
        every = every.union(at)
    files = occurrences.select(F.col("doc_id").cast("string").alias("node"), "path", "available")
    found = every.join(files, "node").withColumnRenamed("origin", "doc_id")
    order = [F.col("available").desc(), F.size("selectors"), "path", "selectors"]
    ranked = found.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)))
    out = stored(ranked.filter(F.col("nth") <= most).select("doc_id", "nth", "available", "path", "selectors"), "found-routes")
    discard(*tables, rings)
    return out


def first_container(edges: DataFrame, containers: DataFrame, parent: Column) -> DataFrame:
    """For each contained document its best container: with a path, its parent, then by path and id.

    ``edges``: container_id, contained_id. ``containers``: container_id, path.
    """
    t = edges.join(containers, "container_id").withColumn("_parent", parent)
    order = [F.col("path").isNull().asc(), F.col("_parent").desc(), F.col("path").asc(), F.col("container_id").asc()]
    nth = F.row_number().over(W.partitionBy("contained_id").orderBy(*order))
    return t.withColumn("_n", nth).filter("_n = 1").select("contained_id", "container_id", "path")


def survivors_parent(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(contained_id, container_id): the earliest container that remains. ``edges`` also has first_seen_at."""
    left = edges.join(deleted.select(F.col("doc_id").alias("container_id")), "container_id", "left_anti")
    return left.groupBy("contained_id").agg(F.min(F.struct("first_seen_at", "container_id")).alias("_m")).select("contained_id", F.col("_m.container_id").alias("container_id"))
