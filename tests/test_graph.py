"""Closures over chains, rings and random graphs, kept under change, and routes through lattices and rings, against plain Python."""

import itertools
import random

import pytest

from lodeworks.operators import graph


def reach(seeds, edges, stop=()):
    out, todo = set(), [s for s in seeds if s not in stop]
    while todo:
        x = todo.pop()
        if x not in out:
            out.add(x)
            todo += [b for a, b in edges if a == x and b not in stop]
    return out


def nodes(df):
    rows = [r["node"] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frames(spark, seeds, edges):
    return spark.createDataFrame([(s,) for s in seeds], "node int"), spark.createDataFrame(list(edges), "src int, dst int")


def random_graph(rng, n, m):
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


#: A chain, a ring with tails, a ring that a chain leads into, a diamond, two edges into a ring.
SHAPES = [
    ({0}, {(i, i + 1) for i in range(40)}), ({7}, {(i, (i + 1) % 10) for i in range(10)} | {(3, 20), (20, 21), (21, 22)}), ({30}, {(30, 31), (31, 0)} | {(i, (i + 1) % 5) for i in range(5)}),
    ({0}, {(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6)}), ({50}, {(50, 1), (51, 2)} | {(i, (i + 1) % 6) for i in range(6)}), (set(), {(1, 2)}), ({9}, {(1, 2)}), ({2}, {(2, 2), (2, 3)}),
]


@pytest.mark.parametrize("shape", range(len(SHAPES) + 3))
def test_folded_chains(spark, shape):
    rng = random.Random(shape)
    seeds, edges = SHAPES[shape] if shape < len(SHAPES) else ({1, 2}, random_graph(rng, 60, 55 + 5 * shape))
    assert nodes(graph.folded(*frames(spark, seeds, edges))) == reach(seeds, edges)


def test_closure_folds_when_it_gets_deep(spark, monkeypatch):
    """A chain of 10,000 with a ring and a bar: no round for each of its nodes."""
    edges = [(i, i + 1) for i in range(10_000)] + [(10_000, 9_990), (500, 20_000), (20_000, 20_001), (20_001, 20_002), (9_000, 20_002)]
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name, real=graph.stored: written.append(name) or real(df, name))
    s, e = frames(spark, [5], edges)
    got = nodes(graph.closure(s, e, stop=spark.createDataFrame([(20_001,)], "node int")))
    assert got == set(range(5, 10_001)) | {20_000, 20_002} and written.count("chain") < 20 and len(written) < 60


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_under_change(spark, seed):
    rng = random.Random(seed)
    seeds, edges = {0, 1}, random_graph(rng, 40, 50)
    held = graph.HeldClosure.of(*frames(spark, seeds, edges))
    for _ in range(3):
        gone, new = set(rng.sample(sorted(edges), 12)), random_graph(rng, 40, 8)
        s_gone, s_new = set(rng.sample(sorted(seeds), 1)), {rng.randrange(40)}
        edges, seeds = edges - gone | new, seeds - s_gone | s_new
        s = [frames(spark, x, y) for x, y in ((s_new, new), (s_gone, gone))]
        held = held.changed(added=s[0][1], seeded=s[0][0], removed=s[1][1], unseeded=s[1][0])
        assert nodes(held.reached) == reach(seeds, edges) and nodes(held.seeds) == seeds
        assert {tuple(r) for r in held.edges.collect()} == edges
    assert nodes(held.changed().reached) == reach(seeds, edges)


def test_a_change_searches_only_what_it_touches(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(1, 300)]
    held, rows = graph.HeldClosure.of(*frames(spark, [0], edges)), {}
    monkeypatch.setattr(graph, "stored", lambda df, name, real=graph.stored: rows.setdefault(name, []).append(real(df, name)) or rows[name][-1])
    monkeypatch.setattr(graph, "discard", lambda *_: None)
    after = held.changed(removed=spark.createDataFrame([(0, 7)], "src int, dst int"))
    assert nodes(held.reached) - nodes(after.reached) == {7, 1007} and rows["suspects"][0].count() == 2


def plain_routes(ids, members, files, depth, most):
    """All simple ways up, sorted, and then cut."""
    out = []
    for origin in ids:
        found, todo = [], [(origin, (origin,), ())]
        while todo:
            node, seen, sel = todo.pop()
            found += [((not a, len(sel), path, sel), (a, path, sel)) for d, path, a in files if d == node]
            if len(sel) < depth - 1:
                todo += [(p, (*seen, p), (s, *sel)) for p, s, c in members if c == node and p not in seen]
        out += [(origin, n, *r) for n, (_, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def routes(spark, ids, members, files, **how):
    m = spark.createDataFrame(members, "parent_id string, selector string, child_id string")
    o = spark.createDataFrame(files, "doc_id string, path string, available boolean")
    got = graph.routes(spark.createDataFrame([(i,) for i in ids], "doc_id string"), m, o, **how).collect()
    return sorted((r["doc_id"], r["nth"], r["available"], r["path"], tuple(r["selectors"])) for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_routes_through_random_graphs(spark, seed):
    """With rings, several selectors between the same two, and fewer places than routes."""
    rng = random.Random(seed)
    names = [f"d{i}" for i in range(9)]
    members = sorted({(a, f"s{rng.randint(0, 2)}", b) for a, b in (rng.sample(names, 2) for _ in range(14 + 3 * seed))})
    files = [(d, f"/{d}/{k}", rng.random() < 0.6) for d in names for k in range(rng.randint(0, 2))]
    assert routes(spark, names, members, files, depth=6, most=5) == plain_routes(names, members, files, 6, 5)


def test_routes_through_a_lattice_stay_few(spark, monkeypatch):
    """Four to the seventh ways up, of which each node keeps ten."""
    members = [(f"{h + 1}.{a}", f"s{a}", f"{h}.{b}") for h in range(7) for a, b in itertools.product(range(4), repeat=2)]
    files = [(f"7.{a}", f"/{a}", a != 0) for a in range(4)]
    rows = []
    monkeypatch.setattr(graph, "discard", lambda *_: None)
    monkeypatch.setattr(graph, "stored", lambda df, name, real=graph.stored: rows.append((name, t := real(df, name))) or t)
    assert routes(spark, ["0.0"], members, files, most=10) == plain_routes(["0.0"], members, files, 8, 10)
    assert max(t.count() for name, t in rows if name == "routes") == 40
