"""Combination of degree-2 nodes against taking them out one by one, and their re-insertion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_line_graph import graph, rows
from tramlines.operators import chains


def one_by_one(nodes, edges):
    """{frozenset(ends): [former edges in order from the smaller end]} after removals in name order."""
    parts = {frozenset(e): [tuple(sorted(e))] for e in edges}
    for n in sorted(nodes):
        mine = [e for e in parts if n in e]
        if len(mine) != 2:
            continue
        p, q = sorted((mine[0] | mine[1]) - {n})
        if frozenset((p, q)) in parts:
            continue
        to, on = (mine[0], mine[1]) if p in mine[0] else (mine[1], mine[0])
        first = parts.pop(to) if p < n else parts.pop(to)[::-1]
        second = parts.pop(on) if n < q else parts.pop(on)[::-1]
        parts[frozenset((p, q))] = first + second
    return parts


def combined(spark, nodes, edges, lines=("1",)):
    g = graph(spark, nodes, {k: [(a, b, None) for a, b in edges] for k in lines})
    return g, chains.combine_degree_two(g)


def check(spark, edges):
    names = sorted({n for e in edges for n in e})
    nodes = {n: (i, i % 7) for i, n in enumerate(names)}
    g, c = combined(spark, nodes, edges)
    got = {}
    for r in c.pieces.orderBy("edge_id", "rank").collect():
        got.setdefault(r.edge_id, []).append(tuple(r.piece.split("-")))
    want = {"-".join(sorted(k)): v for k, v in one_by_one(names, edges).items()}
    assert got == want
    assert {(r.edge_id, r.pieces) for r in c.edges.collect()} == {(k, len(v)) for k, v in want.items()}
    assert sorted(r.node_id for r in c.nodes.collect()) == sorted({n for k in want for n in k.split("-")})
    inner = {}
    for k, v in want.items():
        at = min(k.split("-"))
        for i, e in enumerate(v[:-1], 1):
            at = e[0] if at == e[1] else e[1]
            inner[at] = (k, i)
    assert {r.node_id: (r.edge_id, r.rank) for r in c.places.collect()} == inner


def chain(*names):
    return list(zip(names, names[1:], strict=False))


@pytest.mark.parametrize(
    "edges",
    [
        chain("a", "b", "c", "d"),  # a path
        chain("c", "a", "d", "b"),  # its nodes out of order
        chain("a", "b", "c", "d", "e", "a"),  # a ring
        chain("a", "b", "c", "a"),  # a triangle
        chain("x", "a", "b", "c", "x") + chain("x", "y"),  # a loop at a node
        chain("u", "a", "b", "v") + chain("u", "c", "v") + chain("u", "d", "e", "v"),  # parallel chains
        chain("u", "v") + chain("u", "a", "v") + chain("u", "b", "c", "v"),  # beside a direct edge
        chain("a", "b") + chain("c", "d", "e"),
    ],
)
def test_combination_of_small_graphs(spark, edges):
    check(spark, edges)


@pytest.mark.parametrize("seed", range(2))
def test_combination_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03}" for i in range(120)]
    rng.shuffle(names)
    edges = {tuple(sorted(e)) for e in zip(names, names[1:], strict=False) if rng.random() < 0.95} | {tuple(sorted(rng.sample(names, 2))) for _ in range(12)}
    ring = [f"r{i:02}" for i in range(37)]
    rng.shuffle(ring)
    check(spark, sorted(edges) + chain(*ring, ring[0]))


def test_long_chain_takes_few_rounds(spark):
    items = spark.range(1000).select("id", F.when(F.col("id") < 999, F.col("id") + 1).alias("next"), F.col("id").alias("name"))
    got = {r.id: r for r in chains.rank_lists(items, keep=2, rounds=11).collect()}
    assert all(got[i].last == 999 and got[i].n == 1000 - i and not got[i].closed for i in (0, 1, 500, 998, 999))
    assert got[0].top == [999, 998] and got[999].top == [999]
    ring = spark.range(700).select("id", ((F.col("id") + 1) % 700).alias("next"), F.col("id").alias("name"))
    assert {(r.closed, tuple(r.top)) for r in chains.rank_lists(ring, keep=3, rounds=12).collect()} == {(True, (699, 698, 697))}


def test_nodes_go_back_at_equal_distances(spark):
    g, c = combined(spark, {"a": (0, 0), "b": (1, 0), "c": (2, 5), "d": (9, 9), "z": (5, 5), "y": (6, 5)}, chain("a", "c", "b", "d") + [("y", "z")], ("1", "2"))
    assert rows(c.edges, "edge_id", "pieces", "max_lines") == [("a-d", 3, 2), ("y-z", 1, 2)]
    drawn = spark.createDataFrame([("a-d", [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0)])], "edge_id string, geom array<struct<x: double, y: double>>")
    out = chains.reinsert(g, c, drawn)
    at = {r.node_id: (r.x, r.y) for r in out.nodes.collect()}
    assert at["a"] == (0, 0) and at["d"] == (3, 3) and at["z"] == (5, 5)
    assert all(math.dist(at[n], p) < 1e-9 for n, p in {"c": (2, 0), "b": (3, 1)}.items())
    geom = {r.edge_id: [(round(p.x, 9), round(p.y, 9)) for p in r.geom or []] for r in out.edges.collect()}
    assert geom == {"a-c": [(0, 0), (2, 0)], "b-c": [(3, 1), (3, 0), (2, 0)], "b-d": [(3, 1), (3, 3)], "y-z": []}
    assert rows(out.occs, "edge_id", "line_id") == rows(g.occs, "edge_id", "line_id")
