"""Sampled routes against plain searches, numbering without one task, and denser courses."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tests.test_line_graph import graph, rows
from tramlines.operators import evaluate, routing
from tramlines.operators.numbering import numbered

GRID = {f"{x}{y}": (x * 10, y * 10) for x in range(4) for y in range(4)}
SIDES = [(a, b) for a, b in itertools.combinations(sorted(GRID), 2) if math.dist(GRID[a], GRID[b]) < 11]


def test_numbers_follow_the_order(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.lit("x").alias("at_")).repartition(5)
    assert [(r.k, r.at) for r in numbered(df, "k").orderBy("at").collect()] == [(i, i) for i in range(500)]
    same = numbered(spark.range(50).select((F.col("id") % 3).alias("k")), "k").orderBy("at").collect()
    assert [r.at for r in same] == list(range(50)) and [r.k for r in same] == sorted(r.k for r in same)
    assert numbered(spark.range(0), "id").count() == 0


def test_a_graph_matches_itself(spark):
    g = graph(spark, GRID, {"1": [(a, b, None) for a, b in SIDES], "2": [(a, b, b) for a, b in SIDES if a[0] == b[0]]})
    got = evaluate.route_summary(evaluate.sampled_routes(g, g, 60, 1.0), 1.0).first()
    assert got.rate == 1 and got.least == got.largest == got.mean == 0 and 0 < got.samples <= 60


def test_routes_equal_plain_searches(spark):
    """Two lines on a grid and a copy of it without some edges, with one exception and one moved node."""
    truth = graph(spark, GRID, {"1": [(a, b, None) for a, b in SIDES], "2": [(a, b, b) for a, b in SIDES]})
    less = [e for i, e in enumerate(SIDES) if i % 5]
    there = GRID | {"11": (10, 11.5)}
    test = graph(spark, there, {"1": [(a, b, None) for a, b in less], "2": [(a, b, b) for a, b in less]}, [("21", "1", "-".join(sorted(("21", "22"))), "-".join(sorted(("20", "21"))))])

    def search(at, edges, line, banned, f, t):
        """Costs without the first edge, by walks over arcs."""
        arcs = [(a, b) for a, b in edges] + ([(b, a) for a, b in edges] if line == "1" else [])
        best = {a: 0.0 for a in arcs if a[0] in f}
        front = dict(best)
        while front:
            new = {}
            for (u, v), c in front.items():
                for w in (b for a, b in arcs if a == v and b != u):
                    if (line, v, frozenset((u, w))) in banned:
                        continue
                    cost = c + math.dist(at[v], at[w])
                    if cost < min(best.get((v, w), math.inf), new.get((v, w), math.inf)) - 1e-9:
                        new[v, w] = cost
            best |= new
            front = new
        return min((c for (u, v), c in best.items() if v in t), default=None)

    drawn = {r["sample"]: (r.from_node, r.to_node) for r in evaluate.sample_pairs(truth.nodes, 40, seed=3).collect()}
    got = evaluate.sampled_routes(truth, test, 40, 2.0, seed=3).collect()
    assert len(got) == 40 and {r.line_id for r in got} == {"1", "2"}
    near = lambda n, at: {m for m in at if math.dist(GRID[n], at[m]) <= 2}
    for r in got:
        f, t = drawn[r["sample"]]
        want = search(GRID, SIDES, r.line_id, set(), near(f, GRID), near(t, GRID))
        other = search(there, less, r.line_id, {("1", "21", frozenset(("22", "20")))}, near(f, there), near(t, there))
        for value, cost in ((want, r.truth_cost), (other, r.test_cost)):
            assert (value is None) == (cost is None) and (value is None or abs(value - cost) < 1e-6)
        assert (r.frechet is None) == (want is None or other is None)
    some = evaluate.route_summary(evaluate.sampled_routes(truth, test, 40, 2.0, seed=3), 2.0).first()
    counted = [r for r in got if r.truth_cost is not None or r.test_cost is not None]
    assert some.samples == len(counted) and abs(some.rate - sum(r.frechet is not None and r.frechet < 2 for r in counted) / len(counted)) < 1e-9


def test_turns_are_made_where_searches_arrive(spark, monkeypatch):
    """Sampled routes in a graph of any size don't make all of its turns."""
    monkeypatch.setattr(routing, "_turns", None)
    bar = [("10", "1", "00-10", "10-20"), ("10", "1", "10-20", "00-10")]
    g = graph(spark, GRID, {"1": [(a, b, None) for a, b in SIDES if a[1] == b[1]]}, bar)
    free = g.with_(exceptions=None)
    got = evaluate.sampled_routes(free, g, 30, 1.0, limit=25.0).collect()
    for r in got:
        assert r.test_cost is None or r.test_cost == r.truth_cost < 25
    barred = [r for r in got if r.truth_cost is not None and r.test_cost is None]
    assert barred and any(r.test_cost for r in got)


def test_span_limits_the_second_node(spark):
    g = graph(spark, GRID, {"1": [(a, b, None) for a, b in SIDES]})
    got = evaluate.sample_pairs(g.nodes, 200, span=15).collect()
    assert len(got) == 200 and all(math.dist(GRID[r.from_node], GRID[r.to_node]) <= 15 for r in got) and len({r.to_node for r in got}) > 8
    assert rows(evaluate.sample_pairs(g.nodes, 200, span=15)) == sorted(tuple(r) for r in got)


def test_dense_courses(spark):
    p = evaluate.dense(np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 1.0]]), 3.0)
    assert p.tolist() == [[0, 0], [2.5, 0], [5, 0], [7.5, 0], [10, 0], [10, 1]]
    course = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)], [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0)])], f"id long, p {course}, q {course}")
    assert evaluate.frechet(df).first().distance == 5 and evaluate.frechet(df, 1.0).first().distance <= 0.5
