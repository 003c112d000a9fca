"""Topology, stations, grids and drawing against hand-made graphs and sequential versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_line_graph import graph, rows
from tramlines.operators import algebra, drawing, geometry, grids, ordering, stations, structure, topology

PATH = {"a": (0, 0), "b": (1, 0), "c": (2, 0), "d": (3, 0), "e": (3, 1)}


def sequential_contraction(edges, lines):
    """Contract, one by one, nodes of two edges with equal lines whose neighbours share no edge."""
    edges = {frozenset(e): set(ls) for e, ls in zip(edges, lines, strict=True)}
    while True:
        for n in sorted({x for e in edges for x in e}):
            mine = [e for e in edges if n in e]
            if len(mine) == 2 and edges[mine[0]] == edges[mine[1]]:
                far = frozenset((mine[0] | mine[1]) - {n})
                if len(far) == 2 and far not in edges:
                    edges[far] = edges.pop(mine[0])
                    edges.pop(mine[1])
                    break
        else:
            return edges


@pytest.mark.parametrize("seed", range(2))
def test_contract_stray_keeps_ends_and_lines(spark, seed):
    rng = random.Random(seed)
    nodes = {f"n{i:02}": (i, rng.random()) for i in range(30)}
    names = sorted(nodes)
    es = [(names[i], names[i + 1]) for i in range(29) if rng.random() < 0.9] + [(names[rng.randrange(15)], names[15 + rng.randrange(15)]) for _ in range(4)]
    es = [tuple(sorted(e)) for e in {frozenset(e) for e in es}]
    g = graph(spark, nodes, {"1": [(a, b, None) for a, b in es]})
    got = {frozenset((r.a, r.b)) for r in topology.contract_stray(g).edges.collect()}
    want = sequential_contraction(es, [{"1"}] * len(es))
    assert len(got) == len(want)  # cycles may keep other nodes, as many
    branching = {n for n in names if sum(n in e for e in es) != 2}
    assert {n for e in got for n in e} >= {n for e in want for n in e} & branching


def test_contract_stray_direction_stations_and_exceptions(spark):
    g = graph(spark, PATH, {"1": [("a", "b", "b"), ("b", "c", "c"), ("c", "d", "d"), ("d", "e", "e")]})
    assert rows(topology.contract_stray(g).occs, "edge_id", "direction") == [("a-e", "e")]
    stop = spark.createDataFrame([("c",)], "node_id string")
    assert rows(topology.contract_stray(g, stop).occs, "edge_id", "direction") == [("a-c", "c"), ("c-e", "e")]
    blocked = graph(spark, PATH, {"1": [("a", "b", None), ("b", "c", None)]}, [("b", "1", "a-b", "b-c")])
    assert rows(topology.contract_stray(blocked).edges, "edge_id") == [("a-b",), ("b-c",)]


def test_useful_exceptions(spark):
    g = graph(spark, {"m": (0, 0), "a": (1, 0), "b": (0, 1), "c": (-1, 0)}, {"1": [("a", "m", None), ("b", "m", None)], "2": [("a", "m", None), ("b", "m", None), ("c", "m", None)]}, [("m", "1", "a-m", "b-m"), ("m", "2", "a-m", "b-m")])
    # Line 1 could go nowhere: its exception goes.  Line 2 still has the way over c.
    assert rows(topology.useful_exceptions(g), "line_id", "edge_a", "edge_b") == [("2", "a-m", "b-m"), ("2", "b-m", "a-m")]


def test_orphans_fall_back_to_the_station(spark):
    g = graph(spark, PATH, {"1": [("a", "b", None), ("b", "c", None), ("c", "d", None), ("d", "e", None)], "2": [("a", "b", None), ("b", "c", None)]})
    served = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1")], "node_id string, line_id string")
    out = topology.drop_orphans(g, served)
    assert rows(out.occs, "edge_id", "line_id") == [("a-b", "1"), ("a-b", "2"), ("b-c", "1")]
    assert rows(out.nodes, "node_id") == [("a",), ("b",), ("c",)]


def test_split_edges_moves_lines_and_exceptions(spark):
    g = graph(spark, PATH, {"1": [("a", "b", "b"), ("b", "c", "c")], "2": [("a", "b", None), ("b", "c", None)]}, [("b", "2", "a-b", "b-c")])
    cuts = spark.createDataFrame([("a-b", 0.25, "x"), ("a-b", 0.75, "y")], "edge_id string, share double, node_id string")
    out = topology.split_edges(g, cuts)
    assert rows(out.occs, "edge_id", "line_id", "direction") == [("a-x", "1", "x"), ("a-x", "2", None), ("b-c", "1", "c"), ("b-c", "2", None), ("b-y", "1", "b"), ("b-y", "2", None), ("x-y", "1", "y"), ("x-y", "2", None)]
    assert rows(out.exceptions, "edge_a", "edge_b") == [("b-c", "b-y"), ("b-y", "b-c")]
    assert {(r.node_id, r.x) for r in out.nodes.collect()} >= {("x", 0.25), ("y", 0.75)}
    assert rows(algebra.termini(out), "node_id", "line_id") == rows(algebra.termini(g), "node_id", "line_id")


def test_turn_costs(spark):
    g = graph(spark, {"m": (0, 0), "a": (1, 0), "b": (2, 0.1), "c": (-3, 0)}, {"1": [("a", "m", None), ("b", "m", None), ("c", "m", None)]})
    cost = {(r.edge_a, r.edge_b): r.cost for r in topology.turn_costs(g, 10.0, 45.0).collect()}
    assert math.isclose(cost["a-m", "c-m"], 3) and math.isclose(cost["a-m", "b-m"], 10 + math.hypot(2, 0.1)) and ("a-m", "a-m") not in cost


def test_prices_of_stations(spark):
    g = graph(spark, {"a": (0, 0), "b": (1, 0), "c": (2, 0)}, {x: [("a", "b", None), ("b", "c", None)] for x in "12"})
    order = spark.createDataFrame([("a-b", "1", 0, 2), ("a-b", "2", 1, 2), ("b-c", "2", 0, 2), ("b-c", "1", 1, 2)], "edge_id string, line_id string, pos long, lines long")
    stop = spark.createDataFrame([("b",)], "node_id string")
    at_b = lambda **k: {r.node_id: (r.same, r.score) for r in ordering.score(g, order, **k).collect()}["b"]
    assert at_b() == (1, 8.0)
    assert at_b(stations=stop) == (1, 4.0)
    assert at_b(penalties=ordering.Penalties(cross_by_degree=False)) == (1, 4.0)
    given = g.with_(occs=g.occs.withColumn("pos", F.when(F.col("line_id") == "2", 0).otherwise(1)))
    assert rows(ordering.default_order(given).where("pos = 0"), "line_id") == [("2",), ("2",)]


def test_polylines_of_few_points(spark):
    df = spark.sql("SELECT array(struct(1D AS x, 2D AS y)) AS one, array(struct(0D AS x, 0D AS y), struct(0D AS x, 0D AS y)) AS same, array(struct(0D AS x, 0D AS y), struct(3D AS x, 0D AS y), struct(3D AS x, 4D AS y)) AS bent")
    r = df.select(
        geometry.length(F.col("one")).alias("a"), geometry.length(F.col("same")).alias("b"), geometry.length(F.col("bent")).alias("c"), geometry.point_at(F.col("bent"), F.lit(1.0)).alias("d"),
        geometry.point_at(F.col("one"), F.lit(0.5)).alias("e"), geometry.sub_path(F.col("bent"), F.lit(0.0), F.lit(0.5)).alias("f"), geometry.nearest_on(F.col("bent"), F.lit(5.0), F.lit(2.0)).alias("g"),
        geometry.chaikin(F.col("bent")).alias("h"), geometry.angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, tuple(r.d), tuple(r.e)) == (0, 0, 7, (3, 4), (1, 2))
    assert [tuple(p) for p in r.f] == [(0, 0), (3, 0), (3, 0.5)] and (r.g.d, round(r.g.share, 9)) == (2, round(5 / 7, 9))
    assert len(r.h) == 4 and math.isclose(r.i, 90)


def test_grids_and_bends(spark):
    eight = grids.octilinear(spark, 3, 2)
    assert eight.count() == 2 * (4 + 3 + 4) and grids.crossings(eight).count() == 2
    assert grids.orthogonal(spark, 3, 2).count() == 2 * (4 + 3)
    hexa = {(r.x, r.y, r.to_x, r.to_y) for r in grids.hexagonal(spark, 4, 4).collect()}
    assert all((c, d, a, b) in hexa for a, b, c, d in hexa)  # every hop leads back
    costs = grids.Costs().bends()
    got = spark.range(8).select(grids.bend_cost(F.col("id"), F.lit(0), costs).alias("c")).collect()
    assert [r.c for r in got] == [costs[0], costs[1], costs[2], costs[3], costs[0], costs[3], costs[2], costs[1]]


def test_drawing_parts(spark):
    assert drawing.zoom_levels("3, 5-7") == [3, 5, 6, 7]
    assert drawing.world_file(10.0, 20.0, 0.5).split("\n") == ["0.5", "0.0", "0.0", "-0.5", "10.0", "20.0"]
    g = graph(spark, PATH, {"1": [("a", "b", None)], "2": [("a", "b", None)]})
    f = {r.node_id: (r.x1, r.y1, r.x2, r.y2) for r in drawing.node_fronts(g, drawing.edge_widths(g, 2.0, 1.0), 0.25).collect()}
    assert f == {"a": (0.25, -2.5, 0.25, 2.5), "b": (0.75, 2.5, 0.75, -2.5)}
    r = spark.range(1).select(drawing.line_commands(F.array(F.lit(2), F.lit(2), F.lit(10)), F.array(F.lit(2), F.lit(10), F.lit(10))).alias("c")).first()
    assert r.c == [9, 4, 4, 18, 0, 16, 16, 0]  # the public specification's example


def test_station_candidates_prefer_what_serves_all(spark):
    g = graph(spark, PATH, {"1": [("a", "b", None), ("b", "c", None), ("c", "d", None)]})
    s = spark.createDataFrame([("b", "x")], "node_id string, name string")
    best = stations.best(stations.candidates(g, s, 0.3)).first()
    assert (best.kind, best.target, round(best.score, 6)) == ("node", "b", 0)
    assert stations.unserved(g, s, stations.best(stations.candidates(g, s, 0.3))).count() == 0
    assert structure.drop_isolated(g).nodes.count() == 4
