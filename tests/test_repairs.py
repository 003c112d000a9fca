"""High degrees, single-line edges, orphan exceptions, node means, fronts and boxes on hand-made graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_line_graph import graph, rows
from tramlines.operators import algebra, drawing, ordergraph, structure, topology


def star(n):
    return {"m": (0, 0)} | {f"n{i:02}": (math.sin(2 * math.pi * i / n) * 100, math.cos(2 * math.pi * i / n) * 100) for i in range(n)}


@pytest.mark.parametrize("n, most", [(5, 4), (6, 4), (7, 4), (12, 4), (9, 3), (12, 6)])
def test_no_node_keeps_too_many_edges(spark, n, most):
    g = graph(spark, star(n), {"1": [(f"n{i:02}", "m", None) for i in range(n)], "2": [("n00", "m", "m"), (f"n{n - 1:02}", "m", f"n{n - 1:02}")]}, [("m", "1", "m-n00", f"m-n{n - 1:02}")])
    out = structure.split_high_degree(g, most)
    degrees = {r.node_id: r.degree for r in algebra.degrees(out).collect()}
    levels = math.ceil((n - most) / (most - 2))
    assert max(degrees.values()) <= most and len(degrees) == n + 1 + levels and degrees["m"] == most
    trunks = {r.edge_id for r in out.edges.collect() if r.a.startswith("m") and r.b.startswith("m")}
    assert len(trunks) == levels
    lines = {(r.edge_id, r.line_id): r.direction for r in out.occs.collect()}
    assert {(t, line) for t in trunks for line in "12"} <= set(lines) and all(lines[t, "1"] is None for t in trunks)
    # Line 2 keeps its direction at the far end; at new nodes lines only run along the trunk back.
    last = next(e for e, line in lines if line == "2" and f"n{n - 1:02}" in e)
    assert lines[last, "2"] == f"n{n - 1:02}" and lines["m-n00", "2"] == "m"
    on = {(r.node_id, r.edge_a, r.edge_b) for r in algebra.continuations(out).where("line_id = '1'").collect()}
    back = {f"m+{k}": "-".join(sorted((f"m+{k}", f"m+{k - 1}" if k > 1 else "m"))) for k in range(1, levels + 1)}
    assert all(back[v] in (a, b) for v, a, b in on if v in back)
    assert ("m", "m-n00", back["m+1"]) not in on and ("m", "m-n01", back["m+1"]) in on
    at = {r.node_id: (r.x, r.y) for r in out.nodes.collect()}
    assert all(abs(math.dist(at[f"m+{k}"], at[f"m+{k - 1}" if k > 1 else "m"]) - 10) < 1e-9 for k in range(1, levels + 1))


def test_high_degrees_at_both_ends(spark):
    left, right = {f"l{i}": (-100, i * 10) for i in range(5)}, {f"r{i}": (100, i * 10) for i in range(5)}
    g = graph(spark, {"m": (-10, 0), "w": (10, 0)} | left | right, {"1": [(n, "m", None) for n in left] + [(n, "w", None) for n in right] + [("m", "w", "w")]})
    out = structure.split_high_degree(g, 4)
    degrees = {r.node_id: r.degree for r in algebra.degrees(out).collect()}
    assert max(degrees.values()) <= 4 and len(degrees) == 12 + 2
    between = [r for r in out.edges.collect() if {r.a[0], r.b[0]} == {"m", "w"}]
    assert len(between) == 1
    assert out.occs.where(F.col("edge_id") == between[0].edge_id).first().direction[0] == "w"


def test_single_lines_become_dead_ends(spark):
    nodes = {n: (i * 100, 0) for i, n in enumerate("abcd")} | {"e": (200, 100)}
    g = graph(spark, nodes, {"1": [("a", "b", "b"), ("b", "c", "c"), ("c", "d", "d"), ("c", "e", None)], "2": [("c", "d", None)]}, [("c", "1", "b-c", "c-e")])
    out = ordergraph.cut_single(g)
    got = {(r.a, r.b) for r in out.edges.collect()}
    assert got == {("a", "b"), ("b", "b-c|1"), ("b-c|2", "c"), ("c", "d"), ("c", "e")}
    directions = {r.edge_id: r.direction for r in out.occs.where("line_id = '1'").collect()}
    assert {d for e, d in directions.items() if "|1" in e} == {"b-c|1"} and {d for e, d in directions.items() if "|2" in e} == {"c"}
    assert {r.node_id: r.x for r in out.nodes.collect()}["b-c|1"] == 145
    half = next(r.edge_id for r in out.edges.collect() if r.a == "b-c|2")
    assert rows(out.exceptions, "edge_a", "edge_b") == sorted([(half, "c-e"), ("c-e", half)])


def test_orphans_lift_what_they_joined(spark):
    """Line 1 ran from b over the stub to c and no other way; without the stub it runs straight on."""
    g = graph(spark, {"m": (0, 0), "b": (-1, 0), "c": (1, 0), "s": (0, 1)}, {"1": [("b", "m", None), ("c", "m", None), ("m", "s", None)], "2": [("b", "m", None), ("c", "m", None)]}, [("m", "1", "b-m", "c-m"), ("m", "2", "b-m", "c-m")])
    served = spark.createDataFrame([("b", "1"), ("c", "1"), ("b", "2"), ("c", "2"), ("m", "2")], "node_id string, line_id string")
    out = topology.drop_orphans(g, served)
    assert rows(out.edges, "edge_id") == [("b-m",), ("c-m",)]
    assert rows(out.exceptions, "line_id", "edge_a") == [("2", "b-m"), ("2", "c-m")]


def test_means_of_edge_ends(spark):
    g = graph(spark, {"a": (0, 0), "b": (9, 9), "c": (5, 0)}, {"1": [("a", "b", None), ("a", "c", None)]})
    geom = spark.createDataFrame([("a-b", [(1.0, 0.0), (9.0, 8.0)]), ("a-c", [(0.0, 3.0), (2.0, 2.0), (5.0, 1.0)])], "edge_id string, geom array<struct<x: double, y: double>>")
    assert rows(topology.node_means(g.with_(edges=g.edges.join(geom, "edge_id")))) == [("a", 0.5, 1.5), ("b", 9.0, 8.0), ("c", 5.0, 1.0)]


def test_open_fronts(spark):
    g = graph(spark, {"a": (0, 0), "b": (10, 0), "c": (0, 100), "d": (5, 0), "e": (400, 400), "f": (404, 400)}, {"1": [("a", "b", None), ("a", "c", None), ("a", "d", None), ("e", "f", None)]})
    fronts = drawing.node_fronts(g, drawing.edge_widths(g, 20.0, 10.0), 2.0)
    stations = spark.createDataFrame([("d",)], "node_id string")
    # a-b is short; a-c is long; a-d ends at a station; a front far away at f opens e-f at e only.
    moved = fronts.withColumn("x1", F.when(F.col("node_id") == "f", F.col("x1") + 500).otherwise(F.col("x1"))).withColumn("x2", F.when(F.col("node_id") == "f", F.col("x2") + 500).otherwise(F.col("x2")))
    assert rows(drawing.open_fronts(g, moved, stations, 30.0)) == [("a", "a-c"), ("a", "a-d"), ("c", "a-c"), ("d", "a-d"), ("e", "e-f")]


@pytest.mark.parametrize("by_hash", [True, False])
def test_boxes_stay_unless_one_that_stays_overlaps(spark, by_hash):
    rng = random.Random(4)
    boxes = [(i, x, y, x + 2, y + 2) for i in range(120) for x, y in [(rng.uniform(0, 15), rng.uniform(0, 15))]]
    df = spark.createDataFrame([(i, *map(float, b)) for i, *b in boxes], "node_id long, x1 double, y1 double, x2 double, y2 double")
    keys = {r.node_id: (r.k, r.node_id) for r in df.select("node_id", (F.xxhash64("node_id") if by_hash else F.col("node_id") * 37 % 101).alias("k")).collect()}
    stay = []
    for b in sorted(boxes, key=lambda b: keys[b[0]]):
        if not any(b[1] <= o[3] and o[1] <= b[3] and b[2] <= o[4] and o[2] <= b[4] for o in stay):
            stay.append(b)
    got = drawing.drop_overlapped(df, 3.0, None if by_hash else F.col("node_id") * 37 % 101)
    assert rows(got, "node_id") == sorted((b[0],) for b in stay)
    assert drawing.drop_overlapped(df.where("false"), 3.0).count() == 0


def test_cliques_break_where_places_don_t_follow(spark):
    """Five lines straight over a node; the order on the far edge has one line out of place."""
    g = graph(spark, {"a": (-1, 0), "m": (0, 0), "z": (1, 0)}, {str(i): [("a", "m", None), ("m", "z", None)] for i in range(5)})
    places = {"a-m": [0, 1, 2, 3, 4], "m-z": [0, 1, 4, 2, 3]}
    order = spark.createDataFrame([(e, str(i), p, 5) for e, ps in places.items() for i, p in enumerate(ps)], "edge_id string, line_id string, pos long, lines long")
    got = drawing.adjacent_cliques(g, order).collect()
    assert sorted(r.lines for r in got) == [1, 2, 2]
    assert {r.lines: r.z for r in got}[1] == 2 and sorted(r.clique for r in got) == [0, 1, 2]
    straight = order.withColumn("pos", F.col("line_id").cast("long"))
    assert [(r.lines, r.z) for r in drawing.adjacent_cliques(g, straight).collect()] == [(5, 0)]
