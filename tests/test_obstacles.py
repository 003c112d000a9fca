"""Obstacles against plain geometry, course penalties against all pairs, and traced origins."""

import json
import math
import random

from tests.test_line_graph import graph, rows
from tramlines.operators import chains, obstacles, ordergraph, structure, topology
from tramlines.sources import geojson

SHAPES = "polygon string, ring array<struct<x: double, y: double>>"
SEGMENTS = "id long, x1 double, y1 double, x2 double, y2 double"


def inside(p, ring):
    hits = 0
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] <= p[1]) != (b[1] <= p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            hits += 1
    return hits % 2 == 1


def meets(p, q, a, b):
    turn = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    on = lambda o, u, v: turn(o, u, v) == 0 and min(o[0], u[0]) <= v[0] <= max(o[0], u[0]) and min(o[1], u[1]) <= v[1] <= max(o[1], u[1])
    return (turn(p, q, a) * turn(p, q, b) < 0 and turn(a, b, p) * turn(a, b, q) < 0) or on(p, q, a) or on(p, q, b) or on(a, b, p) or on(a, b, q)


def test_blocked_segments_and_points(spark):
    rng = random.Random(8)
    # An L, a star-like ring, a diamond on whole coordinates, a large square around all of it but with a gap to the others.
    shapes = {"l": [(2, 2), (8, 2), (8, 4), (4, 4), (4, 9), (2, 9)], "star": [(15, 15), (17, 20), (22, 21), (17, 23), (16, 29), (14, 22), (9, 21), (14, 19)], "diamond": [(20, 5), (24, 9), (20, 13), (16, 9)]}
    segments = [(i, *(float(v) for _ in range(2) for v in (rng.randrange(30), rng.randrange(30)))) for i in range(60)]
    segments = [(i, x1, y1, x1 + (x2 - x1) / 8, y1 + (y2 - y1) / 8) if i % 2 else (i, x1, y1, x2, y2) for i, x1, y1, x2, y2 in segments]
    polygons = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in shapes.items()], SHAPES)
    want = set()
    for i, x1, y1, x2, y2 in segments:
        for k, ring in shapes.items():
            if inside((x1, y1), ring) or any(meets((x1, y1), (x2, y2), a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)):
                want.add((i, k))
    assert set(rows(obstacles.blocked(spark.createDataFrame(segments, SEGMENTS), polygons, 3.0))) == want and len(want) > 20
    grid = [(i, float(i % 30), float(i // 30)) for i in range(900)]
    points = spark.createDataFrame(grid, "id long, x double, y double")
    on = {(i, k) for i, x, y in grid for k, r in shapes.items() if inside((x, y), r) or any(meets((x, y), (x, y), a, b) for a, b in zip(r, r[1:] + r[:1], strict=True))}
    assert set(rows(obstacles.blocked_points(points, polygons, 4.0))) == on
    assert obstacles.blocked(spark.createDataFrame(segments, SEGMENTS), polygons.where("false"), 3.0).count() == 0


def test_polygon_files(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, [[1, 1], [2, 1], [2, 2]]]}, "properties": {}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 1]}, "properties": {}}]}
    (tmp_path / "o.json").write_text(json.dumps(body, indent=1))
    got = geojson.polygons(spark, f"file://{tmp_path}/o.json").collect()
    assert [[(p.x, p.y) for p in r.ring] for r in got] == [[(0, 0), (4, 0), (4, 4), (0, 0)]]
    found = obstacles.blocked(spark.createDataFrame([(1, 3.0, 1.0, 3.5, 1.0), (2, 1.0, 3.0, 1.0, 3.5)], SEGMENTS), geojson.polygons(spark, f"file://{tmp_path}/o.json"), 1.0)
    assert rows(found, "id") == [(1,)]


def test_course_penalties_equal_all_pairs(spark):
    rng = random.Random(9)
    courses = [(f"e{i % 5}", [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(rng.randrange(2, 5))]) for i in range(8)]
    hops = [(i, float(x), float(y), float(x + dx), float(y + dy)) for i, (x, y, dx, dy) in enumerate((x, y, dx, dy) for x in range(0, 20, 2) for y in range(0, 20, 2) for dx, dy in ((2, 0), (0, 2), (2, 2)))]

    def to(p, line):
        best = math.inf
        for a, b in zip(line, line[1:], strict=False):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.dist(p, (a[0] + t * dx, a[1] + t * dy)))
        return best

    want = {}
    for e, line in courses:
        for i, x1, y1, x2, y2 in hops:
            d = max(to((x1, y1), line), to((x2, y2), line)) / 2
            want[e, i] = min(want.get((e, i), math.inf), 3 * d * d)
    want = {k: v for k, v in want.items() if v <= 10}
    df = spark.createDataFrame(courses, "edge_id string, geom array<struct<x: double, y: double>>")
    got = {(r.edge_id, r.id): r.penalty for r in obstacles.course_penalties(spark.createDataFrame(hops, SEGMENTS), df, 2.0, 3.0, 10.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_origins_follow_every_stage(spark):
    g = graph(spark, {"a": (0, 0), "b": (100, 0), "c": (200, 0), "d": (300, 0), "e": (300, 100)}, {"1": [("a", "b", None), ("b", "c", None), ("c", "d", None)], "2": [("d", "e", None), ("c", "e", None)]}).tracked()
    contracted = topology.contract_stray(g)
    assert rows(contracted.origins) == [("a-c", "a-b"), ("a-c", "b-c"), ("c-d", "c-d"), ("c-e", "c-e"), ("d-e", "d-e")]
    folded = structure.remap(contracted, spark.createDataFrame([("e", "d")], "node_id string, into string"))
    assert rows(folded.origins) == [("a-c", "a-b"), ("a-c", "b-c"), ("c-d", "c-d"), ("c-d", "c-e")]
    stats = structure.merged_edges(folded).first()
    assert (stats.edges, stats.mean_merged, stats.max_merged) == (2, 2.0, 2)
    split = topology.split_edges(folded, spark.createDataFrame([("c-d", 0.5, "x")], "edge_id string, share double, node_id string"))
    assert rows(split.origins) == [("a-c", "a-b"), ("a-c", "b-c"), ("c-x", "c-d"), ("c-x", "c-e"), ("d-x", "c-d"), ("d-x", "c-e")]
    halves = ordergraph.cut_single(folded.with_(occs=folded.occs.where("line_id = '1'")))
    assert {r.original_id for r in halves.origins.collect()} == {"a-b", "b-c", "c-d", "c-e"}
    assert chains.combine_degree_two(g).edges.count() == 4 and g.with_(origins=None).traced(g.edges) is None


def test_geometry_stays_through_cuts_and_contraction(spark):
    g = graph(spark, {"a": (0, 0), "b": (0, 10), "c": (10, 10)}, {"1": [("a", "b", None), ("b", "c", None)]})
    geom = spark.createDataFrame([("a-b", [(0.0, 0.0), (5.0, 5.0), (0.0, 10.0)]), ("b-c", [(0.0, 10.0), (10.0, 10.0)])], "edge_id string, geom array<struct<x: double, y: double>>")
    g = g.with_(edges=g.edges.join(geom, "edge_id"))
    cut = topology.split_edges(g, spark.createDataFrame([("a-b", 0.5, "z")], "edge_id string, share double, node_id string"))
    shape = {r.edge_id: [(round(p.x, 6), round(p.y, 6)) for p in r.geom] for r in cut.edges.collect()}
    assert shape == {"a-z": [(0, 0), (5, 5)], "b-z": [(0, 10), (5, 5)], "b-c": [(0, 10), (10, 10)]}
    assert {(r.x, r.y) for r in cut.nodes.where("node_id = 'z'").collect()} == {(5, 5)}
    one = topology.contract_stray(g).edges.collect()
    assert [[(p.x, p.y) for p in r.geom] for r in one] == [[(0, 0), (5, 5), (0, 10), (10, 10)]]
