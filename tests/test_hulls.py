"""Convex hulls against brute force, and grids cut to them."""

import math
import random

import numpy as np

from tests.test_line_graph import rows
from tests.test_dense_joins import shuffled
from tramlines.operators import hulls


def corners(points):
    """Points that a line through them separates from all others: no two others hold them between them, and no triangle."""
    pts = sorted(set(points))
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    if len(pts) < 3 or all(cross(pts[0], pts[-1], p) == 0 for p in pts):
        return {pts[0], pts[-1]} if pts else set()
    out = set()
    for a in pts:
        for b in pts:
            if a != b and all(cross(a, b, c) > 0 or (cross(a, b, c) == 0 and min(a, b) <= c <= max(a, b)) for c in pts):
                out |= {a, b}
    return out


def test_hulls_equal_brute_force(spark):
    rng = random.Random(5)
    data = {k: [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(n)] for k, n in (("a", 60), ("b", 1), ("c", 2), ("d", 40), ("e", 7))}
    data["line"] = [(float(i), 2.0 * i) for i in range(10)]
    data["same"] = [(1.0, 1.0)] * 5
    given = [(k, x, y) for k, ps in data.items() for x, y in ps] + [("a", None, 1.0), ("a", float("nan"), 99.0), ("none", None, None), (None, 3.0, 4.0)]
    df = spark.createDataFrame(given, "k string, x double, y double").repartition(4)
    got = {r.k: [(p.x, p.y) for p in r.hull] for r in hulls.convex_hulls(df, "k").collect()}
    assert got.pop(None) == [(3.0, 4.0)]
    assert {k: set(v) for k, v in got.items()} == {k: corners(ps) for k, ps in data.items()}
    for v in got.values():
        if len(v) > 2:
            area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(v, v[1:] + v[:1], strict=True))
            assert area > 0 and v[0] == min(v)
    assert hulls.convex_hulls(df.where("false"), "k").count() == 0


def test_large_hull_takes_few_corners(spark):
    t = np.linspace(0, 2 * math.pi, 13)[:-1]
    ring = [(1, math.cos(a) * 10, math.sin(a) * 10) for a in t]
    inner = [(1, random.Random(i).uniform(-6, 6), random.Random(-i).uniform(-6, 6)) for i in range(3000)]
    got = hulls.convex_hulls(spark.createDataFrame(ring + inner, "k long, x double, y double").repartition(6), "k").first()
    assert len(got.hull) == 12


def test_grid_in_a_triangle(spark):
    nodes = spark.createDataFrame([("t", 0.0, 0.0), ("t", 4.0, 0.0), ("t", 0.0, 4.0), ("u", 7.0, 7.0), ("u", 9.0, 9.0)], "k string, x double, y double")
    points, edges = hulls.hull_grid(nodes, "k", 1.0)
    assert rows(points, "k", "gx", "gy") == [("t", x, y) for x in range(5) for y in range(5) if x + y <= 4]
    at = {(x, y) for x in range(5) for y in range(5) if x + y <= 4}
    want = {(x, y, x + dx, y + dy) for x, y in at for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (x + dx, y + dy) in at}
    assert {tuple(r) for r in edges.select("gx", "gy", "to_gx", "to_gy").collect()} == want
    assert {r.dir for r in edges.where("to_gx = gx and to_gy = gy + 1").collect()} == {0}


def test_edges_of_a_tall_grid_come_from_its_columns(spark):
    n, key = 30_000, "spark.sql.autoBroadcastJoinThreshold"
    nodes = spark.createDataFrame([(k, x, y) for k in (1, 2) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, float(n)), (0.0, float(n)))], "zone long, x double, y double")
    was = spark.conf.get(key)
    before = shuffled(spark)
    try:
        spark.conf.set(key, "-1")
        points, edges = hulls.hull_grid(nodes, "zone", 1.0)
        counts = {(r.zone, r.dir): r["count"] for r in edges.groupBy("zone", "dir").count().collect()}
        assert points.count() == 2 * 3 * (n + 1)
    finally:
        spark.conf.set(key, was)
    sizes = [3 * n, 2 * n, 2 * (n + 1), 2 * n, 3 * n, 2 * n, 2 * (n + 1), 2 * n]
    assert counts == {(k, d): c for k in (1, 2) for d, c in enumerate(sizes)}
    assert shuffled(spark) - before < 5_000  # of 180,006 points and 1,020,024 edges
    assert edges.where("zone = 1 and gx = 1 and gy = 7 and dir = 3").select("to_gx", "to_gy").first() == (2, 6)
