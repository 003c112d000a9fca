"""Hanan grids and quadtrees against scans of the whole box and plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from tramlines.operators import sparse_grids


def table(spark, points):
    return spark.createDataFrame([(k, float(x), float(y)) for k, x, y in points], "k string, x double, y double").repartition(3)


def cloud(seed, n, w, h):
    rng = random.Random(seed)
    return [(rng.randrange(w), rng.randrange(h)) for _ in range(n)]


def scanned(points, w, h):
    """Box points on at least two of the lines through the points."""
    has = [{y for _, y in points}, {x for x, _ in points}, {x - y for x, y in points}, {x + y for x, y in points}]
    return {(x, y) for x in range(w + 1) for y in range(h + 1) if (y in has[0]) + (x in has[1]) + (x - y in has[2]) + (x + y in has[3]) > 1}, has


@pytest.mark.parametrize("rounds", [1, 2])
def test_hanan_equals_a_scan(spark, rounds):
    data = {"a": cloud(1, 5, 30, 20), "b": cloud(2, 3, 15, 25), "one": [(4, 4)], "row": [(0, 0), (7, 0)]}
    points, edges = sparse_grids.hanan(table(spark, [(k, x, y) for k, ps in data.items() for x, y in ps]), "k", 1.0, rounds)
    got, ways = {}, {}
    for r in points.collect():
        got.setdefault(r.k, set()).add((r.gx, r.gy))
    for r in edges.collect():
        ways.setdefault(r.k, set()).add((r.gx, r.gy, r.dir, r.to_gx, r.to_gy, r.hops))
    for k, ps in data.items():
        x0, y0 = min(x for x, _ in ps), min(y for _, y in ps)
        mine = {(x - x0, y - y0) for x, y in ps}
        w, h = max(x for x, _ in mine), max(y for _, y in mine)
        for _ in range(rounds):
            mine, has = scanned(mine, w, h)
        assert got[k] == mine
        want = set()
        for d, f, lines in ((2, lambda p: p[1], has[0]), (0, lambda p: p[0], has[1]), (1, lambda p: p[0] - p[1], has[2]), (3, lambda p: p[0] + p[1], has[3])):
            for line in lines:
                on = sorted(p for p in mine if f(p) == line)
                want |= {(*p, d, *q, max(q[0] - p[0], abs(q[1] - p[1]))) for p, q in zip(on, on[1:], strict=False)}
        assert ways.get(k, set()) == want


def test_diagonals_cross_between_points(spark):
    edges = spark.createDataFrame([("a", 0, 0, 1, 3, 3, 3), ("a", 0, 1, 3, 1, 0, 1), ("a", 1, 4, 3, 4, 1, 3), ("b", 0, 0, 1, 1, 1, 1), ("a", 0, 0, 2, 3, 0, 3)], "k string, gx long, gy long, dir long, to_gx long, to_gy long, hops long")
    got = {(r.k, r.gx, r.gy, r.other_gx, r.other_gy) for r in sparse_grids.diagonal_crossings(edges, "k").collect()}
    assert got == {("a", 0, 0, 0, 1), ("a", 0, 0, 1, 4)}


def leaves_of(points, x, y, side, most):
    mine = [p for p in points if x <= p[0] < x + side and y <= p[1] < y + side]
    if side == 1 or len(mine) <= most:
        return [(x, y, side)]
    half = side // 2
    return [leaf for i in (0, half) for j in (0, half) for leaf in leaves_of(mine, x + i, y + j, half, most)]


@pytest.mark.parametrize("most", [0, 2])
def test_quadtree_equals_recursion(spark, most):
    data = {"a": cloud(3, 12, 30, 20), "b": cloud(4, 30, 64, 9), "one": [(5, 5)], "two": [(0, 0), (1, 1)]}
    leaves = sparse_grids.quadtree(table(spark, [(k, x, y) for k, ps in data.items() for x, y in ps]), "k", 1.0, most)
    got = {}
    for r in leaves.collect():
        got.setdefault(r.k, []).append((r.gx, r.gy, r.side))
    for k, ps in data.items():
        x0, y0 = min(x for x, _ in ps), min(y for _, y in ps)
        wide = max(1, max(x - x0 for x, _ in ps), max(y - y0 for _, y in ps))
        side = 1 << (wide - 1).bit_length()
        mine = [(min(side - 1, x - x0), min(side - 1, y - y0)) for x, y in ps]
        assert sorted(got[k]) == sorted(leaves_of(mine, 0, 0, side, most))
        assert sum(s * s for *_, s in got[k]) == side * side


def test_quadtree_sides_are_the_finest(spark):
    leaves = sparse_grids.quadtree(table(spark, [("a", x, y) for x, y in [*cloud(6, 6, 16, 16), (0, 0), (16, 16)]]), "k", 1.0)
    edges = sparse_grids.quadtree_edges(leaves, "k").collect()
    cells = [(r.gx, r.gy, r.side) for r in leaves.collect()]
    corners = {(x + i * s, y + j * s) for x, y, s in cells for i in (0, 1) for j in (0, 1)}
    plain = {(e.gx, e.gy, e.to_gx, e.to_gy) for e in edges if e.dir in (0, 2)}
    # Each side, as unit steps, is covered once, and no corner lies within an edge.
    steps = [(x + i if x != u else x, y + i if y != v else y, x == u) for x, y, u, v in plain for i in range(max(u - x, v - y))]
    assert len(steps) == len(set(steps))
    want = {(x + i, y + j * s, False) for x, y, s in cells for i in range(s) for j in (0, 1)} | {(x + j * s, y + i, True) for x, y, s in cells for i in range(s) for j in (0, 1)}
    assert set(steps) == want
    assert all((x + i * (u > x), y + i * (v > y)) not in corners for x, y, u, v in plain for i in range(1, max(u - x, v - y)))
    assert sum(e.dir in (1, 3) for e in edges) == 2 * len(cells)
    assert sparse_grids.quadtree(leaves.where("false").select("k", F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), "k", 1.0).count() == 0


def test_grid_points_are_counted_in_place(spark):
    """Neither families are collected into lists, nor do places on a line take two columns of a sort."""
    nodes = spark.createDataFrame([(1, float(i), float(i * i % 7)) for i in range(5)], "k long, x double, y double")
    plan = sparse_grids.hanan(nodes, "k", 1.0, 2)[1]._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "bit_or" in plan
