"""Geometries of one edge: absorption and weighted means against plain versions."""

import math
import random

from tramlines.operators import courses

COURSE = "edge_id string, course string, geom array<struct<x: double, y: double>>, weight double"


def table(spark, rows):
    return spark.createDataFrame(rows, COURSE).repartition(3)


def length(p):
    return sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False))


def at(p, share):
    goal = share * length(p)
    for a, b in zip(p, p[1:], strict=False):
        d = math.dist(a, b)
        if goal <= d + 1e-12:
            return tuple(u + (v - u) * (goal / d if d else 0) for u, v in zip(a, b, strict=True))
        goal -= d
    return p[-1]


def to(p, q):
    """Distance of a point to a polyline."""
    best = math.inf
    for a, b in zip(q, q[1:], strict=False):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy or 1)))
        best = min(best, math.dist(p, (a[0] + t * dx, a[1] + t * dy)))
    return best


def wobble(rng, end, size):
    return [(0.0, 0.0)] + [(end * i / 4, rng.uniform(-size, size)) for i in range(1, 4)] + [(float(end), 0.0)]


def test_absorption_by_the_longest_that_holds(spark):
    rng = random.Random(2)
    rows = []
    for e in range(6):
        rows += [(f"e{e}", f"c{i}", wobble(rng, rng.choice([40, 100, 160]), rng.choice([5, 30, 60])), float(i + 1)) for i in range(7)]
    got = {(r.edge_id, r.course): r.weight for r in courses.absorb(table(spark, rows), 20.0).collect()}
    want = {}
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e]
        holds = lambda a, b: all(to(v, a) <= 20 for v in b)
        into = {}
        for _, c, p, _ in mine:
            cands = [(length(q), d) for _, d, q, _ in mine if length(q) > length(p) and holds(q, p) and not holds(p, q)]
            if cands:
                into[c] = cands
        top = max((length(q), d) for _, d, q, _ in mine)[1]
        for _, c, _, w in mine:
            goal = c if c not in into else max([x for x in into[c] if x[1] not in into], default=(0, top))[1]
            want[e, goal] = want.get((e, goal), 0) + w
    assert got == want and len(got) < len(rows)


def test_means_in_any_order(spark):
    rng = random.Random(3)
    rows = [(f"e{e}", f"c{i}", wobble(rng, 100 + 10 * i, 20), float(1 + i)) for e in range(4) for i in range(5)]
    got = {r.edge_id: [(p.x, p.y) for p in r.geom] for r in courses.average(table(spark, rows), 20.0).collect()}
    for e, geom in got.items():
        mine = [(p, w) for k, _, p, w in rows if k == e]
        longest = max(length(p) for p, _ in mine)
        k = math.ceil(longest / 20)
        total = sum(w for _, w in mine)
        want = [tuple(sum(w * at(p, min(1, i * 20 / longest))[c] for p, w in mine) / total for c in (0, 1)) for i in range(k + 1)]
        assert all(min(math.dist(p, q) for q in geom) < 0.01 for p in want) or all(to(p, geom) < 0.01 for p in want)
        assert math.dist(geom[0], want[0]) < 1e-6 and math.dist(geom[-1], want[-1]) < 1e-6
    rng.shuffle(rows)
    again = {r.edge_id: [(p.x, p.y) for p in r.geom] for r in courses.average(table(spark, rows).repartition(7), 20.0).collect()}
    assert all(len(again[e]) == len(got[e]) and all(math.dist(p, q) < 1e-9 for p, q in zip(again[e], got[e], strict=True)) for e in got)


def test_straight_and_single_courses(spark):
    rows = [("a", "x", [(0.0, 0.0), (0.0, 100.0)], 2.0), ("b", "y", [(0.0, 0.0), (0.0, 0.0)], 1.0), ("c", "x", [(0.0, 0.0), (90.0, 0.0)], 1.0), ("c", "y", [(0.0, 9.0), (90.0, 9.0)], 2.0)]
    got = {r.edge_id: [(round(p.x, 6), round(p.y, 6)) for p in r.geom] for r in courses.merge(table(spark, rows), 50.0, 20.0).collect()}
    assert got["a"] == [(0, 0), (0, 100)] and set(got["b"]) == {(0, 0)} and got["c"] == [(0, 6), (90, 6)]
    assert courses.merge(table(spark, []), 50.0, 20.0).count() == 0
