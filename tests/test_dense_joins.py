"""Spatial joins whose matches are a large share of all pairs: results by brute force, shuffles in proportion to the input."""

import math
import random
from itertools import combinations

from tests.test_line_graph import rows
from tramlines.operators import obstacles, spatial, structure

SEGMENTS = "id long, x1 double, y1 double, x2 double, y2 double"
POINTS = "id long, x double, y double"


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    g = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(g.jvm.java.util.ArrayList(), False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def some_segments(n, seed):
    rng = random.Random(seed)
    return [(i, *(float(rng.randrange(-40, 40)) for _ in range(4))) for i in rng.sample(range(n), n)]


def apart(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy), t


def shares(s, o):
    (_, x1, y1, x2, y2), (_, x3, y3, x4, y4) = s, o
    den = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    return (((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / den, ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / den) if den else (-1.0, -1.0)


def test_crossings_and_segments_within_of_many_matches(spark):
    segments = some_segments(1200, 3)
    df = spark.createDataFrame(segments, SEGMENTS)
    ordered = sorted(segments)
    want = {}
    for s, o in combinations(ordered, 2):
        t, u = shares(s, o)
        if 0 < t < 1 and 0 < u < 1:
            want[s[0], o[0]] = (s[1] + t * (s[3] - s[1]), s[2] + t * (s[4] - s[2]), t, u)
    places = {s[0]: set() for s in segments}
    for (a, b), (_, _, t, u) in want.items():
        places[a].add(math.floor(t * 1e9 + 0.5) / 1e9)  # halves up
        places[b].add(math.floor(u * 1e9 + 0.5) / 1e9)
    before = shuffled(spark)
    assert {r.id: r.cuts for r in structure.cuts(df, 4.0).collect()} == {i: sorted(p) for i, p in places.items()}
    parts = structure.planarise(df, 4.0).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in parts} == {i: len(p) + 1 for i, p in places.items()}
    assert shuffled(spark) - before < 20 * len(segments)
    before = shuffled(spark)
    got = spatial.crossings(df, 4.0).collect()
    assert {(r.a, r.b): (r.x, r.y, r.t, r.u) for r in got} == want and len(got) == len(want) > 100_000
    assert shuffled(spark) - before < 20 * len(segments)
    few = spark.createDataFrame(segments[:300], SEGMENTS)
    before = shuffled(spark)
    near = spatial.segments_within(few, 0.5).collect()
    assert shuffled(spark) - before < 20 * 300
    close = {}
    for s, o in combinations(sorted(segments[:300]), 2):
        t, u = shares(s, o)
        d = min(apart(s[1:3], o[1:3], o[3:])[0], apart(s[3:], o[1:3], o[3:])[0], apart(o[1:3], s[1:3], s[3:])[0], apart(o[3:], s[1:3], s[3:])[0])
        d = 0.0 if 0 <= t <= 1 and 0 <= u <= 1 else d
        if d <= 0.5:
            close[s[0], o[0]] = round(d, 9)
    assert {(r.a, r.b): round(r.d, 9) for r in near} == close and len(near) == len(close)
    part = {(r.a, r.b) for r in spatial.crossings(few, 4.0, df.where("id >= 600")).collect()}
    cross = {(a, b) if a < b else (b, a) for a, b in want}
    assert part == {(s[0], o[0]) for s in segments[:300] for o in segments if o[0] >= 600 and s[0] != o[0] and tuple(sorted((s[0], o[0]))) in cross}
    assert rows(spatial.crossings(df.where("false"), 4.0)) == []


def test_nearest_and_projection_by_widening_cells(spark):
    rng = random.Random(4)
    # A dense cluster with equal distances and copies, and a few points far from it and from each other.
    points = [(i, rng.randrange(60) / 4.0, rng.randrange(60) / 4.0) for i in range(900)] + [(900 + i, 100.0 + 7 * i, -50.0 + 9 * i) for i in range(20)]
    df = spark.createDataFrame(points, POINTS)
    want = {}
    for i, x, y in points:
        d, target = min((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in points if j != i)
        if d <= 12:
            want[i] = (target, d)
    got = {r.id: (r.target, r.d) for r in spatial.nearest(df, df, 12.0, others=True).collect()}
    assert got == want and len(want) == 920
    assert spatial.nearest(df, df.where("false"), 12.0).count() == 0
    segments = some_segments(200, 6) + [(200, 3.0, 3.0, 3.0, 3.0), (201, 5.0, -20.0, 5.0, 30.0)]
    best = {}
    for i, x, y in points:
        d, s, t = min((round(apart((x, y), o[1:3], o[3:])[0], 9), o[0], apart((x, y), o[1:3], o[3:])[1]) for o in segments if o[0] != i)
        if d <= 12:
            best[i] = d
    found = spatial.project_on_segments(df, spark.createDataFrame(segments, SEGMENTS), 12.0, spatial.F.expr("id <> segment")).collect()
    assert {r.id: round(r.d, 9) for r in found} == best and len(found) == len(best)
    by = {o[0]: o for o in segments}
    assert all(abs(apart(next(p[1:] for p in points if p[0] == r.id), by[r.segment][1:3], by[r.segment][3:])[0] - r.d) < 1e-9 for r in found)


def test_first_cells_follow_the_density(spark):
    box = spark.createDataFrame([(10_000, 0.0, 0.0, 1.0, 1.0, 0.5)], "n long, x1 double, y1 double, x2 double, y2 double, length double")
    assert spatial._first_size(box, 1.0) == 1 / 64 and spatial._first_size(box, 1.0, 0.25) == 1 / 8 and spatial._first_size(box, 0.001) == 0.001


def test_points_and_segments_in_many_polygons(spark):
    rng = random.Random(7)
    points = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(800)]
    rings = [(k, [(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(3 + k % 4)]) for k in range(300)] + [(300, []), (301, [(0.0, 0.0)])]

    def inside(x, y, ring):
        return sum((a[1] <= y) != (b[1] <= y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1  # noqa: B905

    want = {(i, k) for i, x, y in points for k, ring in rings if inside(x, y, ring)}
    polygons = spark.createDataFrame(rings, "polygon long, ring array<struct<x: double, y: double>>")
    df = spark.createDataFrame(points, POINTS)
    before = shuffled(spark)
    got = [tuple(r) for r in obstacles.points_inside(df, polygons, 1.0).collect()]
    assert set(got) == want and len(got) == len(want) > 30_000
    also = [tuple(r) for r in obstacles.blocked_points(df, polygons, 1.0).collect()]
    assert set(also) == want and len(also) == len(want)  # no point lies on a side
    assert shuffled(spark) - before < 20 * (len(points) + len(rings))
