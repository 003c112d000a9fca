"""Pairs of blocks are dealt out evenly, and what is counted or tested in them equals brute force."""

import random
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import functions as F

from tramlines.operators import blocks, obstacles

BLOCKS = "block long, bx1 double, by1 double, bx2 double, by2 double"
SEGMENTS = "id long, x1 double, y1 double, x2 double, y2 double"
RINGS = "polygon long, ring array<struct<x: double, y: double>>"


def test_blocks_of_large_boxes_meet_in_many_places(spark):
    rng = random.Random(1)
    boxes = [(k, rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(9, 10), rng.uniform(9, 10)) for k in range(60)] + [(60 + k, 20.0 + 3 * k, 0.0, 22.0 + 3 * k, 1.0) for k in range(20)]
    df = spark.createDataFrame(boxes, BLOCKS)
    found = blocks.met(df, None, 1.0).select("a_block", "b_block", F.spark_partition_id().alias("p")).collect()
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    want = {(a[0], b[0]) for a, b in combinations_with_replacement(boxes, 2) if meet(a, b)}
    assert {(r.a_block, r.b_block) for r in found} == want and len(found) == len(want)
    per = np.bincount([r.p for r in found])
    assert per.max() < 0.5 * len(found)  # of 4 tasks; cells alone gave nearly all to one
    one, two = df.where("block < 50"), df.where("block >= 50")
    pairs = [(r.a_block, r.b_block) for r in blocks.met(one, two, 1.0).collect()]
    assert set(pairs) == {(a[0], b[0]) for a in boxes[:50] for b in boxes[50:] if meet(a, b)} and len(pairs) == len(set(pairs))
    assert blocks.met(df.where("false"), None, 1.0).count() == 0


def test_counts_of_rings_equal_pairs(spark):
    rng = random.Random(5)
    at = lambda: (float(rng.randrange(-20, 20)), float(rng.randrange(-20, 20)))
    # Whole coordinates: corners on segments, shared ends, sides along segments, rings without area.
    rings = [[at() for _ in range(3)] for _ in range(500)]
    rings += [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)][:: rng.choice((1, -1))] for (x, y), w, h in ((at(), rng.randrange(1, 9), rng.randrange(1, 9)) for _ in range(60))]
    rings += [[at() for _ in range(rng.randrange(4, 8))] for _ in range(60)] + [[(0.0, 0.0), (4.0, 4.0), (8.0, 8.0)], [(1.0, 1.0)], [], [(0.0, 0.0), (0.0, 0.0), (5.0, 0.0), (0.0, 5.0), (0.0, 0.0)]]
    turns = np.array([(np.cos(k * 4 * np.pi / 5), np.sin(k * 4 * np.pi / 5)) for k in range(5)])  # a star whose sides all turn one way
    rings.append([(float(x), float(y)) for x, y in turns * 15])
    segments = [(i, *at(), *at()) for i in range(700)] + [(700 + i, x, y, x, y) for i, (x, y) in enumerate(at() for _ in range(60))]
    segments += [(800 + i, *(rng.uniform(-20, 20) for _ in range(4))) for i in range(100)]
    polygons, df = spark.createDataFrame(list(enumerate(rings)), RINGS), spark.createDataFrame(segments, SEGMENTS)
    want = {r.id: r.n for r in obstacles.blocked(df, polygons, 4.0).groupBy("id").agg(F.count("*").alias("n")).collect()}
    found = obstacles.blocked_counts(df, polygons, 4.0).collect()
    assert {r.id: r.n for r in found} == want and len(found) == len(want) > 700
    assert obstacles.blocked_counts(df, polygons.where("false"), 4.0).count() == 0


def test_convex_rings_are_told_by_their_corners():
    x = np.array([[0.0, 1, 1, 0], [0, 0, 1, 1], [0, 2, 0, 0.5], [0, 1, 2, 1]])
    y = np.array([[0.0, 0, 1, 1], [0, 1, 1, 0], [0, 0, 2, 0.5], [0, 0, 0, 1]])
    assert list(obstacles._convex(x, y, 1e-12)) == [1, -1, 0, 0]
