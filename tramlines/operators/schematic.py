"""Schematic drawing costs: grid candidates, octilinear directions, bends and displacement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from ..model import LineGraph
from .algebra import continuations


def grid_candidates(points: DataFrame, size: float, reach: int) -> DataFrame:
    """(id, gx, gy, d, rank): grid points at most `reach` cells away from each point, nearest first."""
    steps = F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")))
    rows = points.select("id", "x", "y", F.round(F.col("x") / size).cast("long").alias("cx"), F.round(F.col("y") / size).cast("long").alias("cy")).withColumn("i", steps).withColumn("j", steps)
    rows = rows.select("id", (F.col("cx") + F.col("i")).alias("gx"), (F.col("cy") + F.col("j")).alias("gy"), "x", "y")
    rows = rows.withColumn("d", F.round(F.sqrt((F.col("gx") * size - F.col("x")) ** 2 + (F.col("gy") * size - F.col("y")) ** 2), 9)).where(F.col("d") <= reach * size)
    w = Window.partitionBy("id").orderBy("d", "gx", "gy")
    return rows.select("id", "gx", "gy", "d", F.row_number().over(w).cast("long").alias("rank"))


def split_candidates(candidates: DataFrame) -> DataFrame:
    """(id, gx, gy, d): overlapping candidate sets made disjoint: each grid point stays with the nearest
    of the points that want it, ties by id."""
    won = candidates.groupBy("gx", "gy").agg(F.min(F.struct("d", "id")).alias("m"))
    return won.select("m.id", "gx", "gy", "m.d")


def snap(points: DataFrame, size: float, reach: int, rounds: int = 1000) -> DataFrame:
    """(id, gx, gy, d): every point gets a grid point of its own, nearest first.

    In each round a free grid point takes the nearest of the points that want it (ties by id) and the
    others turn to their next free candidate; points without one left are not returned.  Rounds go on
    until nothing is placed any more, and it is an error if `rounds` are not enough.
    """
    wants = cut(grid_candidates(points, size, reach))
    placed, n = wants.where("false").select("id", "gx", "gy", "d"), 0
    for _ in range(rounds):
        free = wants.join(placed.select("gx", "gy"), ["gx", "gy"], "left_anti").join(placed.select("id"), "id", "left_anti")
        ask = free.groupBy("id").agg(F.min(F.struct("d", "gx", "gy")).alias("m")).select("id", "m.gx", "m.gy", "m.d")
        won = ask.groupBy("gx", "gy").agg(F.min(F.struct("d", "id")).alias("m")).select("m.id", "gx", "gy", "m.d")
        placed = cut(placed.unionByName(won))
        before, n = n, placed.count()
        if n == before:
            return placed
    raise RuntimeError(f"snapping did not settle in {rounds} rounds")


def octant(dx: Column, dy: Column) -> Column:
    """Direction 0..7 in steps of 45 degrees, clockwise from north, nearest to the vector."""
    return F.pmod(F.round(F.round(F.atan2(dx, dy) / (math.pi / 4), 9)).cast("long"), F.lit(8))


def edge_octants(g: LineGraph) -> DataFrame:
    """(node_id, edge_id, octant): the direction in which an edge leaves each of its nodes."""
    at = g.nodes.select("node_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    to = g.nodes.select(F.col("node_id").alias("other"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    rows = g.incidence().join(at, "node_id").join(to, "other")
    return rows.select("node_id", "edge_id", octant(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("octant"))


def bends(g: LineGraph, p180: float = 0.0, p135: float = 1.0, p90: float = 1.5, p45: float = 2.0) -> DataFrame:
    """(line_id, turns, cost): bends of every line over all nodes it runs over, priced by angle."""
    o = edge_octants(g)
    a = o.select("node_id", F.col("edge_id").alias("edge_a"), F.col("octant").alias("oa"))
    b = o.select("node_id", F.col("edge_id").alias("edge_b"), F.col("octant").alias("ob"))
    rows = continuations(g).where("edge_a < edge_b").join(a, ["node_id", "edge_a"]).join(b, ["node_id", "edge_b"])
    gap = F.pmod(F.col("oa") - F.col("ob"), F.lit(8))
    angle = F.least(gap, 8 - gap)  # 4: straight on
    price = F.when(angle == 4, p180).when(angle == 3, p135).when(angle == 2, p90).otherwise(p45)
    return rows.groupBy("line_id").agg(F.sum(F.when(angle == 4, 0).otherwise(1)).cast("long").alias("turns"), F.round(F.sum(price), 6).alias("cost"))


def parallel_offsets(order: DataFrame, width: float = 20.0, outline: float = 1.0, spacing: float = 10.0) -> DataFrame:
    """(edge_id, line_id, offset): each line's distance from the edge's centre line."""
    step = width + 2 * outline + spacing
    return order.select("edge_id", "line_id", F.round((F.col("pos") - (F.col("lines") - 1) / 2) * step, 6).alias("offset"))
