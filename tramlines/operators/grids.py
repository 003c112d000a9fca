"""Base grids for schematic drawings as generated tables, and the costs on them.

A grid is edges(x, y, dir, to_x, to_y, cost): one row for each direction that leads from a grid point to
another.  Extents come from a bounding box; nothing is built in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """Prices of hops by direction, of bends by angle and of moving a node."""

    vertical: float = 0.0
    horizontal: float = 0.0
    diagonal: float = 0.5
    p45: float = 2.0
    p90: float = 1.5
    p135: float = 1.0
    move: float = 0.5

    def bends(self) -> list[float]:
        """By the difference of two directions in steps of 45 degrees, modulo 4: straight on, 45, 90 and 135 degrees apart."""
        straight = self.p45 - self.p135
        return [straight, straight + self.p45, straight + self.p90, self.p45]


#: Directions clockwise from north: octilinear has eight, orthogonal every second of them.
EIGHT = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
ORTHO = ((0, 1), (1, 0), (0, -1), (-1, 0))
#: Hexagonal: six directions, by the parity of the row.
HEX = (((0, 1), (1, 0), (0, -1), (-1, -1), (-1, 0), (-1, 1)), ((1, 1), (1, 0), (1, -1), (0, -1), (-1, 0), (0, 1)))


def points(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(x, y) of every grid point."""
    return spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y"))


def _hops(rows: DataFrame, width: int, height: int) -> DataFrame:
    inside = (F.col("to_x") >= 0) & (F.col("to_x") < width) & (F.col("to_y") >= 0) & (F.col("to_y") < height)
    return rows.where(inside)


def _listed(moves: tuple) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(moves)])


def _grid(spark: SparkSession, width: int, height: int, moves: Column, cost: Column) -> DataFrame:
    rows = points(spark, width, height).select("x", "y", F.explode(moves).alias("m"))
    rows = rows.select("x", "y", F.col("m.dir").cast("long").alias("dir"), (F.col("x") + F.col("m.dx")).alias("to_x"), (F.col("y") + F.col("m.dy")).alias("to_y"))
    return _hops(rows, width, height).withColumn("cost", cost)


def orthogonal(spark: SparkSession, width: int, height: int, c: Costs = Costs()) -> DataFrame:
    return _grid(spark, width, height, _listed(ORTHO), F.when(F.col("dir") % 2 == 0, c.vertical).otherwise(c.horizontal))


def octilinear(spark: SparkSession, width: int, height: int, c: Costs = Costs()) -> DataFrame:
    return _grid(spark, width, height, _listed(EIGHT), F.when(F.col("dir") % 4 == 0, c.vertical).when(F.col("dir") % 4 == 2, c.horizontal).otherwise(c.diagonal))


def hexagonal(spark: SparkSession, width: int, height: int, c: Costs = Costs()) -> DataFrame:
    moves = F.when(F.col("y") % 2 == 0, _listed(HEX[0])).otherwise(_listed(HEX[1]))
    return _grid(spark, width, height, moves, F.when(F.col("dir").isin(1, 4), c.horizontal).otherwise(c.diagonal))


def crossings(grid: DataFrame) -> DataFrame:
    """(x, y, dir, other_x, other_y, other_dir): diagonals of an octilinear grid that cross, once a cell."""
    up = grid.where("dir = 1").select("x", "y", "dir", "to_x", "to_y")
    down = grid.where("dir = 3").select(F.col("x").alias("other_x"), F.col("y").alias("other_y"), F.col("dir").alias("other_dir"))
    return up.join(down, (up.x == down.other_x) & (up.y == down.other_y - 1)).select("x", "y", "dir", "other_x", "other_y", "other_dir")


def bend_cost(i: Column, j: Column, costs: list[float]) -> Column:
    """The price of entering by direction i and leaving by direction j of an octilinear grid."""
    gap = F.pmod(i - j, F.lit(8))
    turn = F.when(gap > 4, 8 - gap).otherwise(gap) % 4
    return F.get(F.array(*map(F.lit, costs)), turn.cast("int"))


def move_penalty(d: Column, cell: float, c: Costs = Costs()) -> Column:
    """The price of drawing a node at distance d from its place: at least the hop that this could save."""
    return d / cell * (c.move + c.bends()[0] + max(c.horizontal, c.vertical))


def inside_box(grid: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """The part of a grid both of whose ends lie in a box."""
    inside = lambda x, y: (F.col(x) >= x1) & (F.col(x) <= x2) & (F.col(y) >= y1) & (F.col(y) <= y2)
    return grid.where(inside("x", "y") & inside("to_x", "to_y"))


def hull_mask(grid_points: DataFrame, hull: list[tuple[float, float]]) -> DataFrame:
    """Grid points inside a convex hull given counter-clockwise, its border included."""
    ok = F.lit(True)
    for (ax, ay), (bx, by) in zip(hull, [*hull[1:], hull[0]], strict=True):
        ok = ok & ((bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax) >= 0)
    return grid_points.where(ok)
