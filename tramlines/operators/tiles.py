"""Lines cut to the tiles of the web mercator grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import WORLD

#: Units of a tile's side in the files, and how many of them lines reach beyond it.
EXTENT, PAD = 1024, 50


def tiled(lines: DataFrame, zooms: list[int], extent: int = EXTENT, pad: float = PAD) -> DataFrame:
    """(z, tx, ty, id, part, points): the parts of lines (id, geom) in each tile that they touch, ty from the north.

    A segment belongs to a tile if it meets the tile's box, `pad` units wider on every side; consecutive
    segments of a line make a part.  Each segment goes to the tiles of its own box only, so a line
    across the map does not visit all tiles of its box, and no task holds a line's tiles together.
    """
    steps = F.transform(F.slice("geom", F.lit(1), F.size("geom") - 1), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get("geom", i + 1)["x"].alias("x2"), F.get("geom", i + 1)["y"].alias("y2")))
    rows = lines.where(F.size("geom") > 1).select("id", F.posexplode(steps).alias("i", "s")).select("id", "i", "s.*", F.explode(F.array(*[F.lit(z) for z in zooms])).alias("z"))
    rows = rows.withColumn("last", F.expr("shiftleft(1L, z) - 1")).withColumn("w", 2 * WORLD / (F.col("last") + 1))
    margin = F.col("w") * pad / extent
    index = lambda v: F.least(F.col("last"), F.greatest(F.lit(0), F.floor((v + WORLD) / F.col("w")))).cast("long")
    span = lambda c: F.explode(F.sequence(index(F.least(f"{c}1", f"{c}2") - margin), index(F.greatest(f"{c}1", f"{c}2") + margin)))
    rows = rows.withColumn("m", margin).withColumn("tx", span("x")).withColumn("sy", span("y"))
    for c, t in (("x", "tx"), ("y", "sy")):
        rows = rows.withColumn(f"b{c}1", F.col(t) * F.col("w") - WORLD - F.col("m")).withColumn(f"b{c}2", (F.col(t) + 1) * F.col("w") - WORLD + F.col("m"))
    overlap = F.expr("greatest(x1, x2) >= bx1 and least(x1, x2) <= bx2 and greatest(y1, y2) >= by1 and least(y1, y2) <= by2")
    # Not all corners on one side of the segment's line.
    corners = F.array(*[F.expr(f"signum((x2 - x1) * (b{y} - y1) - (y2 - y1) * (b{x} - x1))") for x in ("x1", "x2") for y in ("y1", "y2")])
    hit = rows.where(overlap & ~(F.forall(corners, lambda s: s > 0) | F.forall(corners, lambda s: s < 0)))
    run = Window.partitionBy("z", "tx", "sy", "id").orderBy("i")
    parts = hit.withColumn("part", F.col("i") - F.row_number().over(run))
    ends = F.array_sort(F.collect_list(F.struct("i", "x1", "y1", "x2", "y2")))
    joined = parts.groupBy("z", "last", "tx", "sy", "id", "part").agg(ends.alias("e"))
    point = lambda e, n: F.struct(e[f"x{n}"].alias("x"), e[f"y{n}"].alias("y"))
    points = F.concat(F.transform("e", lambda e: point(e, 1)), F.array(point(F.element_at("e", -1), 2)))
    number = F.row_number().over(Window.partitionBy("z", "tx", "sy", "id").orderBy("part")) - 1
    return joined.select("z", "tx", (F.col("last") - F.col("sy")).alias("ty"), "id", number.cast("long").alias("part"), points.alias("points"))
