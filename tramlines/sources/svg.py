"""Line graphs as SVG fragments, one element a row, in drawing order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fx
from ..model import LineGraph
from ..operators.ordering import default_order
from ..operators.schematic import parallel_offsets


def elements(g: LineGraph, scale: float = 100.0) -> DataFrame:
    """(z, part, value): offset lines under station circles; sort by z and part and join for a drawing."""
    offsets = parallel_offsets(default_order(g), 4.0, 0.5, 1.0)
    at = lambda c: g.nodes.select(F.col("node_id").alias(c), (F.col("x") * scale).alias(f"x{c}"), (F.col("y") * scale).alias(f"y{c}"))
    rows = g.edges.join(offsets, "edge_id").join(at("a"), "a").join(at("b"), "b")
    length = F.expr("nullif(sqrt(pow(xb - xa, 2) + pow(yb - ya, 2)), 0)")
    dx, dy = F.coalesce((F.col("ya") - F.col("yb")) / length * F.col("offset"), F.lit(0.0)), F.coalesce((F.col("xb") - F.col("xa")) / length * F.col("offset"), F.lit(0.0))
    rows = rows.withColumn("dx", dx).withColumn("dy", dy)
    points = F.array(F.struct(F.expr("xa + dx").alias("x"), F.expr("ya + dy").alias("y")), F.struct(F.expr("xb + dx").alias("x"), F.expr("yb + dy").alias("y")))
    colour = F.concat(F.lit("fill:none;stroke-width:4;stroke:#"), F.substring(F.md5(F.col("line_id").cast("string")), 1, 6))
    lines = rows.select(F.lit(0).alias("z"), F.concat_ws("/", "edge_id", "line_id").alias("part"), fx.svg_polyline(points, colour).alias("value"))
    spots = g.nodes.select(F.lit(1).alias("z"), F.col("node_id").cast("string").alias("part"), fx.svg_circle(F.col("x") * scale, F.col("y") * scale, F.lit(5.0), F.lit("fill:#fff;stroke:#000")).alias("value"))
    return lines.union(spots)
