"""What a drawing is made of: edge widths, node fronts, tile geometry and statistics, as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import cut
from ..model import LineGraph, with_geometry
from . import geometry
from .spatial import WORLD, cell, crossings


def edge_widths(g: LineGraph, width: float = 20.0, spacing: float = 10.0) -> DataFrame:
    """(edge_id, lines, total): how wide an edge is drawn with all its lines."""
    size = g.occs.groupBy("edge_id").agg(F.count("*").alias("lines"))
    return size.withColumn("total", F.col("lines") * (width + spacing) - spacing)


def node_fronts(g: LineGraph, widths: DataFrame, distance: float) -> DataFrame:
    """(node_id, edge_id, x1, y1, x2, y2): where an edge's lines meet a node: a line across the edge,
    as wide as its lines, `distance` away from the node (or at the edge's middle if it is shorter)."""
    at = g.nodes.select("node_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    to = g.nodes.select(F.col("node_id").alias("other"), F.col("x").alias("xo"), F.col("y").alias("yo"))
    rows = g.incidence().join(at, "node_id").join(to, "other").join(widths.select("edge_id", "total"), "edge_id")
    rows = rows.withColumn("len", F.expr("sqrt(pow(xo - x0, 2) + pow(yo - y0, 2))")).where("len > 0")
    rows = rows.withColumn("t", F.least(F.lit(distance), F.col("len") / 2)).withColumn("ux", F.expr("(xo - x0) / len")).withColumn("uy", F.expr("(yo - y0) / len"))
    side = lambda s: (F.expr(f"x0 + t * ux {s} uy * total / 2"), F.expr(f"y0 + t * uy {'-' if s == '+' else '+'} ux * total / 2"))
    (x1, y1), (x2, y2) = side("+"), side("-")
    return rows.select("node_id", "edge_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def out_angles(g: LineGraph) -> DataFrame:
    """(node_id, edge_id, angle): the direction in degrees, counter-clockwise from east, in which an edge leaves."""
    at = g.nodes.select("node_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    to = g.nodes.select(F.col("node_id").alias("other"), F.col("x").alias("xo"), F.col("y").alias("yo"))
    rows = g.incidence().join(at, "node_id").join(to, "other")
    return rows.select("node_id", "edge_id", F.degrees(F.atan2(F.col("yo") - F.col("y0"), F.col("xo") - F.col("x0"))).alias("angle"))


def stop_boxes(fronts: DataFrame, pad: float) -> DataFrame:
    """(node_id, x1, y1, x2, y2): the box around all of a node's fronts, padded."""
    xs, ys = F.array("x1", "x2"), F.array("y1", "y2")
    return fronts.groupBy("node_id").agg(
        (F.min(F.array_min(xs)) - pad).alias("x1"), (F.min(F.array_min(ys)) - pad).alias("y1"), (F.max(F.array_max(xs)) + pad).alias("x2"), (F.max(F.array_max(ys)) + pad).alias("y2")
    )


def overlapping(boxes: DataFrame, size: float) -> DataFrame:
    """(a, b): pairs of boxes (node_id, x1, y1, x2, y2) that share a point, a < b; cells are `size` wide."""
    listed = boxes.withColumn("cx", F.explode(F.sequence(cell(F.col("x1"), size), cell(F.col("x2"), size)))).withColumn("cy", F.explode(F.sequence(cell(F.col("y1"), size), cell(F.col("y2"), size))))
    other = listed.select("cx", "cy", F.col("node_id").alias("b"), F.col("x1").alias("x3"), F.col("y1").alias("y3"), F.col("x2").alias("x4"), F.col("y2").alias("y4"))
    pairs = listed.withColumnRenamed("node_id", "a").join(other, ["cx", "cy"]).where("a < b and x1 <= x4 and x3 <= x2 and y1 <= y4 and y3 <= y2")
    return pairs.select("a", "b").distinct()


def drop_overlapped(boxes: DataFrame, size: float, order: Column | None = None, rounds: int = 1000) -> DataFrame:
    """The boxes that stay if they are taken in order and one that overlaps a box taken before goes.

    In each round boxes stay that no undecided box before them overlaps, and what they overlap goes.  In
    the order of a hash (the default) a few rounds decide all; an order by place may take as many as
    the longest chain.
    """
    key = F.struct((F.xxhash64("node_id") if order is None else order).alias("k"), F.col("node_id"))
    keyed = boxes.select("node_id", key.alias("key"))
    pairs = overlapping(boxes, size)
    both = cut(pairs.union(pairs.select("b", "a")).join(keyed.select(F.col("node_id").alias("b"), F.col("key").alias("before")), "b").select(F.col("a").alias("node_id"), "b", "before"))
    open_, stay = cut(keyed), None
    for _ in range(rounds):
        if open_.isEmpty():
            return boxes.join(stay, "node_id", "left_semi") if stay is not None else boxes
        first = both.join(open_.select(F.col("node_id").alias("b")), "b", "left_semi").groupBy("node_id").agg(F.min("before").alias("first"))
        taken = open_.join(first, "node_id", "left").where("first is null or key < first").select("node_id")
        stay = cut(taken if stay is None else stay.union(taken))
        near = both.join(stay.withColumnRenamed("node_id", "b"), "b", "left_semi").select("node_id").union(stay).distinct()
        open_ = cut(open_.join(near, "node_id", "left_anti"))
    raise RuntimeError(f"boxes did not settle in {rounds} rounds")


def label_bands(g: LineGraph, stations: DataFrame, length: float, tilt: float = 0.0) -> DataFrame:
    """(node_id, turn, x1, y1, x2, y2): eight directions, 45 degrees apart from `tilt`, in which a station's name may run."""
    rows = stations.select("node_id").join(g.nodes.select("node_id", F.col("x").alias("x1"), F.col("y").alias("y1")), "node_id").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    return rows.select("node_id", "turn", "x1", "y1", (F.col("x1") + length * F.cos(F.radians(F.col("turn") * 45.0 + tilt))).alias("x2"), (F.col("y1") + length * F.sin(F.radians(F.col("turn") * 45.0 + tilt))).alias("y2"))


def label_penalties(g: LineGraph, bands: DataFrame, size: float) -> DataFrame:
    """(node_id, turn, crossed): how many edges a band crosses beyond its own node."""
    at = lambda c, n: g.nodes.select(F.col("node_id").alias(c), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    bars = bands.withColumn("id", F.concat_ws("#", F.col("node_id").cast("string"), F.col("turn").cast("string")))
    edges = g.edges.join(at("a", 1), "a").join(at("b", 2), "b").select(F.col("edge_id").alias("id"), "x1", "y1", "x2", "y2")
    n = crossings(edges, size, bars).groupBy(F.col("b").alias("id")).agg(F.count("*").alias("crossed"))
    return bars.join(n, "id", "left").select("node_id", "turn", F.coalesce("crossed", F.lit(0)).cast("long").alias("crossed"))


def best_labels(penalties: DataFrame) -> DataFrame:
    """(node_id, turn): the direction of fewest crossings; ties by the smallest turn."""
    return penalties.groupBy("node_id").agg(F.min(F.struct("crossed", "turn")).alias("m")).select("node_id", "m.turn")


def open_fronts(g: LineGraph, fronts: DataFrame, stations: DataFrame, pitch: float) -> DataFrame:
    """(node_id, edge_id): fronts of edges longer than `pitch`, of edges with a station at either end, and
    of those whose front at the other end is more than six pitches away from the node there.

    `pitch` is a line's width with its outlines and the space to the next one.
    """
    long = with_geometry(g).edges.select("edge_id", (geometry.length(F.col("geom")) > pitch).alias("long"))
    served = g.incidence().join(stations.select("node_id"), "node_id", "left_semi").select("edge_id").distinct().withColumn("served", F.lit(True))
    at = g.nodes.select("node_id", "x", "y")
    side = F.array(geometry.point(F.col("x1"), F.col("y1")), geometry.point(F.col("x2"), F.col("y2")))
    away = fronts.join(at, "node_id").select(F.col("node_id").alias("other"), "edge_id", (geometry.nearest_on(side, F.col("x"), F.col("y"))["d"] > 6 * pitch).alias("away"))
    rows = fronts.select("node_id", "edge_id").join(g.incidence(), ["node_id", "edge_id"]).join(away, ["other", "edge_id"]).join(long, "edge_id").join(served, "edge_id", "left")
    return rows.where("long or away or served").select("node_id", "edge_id")


def inner_connections(g: LineGraph, order: DataFrame) -> DataFrame:
    """(node_id, line_id, edge_a, edge_b, pos_a, pos_b): the strokes inside nodes, each once."""
    from .ordering import legs_of

    legs = legs_of(g, order).where("edge_a < edge_b")
    return legs.select("node_id", "line_id", "edge_a", "edge_b", F.col("sa").alias("pos_a"), F.col("sb").alias("pos_b"))


def adjacent_cliques(g: LineGraph, order: DataFrame) -> DataFrame:
    """(node_id, edge_a, edge_b, clique, lines, pos_a, pos_b, reference, z): strokes drawn as one, without gaps.

    Two strokes between the same edges lie side by side if their places differ by one on both edges, and
    so that they don't cross: seen from the node, one place up on the one edge is one down on the other.
    A clique is a run of such strokes; pos_a and pos_b are the places of its first stroke, which the
    others are drawn parallel to, reference is its line.  Larger cliques are drawn first (z from 0).
    """
    strokes = inner_connections(g, order).withColumn("turn", F.col("pos_a") + F.col("pos_b"))
    side = Window.partitionBy("node_id", "edge_a", "edge_b", "turn").orderBy("pos_a", "line_id")
    runs = strokes.withColumn("run", F.col("pos_a") - F.row_number().over(side))
    first = F.min(F.struct("pos_a", "pos_b", F.col("line_id").alias("reference")))
    cliques = runs.groupBy("node_id", "edge_a", "edge_b", "turn", "run").agg(F.count("*").alias("lines"), first.alias("f")).select("node_id", "edge_a", "edge_b", "lines", "f.*")
    number = F.row_number().over(Window.partitionBy("node_id", "edge_a", "edge_b").orderBy("pos_a", "pos_b")) - 1
    depth = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("lines"), "edge_a", "edge_b", "pos_a")) - 1
    return cliques.select("node_id", "edge_a", "edge_b", number.cast("long").alias("clique"), "lines", "pos_a", "pos_b", "reference", depth.cast("long").alias("z"))


def inner_cliques(g: LineGraph, order: DataFrame) -> DataFrame:
    """(node_id, edge_a, edge_b, lines, z): strokes between the same edges, the largest drawn first."""
    groups = inner_connections(g, order).groupBy("node_id", "edge_a", "edge_b").agg(F.count("*").alias("lines"))
    w = Window.partitionBy("node_id").orderBy(F.desc("lines"), "edge_a", "edge_b")
    return groups.withColumn("z", (F.row_number().over(w) - 1).cast("long"))


def zoom_levels(text: str) -> list[int]:
    """"3,5-7" -> [3, 5, 6, 7]."""
    out: set[int] = set()
    for part in text.split(","):
        a, _, b = part.strip().partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return sorted(out)


def zoom_width(width: float, zoom: Column, base: int = 14) -> Column:
    """A width in map units that stays as wide on the screen as `width` is at zoom `base`."""
    return width * F.pow(F.lit(2.0), F.lit(base) - zoom)


def tile_points(x: Column, y: Column, zoom: int, tx: Column, ty: Column, extent: int = 4096) -> tuple[Column, Column]:
    """Coordinates inside a web mercator tile (rows counted from the north), as vector tiles hold them."""
    width = 2 * WORLD / (1 << zoom)
    return F.floor((x + WORLD - tx * width) / width * extent).cast("long"), F.floor((WORLD - y - ty * width) / width * extent).cast("long")


def zigzag(v: Column) -> Column:
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def line_commands(xs: Column, ys: Column) -> Column:
    """The command integers of a vector tile's line string: move to, then lines by differences."""
    n = F.size(xs)
    step = lambda v: F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(v, i) - F.get(v, i - 1))
    pairs = F.flatten(F.transform(F.arrays_zip(step(xs).alias("x"), step(ys).alias("y")), lambda e: F.array(zigzag(e["x"]), zigzag(e["y"]))))
    head = F.array(F.lit(9).cast("long"), zigzag(F.get(xs, F.lit(0))), zigzag(F.get(ys, F.lit(0))), ((n - 1) * 8 + 2).cast("long"))
    return F.when(n > 1, F.concat(head, pairs))


def statistics(g: LineGraph) -> DataFrame:
    """(value): one JSON object with the counts of a graph."""
    from .algebra import counts

    c = counts(g)
    return c.select(F.to_json(F.struct(*sorted(c.columns))).alias("value"))


def world_file(x1: float, y2: float, resolution: float) -> str:
    """The six lines that place a drawing of the given resolution with its upper left corner at x1, y2."""
    return "\n".join(json.dumps(v) for v in (resolution, 0.0, 0.0, -resolution, x1, y2))
