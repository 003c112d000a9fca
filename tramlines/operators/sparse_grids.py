"""Grids with points only where nodes are: crossings of the nodes' lines, and quadtrees.

Both are made for all keys (maps, components, zones) at once, each from its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _boxes(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def _cells(nodes: DataFrame, key: str, size: float) -> DataFrame:
    """(key, gx, gy, w, h): the cell of each node from the lower left of its key's box, and that box in cells."""
    cell = lambda v: F.floor((F.col(v) - F.col(f"{v[0]}0")) / size).cast("long")
    boxed = _boxes(nodes, key).select(F.col(key).alias("_key"), "x0", "y0", cell("x1").alias("w"), cell("y1").alias("h"))
    met = nodes.join(boxed, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return met.select(key, cell("x").alias("gx"), cell("y").alias("gy"), "w", "h")


#: Lines through a point: family, the expression that is constant on one, and its direction (clockwise from up, in eighths).
FAMILIES = (("row", "gy", 2), ("column", "gx", 0), ("rising", "gx - gy", 1), ("falling", "gx + gy", 3))


def _crossings(points: DataFrame, key: str) -> DataFrame:
    """(key, gx, gy, w, h, families): box points on two or more of the four families' lines through given points.

    Every line lists its points within the box, and those listed twice or more stay: no pairs of lines
    are made.  families has a bit for each family, as numbers are aggregated in place where lists are not.
    """
    line = F.explode(F.array(*[F.struct(F.lit(i).alias("family"), F.expr(at).alias("at")) for i, (_, at, _) in enumerate(FAMILIES)]))
    lines = points.select(key, "w", "h", line.alias("l")).select(key, "w", "h", "l.family", "l.at").distinct()
    first = F.expr("CASE family WHEN 1 THEN 0 WHEN 2 THEN greatest(0, at) WHEN 3 THEN greatest(0, at - h) ELSE 0 END").cast("long")
    last = F.expr("CASE family WHEN 1 THEN h WHEN 2 THEN least(w, h + at) WHEN 3 THEN least(w, at) ELSE w END").cast("long")
    spread = lines.withColumn("_from", first).withColumn("_to", last).where("_from <= _to").withColumn("i", F.explode(F.sequence("_from", "_to")))
    gx, gy = F.expr("CASE family WHEN 1 THEN at ELSE i END"), F.expr("CASE family WHEN 0 THEN at WHEN 1 THEN i WHEN 2 THEN i - at ELSE at - i END")
    met = spread.select(key, gx.alias("gx"), gy.alias("gy"), "w", "h", F.expr("shiftleft(1, family)").alias("bit"))
    # The box is its key's own, so it need not be grouped by.
    return met.groupBy(key, "gx", "gy").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.bit_or("bit").alias("families")).where("bit_count(families) > 1")


def hanan(nodes: DataFrame, key: str, size: float, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """The octilinear Hanan grid of each key's nodes (key, x, y), cells of `size`.

    Lines run through every node's cell along rows, columns and both diagonals; grid points are where
    two of them meet within the box, for `rounds` rounds, each with the lines through the points of the
    one before.  points(key, gx, gy); edges(key, gx, gy, dir, to_gx, to_gy, hops) join neighbours on a
    line, one row each, dir 0 to 3 clockwise from up.
    """
    points = _cells(nodes, key, size)
    for _ in range(rounds):
        points = _crossings(points.select(key, "gx", "gy", "w", "h"), key)
    case = lambda values: F.expr("CASE family " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END")
    on = points.select(key, "gx", "gy", "families", F.explode(F.array(*map(F.lit, range(len(FAMILIES))))).alias("family")).where("families & shiftleft(1, family) <> 0")
    on = on.select(key, "family", case(at for _, at, _ in FAMILIES).alias("at"), F.expr("CASE family WHEN 1 THEN gy ELSE gx END").alias("i"))
    # A place on a line is one number; `at` tells most lines apart, so rows are sorted by it first.
    ways = on.withColumn("j", F.lead("i").over(Window.partitionBy("at", "family", key).orderBy("i"))).where("j is not null")
    x, y = (lambda v: case((v, "at", v, v))), (lambda v: case(("at", v, f"{v} - at", f"at - {v}")))
    ways = ways.select(key, x("i").alias("gx"), y("i").alias("gy"), case(d for _, _, d in FAMILIES).cast("long").alias("dir"), x("j").alias("to_gx"), y("j").alias("to_gy"), (F.col("j") - F.col("i")).alias("hops"))
    return points.select(key, "gx", "gy"), ways


def diagonal_crossings(edges: DataFrame, key: str) -> DataFrame:
    """(key, gx, gy, to_gx, to_gy, other_gx, other_gy, other_to_gx, other_to_gy): a rising and a falling edge that meet between grid points.

    Each edge lists the unit cells that it runs through; two diagonals of a cell cross in its middle.
    """
    unit = edges.where("dir in (1, 3)").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hops") - 1)))
    cell = unit.withColumn("cx", F.col("gx") + F.col("i")).withColumn("cy", F.when(F.col("dir") == 1, F.col("gy") + F.col("i")).otherwise(F.col("gy") - F.col("i") - 1))
    down = cell.where("dir = 3").select(key, "cx", "cy", *[F.col(c).alias(f"other_{c}") for c in ("gx", "gy", "to_gx", "to_gy")])
    return cell.where("dir = 1").join(down, [key, "cx", "cy"]).select(key, "gx", "gy", "to_gx", "to_gy", "other_gx", "other_gy", "other_to_gx", "other_to_gy")


def quadtree(nodes: DataFrame, key: str, size: float, most: int = 0) -> DataFrame:
    """(key, level, gx, gy, side): the leaves of each key's quadtree, corners and sides in cells of `size`.

    The root is the smallest square of 2^k cells from the lower left of the key's box that holds it; a
    square with more than `most` nodes is split, down to single cells.  Every node counts for its square
    on every level, and the counts tell all levels at once.
    """
    boxes = _boxes(nodes, key)
    wide = F.greatest(F.lit(1.0), F.ceil(F.round(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / size, 9)))
    roots = boxes.select(F.col(key).alias("_key"), "x0", "y0", F.ceil(F.round(F.log2(wide), 9)).cast("int").alias("depth"))
    inside = lambda v: F.least(F.expr("shiftleft(1L, depth)") - 1, F.floor((F.col(v) - F.col(f"{v}0")) / size)).cast("long")
    placed = nodes.join(roots, F.col(key).eqNullSafe(F.col("_key"))).select(key, "depth", inside("x").alias("ix"), inside("y").alias("iy"))
    levels = placed.where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    at = lambda c: F.expr(f"shiftright({c}, depth - level)")
    split = levels.groupBy(key, "depth", "level", at("ix").alias("qx"), at("iy").alias("qy")).agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    below = split.withColumn("p", parts).select(key, "depth", (F.col("level") + 1).alias("level"), (2 * F.col("qx") + F.col("p.i")).alias("qx"), (2 * F.col("qy") + F.col("p.j")).alias("qy"))
    top = roots.select(F.col("_key").alias(key), "depth", F.lit(0).alias("level"), F.lit(0).cast("long").alias("qx"), F.lit(0).cast("long").alias("qy"))
    gone = split.select(F.col(key).alias("_key"), F.col("level").alias("_level"), F.col("qx").alias("_qx"), F.col("qy").alias("_qy"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("level") == F.col("_level")) & (F.col("qx") == F.col("_qx")) & (F.col("qy") == F.col("_qy"))
    leaves = below.unionByName(top).join(gone, same, "left_anti")
    side = F.expr("shiftleft(1L, depth - level)")
    return leaves.select(key, F.col("level").cast("long").alias("level"), (F.col("qx") * side).alias("gx"), (F.col("qy") * side).alias("gy"), side.alias("side"))


def quadtree_edges(leaves: DataFrame, key: str) -> DataFrame:
    """(key, gx, gy, dir, to_gx, to_gy, hops): both diagonals of every leaf and its sides.

    Where smaller leaves stand beside a larger one, their sides take the place of its side: of the sides
    from one corner in one direction the shortest stays.
    """
    d = F.col("side")
    end = lambda i, x, y, dx, dy: F.struct(F.lit(i).cast("long").alias("dir"), (F.col("gx") + x).alias("x"), (F.col("gy") + y).alias("y"), dx.alias("dx"), dy.alias("dy"))
    none = F.lit(0).cast("long")
    ends = F.array(end(1, none, none, d, d), end(3, none, d, d, -d), end(2, none, none, d, none), end(2, none, d, d, none), end(0, none, none, none, d), end(0, d, none, none, d))
    rows = leaves.select(key, F.explode(ends).alias("e"), "side").select(key, F.col("e.x").alias("gx"), F.col("e.y").alias("gy"), "e.dir", "e.dx", "e.dy", "side")
    kept = rows.groupBy(key, "gx", "gy", "dir").agg(F.min("side").alias("hops"), F.min_by(F.struct("dx", "dy"), "side").alias("m"))
    return kept.select(key, "gx", "gy", "dir", (F.col("gx") + F.col("m.dx")).alias("to_gx"), (F.col("gy") + F.col("m.dy")).alias("to_gy"), "hops")
