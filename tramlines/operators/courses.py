"""Several geometries of one edge brought to one: what lies within another is absorbed, the rest averaged.

Nothing depends on the order of trips: a geometry goes over to the longest one whose corridor holds it,
and means are sums over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry


def absorb(courses: DataFrame, corridor: float) -> DataFrame:
    """(edge_id, course, geom, weight): courses that no other one holds, with the weight of those they hold.

    courses(edge_id, course, geom, weight), the names different within an edge.  A course holds a shorter
    one all of whose vertices are within `corridor` of it, unless its own vertices are all as near to the
    shorter one: then both stay, to be averaged.  A course held by several goes to the longest (then by
    name); if that is held itself, its weight goes on to the last one.  Courses are compared within
    their edge only, in one direction of each pair.
    """
    rows = courses.select("edge_id", "course", "geom", "weight", geometry.length(F.col("geom")).alias("length"))
    small = rows.select("edge_id", F.col("course").alias("small"), F.col("geom").alias("p"), F.col("length").alias("l"))
    near = lambda a, b: F.forall(a, lambda v: geometry.nearest_on(b, v["x"], v["y"])["d"] <= corridor)
    pairs = small.join(rows.select("edge_id", "course", "geom", "length"), "edge_id").where("length > l")
    held = pairs.where(near(F.col("p"), F.col("geom")) & ~near(F.col("geom"), F.col("p")))
    best = held.groupBy("edge_id", "small").agg(F.max_by("course", F.struct("length", "course")).alias("into"), F.max("length").alias("longest"))
    # The longest course of an edge is never held; who is held goes to one that is not, if any of those holds it.
    free = held.join(best.select("edge_id", F.col("small").alias("course")), ["edge_id", "course"], "left_anti").groupBy("edge_id", "small").agg(F.max_by("course", F.struct("length", "course")).alias("last"))
    longest = rows.groupBy("edge_id").agg(F.max_by("course", F.struct("length", "course")).alias("top"))
    goal = best.join(free, ["edge_id", "small"], "left").join(longest, "edge_id").select("edge_id", F.col("small").alias("course"), F.coalesce("last", "top").alias("to"))
    moved = rows.join(goal, ["edge_id", "course"], "left").groupBy("edge_id", F.coalesce("to", "course").alias("course")).agg(F.sum("weight").alias("weight"))
    return rows.select("edge_id", "course", "geom").join(moved, ["edge_id", "course"])


def average(courses: DataFrame, step: float) -> DataFrame:
    """(edge_id, geom): the weighted mean course of every edge.

    courses(edge_id, geom, weight).  The longest course of an edge sets the shares: every `step` of its
    length and the end.  All courses are taken at these shares and their points averaged by weight, so
    partial sums merge in any order.  Vertices on a straight line between their neighbours are left out.
    An edge with one course keeps it as it is.
    """
    rows = courses.select("edge_id", "geom", "weight", geometry.length(F.col("geom")).alias("length"))
    sizes = rows.groupBy("edge_id").agg(F.greatest(F.lit(1), F.ceil(F.round(F.max("length") / step, 9))).cast("int").alias("k"), F.max("length").alias("longest"), F.count("*").alias("n"))
    shares = F.sequence(F.lit(0), F.col("k"))
    at = lambda i: F.when(F.col("longest") > 0, F.least(F.lit(1.0), i * step / F.col("longest"))).otherwise(i / F.col("k"))
    points = geometry.let(F.col("geom"), lambda g: F.transform(shares, lambda i: F.struct(i.alias("i"), geometry.point_at(g, at(i)).alias("p"))))
    several = rows.join(sizes, "edge_id")
    spread = several.where("n > 1").select("edge_id", "weight", F.explode(points).alias("q"))
    w = F.sum("weight")
    means = spread.groupBy("edge_id", "q.i").agg((F.sum(F.col("weight") * F.col("q.p.x")) / w).alias("x"), (F.sum(F.col("weight") * F.col("q.p.y")) / w).alias("y"))
    run = Window.partitionBy("edge_id").orderBy("i")
    sides = means.select("edge_id", "i", "x", "y", *[F.lag(c).over(run).alias(f"{c}0") for c in "xy"], *[F.lead(c).over(run).alias(f"{c}1") for c in "xy"])
    turn = F.abs((F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) - (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    chord = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    kept = sides.where(F.col("x0").isNull() | F.col("x1").isNull() | (turn > 1e-4 * chord))
    alone = several.where("n = 1").select("edge_id", "geom")
    return alone.union(kept.groupBy("edge_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("q")).select("edge_id", F.transform("q", lambda q: geometry.point(q["x"], q["y"])).alias("geom")))


def merge(courses: DataFrame, corridor: float, step: float) -> DataFrame:
    """(edge_id, geom): one course for each edge, by absorption and then the weighted mean of the rest."""
    return average(absorb(courses, corridor), step)
