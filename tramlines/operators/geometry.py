"""Polylines as column expressions over arrays of structs x, y: no rows are exploded, no Python runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def steps(p: Column) -> Column:
    """Lengths of a polyline's segments."""
    n = F.size(p)
    ends = F.arrays_zip(F.slice(p, F.lit(1), n - 1).alias("a"), F.slice(p, F.lit(2), n - 1).alias("b"))
    return F.when(n > 1, F.transform(ends, lambda e: distance(e["a"], e["b"]))).otherwise(F.array().cast("array<double>"))


def arc_lengths(p: Column) -> Column:
    """Length along the polyline up to each of its points; the first is 0."""
    grow = lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d))
    return F.aggregate(steps(p), F.array(F.lit(0.0)), grow)


def length(p: Column) -> Column:
    return F.aggregate(steps(p), F.lit(0.0), lambda s, d: s + d)


def point_at(p: Column, share: Column) -> Column:
    """The point at a share (0 to 1) of the polyline's length; null for an empty polyline."""
    return F.when(F.size(p) > 0, let(arc_lengths(p), lambda along: _at(p, along, share)))


def _at(p: Column, along: Column, share: Column) -> Column:
    """The point at a share of a polyline whose arc lengths are known."""
    goal = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * F.element_at(along, -1)

    def on(i: Column) -> Column:
        """On the segment that starts with vertex i - 1."""
        a, b = F.get(p, i["i"] - 1), F.coalesce(F.get(p, i["i"]), F.get(p, i["i"] - 1))
        part = F.get(along, i["i"]) - F.get(along, i["i"] - 1)
        t = F.when(part > 0, (i["goal"] - F.get(along, i["i"] - 1)) / part).otherwise(F.lit(0.0))
        return let(F.struct(a.alias("a"), b.alias("b"), t.alias("t")), lambda e: point(e["a"]["x"] + e["t"] * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + e["t"] * (e["b"]["y"] - e["a"]["y"])))

    # The last segment that starts at or before the goal.
    last = lambda g: F.greatest(F.lit(1), F.least(F.size(p) - 1, F.size(F.filter(along, lambda s: s <= g))))
    return let(goal, lambda g: let(F.struct(last(g).alias("i"), g.alias("goal")), on))


def sub_path(p: Column, start: Column, end: Column) -> Column:
    """The part of a polyline between two shares of its length, start <= end."""

    def part(along: Column) -> Column:
        inner = lambda c: F.filter(F.arrays_zip(p.alias("p"), along.alias("s")), lambda e: (e["s"] > c["from"]) & (e["s"] < c["to"]))
        bounds = F.struct((start * F.element_at(along, -1)).alias("from"), (end * F.element_at(along, -1)).alias("to"))
        return F.concat(F.array(_at(p, along, start)), F.transform(let(bounds, inner), lambda e: e["p"]), F.array(_at(p, along, end)))

    return let(arc_lengths(p), part)


def average(p: Column, q: Column, parts: int) -> Column:
    """The polyline midway between two, at parts + 1 equal shares of their lengths."""
    shares = F.array(*[F.lit(i / parts) for i in range(parts + 1)])
    both = F.transform(shares, lambda s: F.struct(point_at(p, s).alias("a"), point_at(q, s).alias("b")))
    return F.transform(both, lambda e: point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2))


def chaikin(p: Column) -> Column:
    """One round of corner cutting: points at a quarter and three quarters of each segment; ends stay."""
    n = F.size(p)
    ends = F.arrays_zip(F.slice(p, F.lit(1), n - 1).alias("a"), F.slice(p, F.lit(2), n - 1).alias("b"))
    at = lambda e, t: point(e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"]))
    cut = F.flatten(F.transform(ends, lambda e: F.array(at(e, F.lit(0.25)), at(e, F.lit(0.75)))))
    return F.when(n > 2, F.concat(F.slice(p, 1, 1), F.slice(cut, F.lit(2), F.size(cut) - 2), F.slice(p, -1, 1))).otherwise(p)


def nearest_on(p: Column, x: Column, y: Column) -> Column:
    """Struct d, share: the distance of a point to a polyline and where, as a share of its length, it is reached first."""
    n = F.size(p)
    ends = F.arrays_zip(F.slice(p, F.lit(1), n - 1).alias("a"), F.slice(p, F.lit(2), n - 1).alias("b"), F.slice(arc_lengths(p), F.lit(1), n - 1).alias("s"))

    def one(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / square))).otherwise(F.lit(0.0))
        px, py = e["a"]["x"] + t * dx, e["a"]["y"] + t * dy
        return F.struct(F.sqrt((x - px) * (x - px) + (y - py) * (y - py)).alias("d"), (e["s"] + t * F.sqrt(square)).alias("s"))

    best = F.array_min(F.transform(ends, one))
    total = F.element_at(arc_lengths(p), -1)
    return F.struct(best["d"].alias("d"), F.when(total > 0, best["s"] / total).otherwise(F.lit(0.0)).alias("share"))


def box(p: Column) -> Column:
    """Struct x1, y1, x2, y2: the box around a polyline."""
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two directions, 0 to 180; 0 if one has no length."""
    size = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / F.when(size > 0, size)))
    return F.coalesce(F.degrees(F.acos(F.round(cosine, 12))), F.lit(0.0))
