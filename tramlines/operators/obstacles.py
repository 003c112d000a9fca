"""Areas that a drawing must keep out of, and what it costs to leave an edge's own course."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, geometry
from .spatial import boxed, cell

CELLS = 1 << 18  # rows by sides that are looked at together
FEW = 1 << 15  # rows by rings, so that some arrays of them stay in the processor's cache
CORNERS = 8  # of rings tested for being convex


def _rings(polygons: DataFrame) -> DataFrame:
    """Rings with their boxes."""
    low, high = (lambda c: F.array_min(F.transform("ring", lambda p: p[c]))), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])))
    at = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return polygons.select("polygon", at.alias("ring")).select("polygon", "ring", low("x").alias("bx1"), low("y").alias("by1"), high("x").alias("bx2"), high("y").alias("by2"))


def _sides_of(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Of a block's rings: those with a side, where their sides begin, and the ends of all sides."""
    places, at = rings.values, rings.offsets.to_numpy()
    x, y = (places.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    here = np.arange(at[0], at[-1])
    ahead = here + 1
    full = np.diff(at) > 0
    ahead[at[1:][full] - 1 - at[0]] = at[:-1][full]
    true = (x[here] != x[ahead]) | (y[here] != y[ahead])
    here, ahead, owner = here[true], ahead[true], owner[true]
    named, first = np.unique(owner, return_index=True)
    return named, first, (x[here], y[here], x[ahead], y[ahead])


def _held(x: np.ndarray, y: np.ndarray, first: np.ndarray, sides: tuple[np.ndarray, ...]) -> np.ndarray:
    """Places by rings: whether the sides to the right of the place are odd in number."""
    x3, y3, x4, y4 = sides
    with np.errstate(divide="ignore", invalid="ignore"):
        right = ((y3 <= y) != (y4 <= y)) & (x < x3 + (y - y3) / (y4 - y3) * (x4 - x3))
    return np.logical_xor.reduceat(right, first, axis=1)


def _touched(a: dict[str, np.ndarray], first: np.ndarray, sides: tuple[np.ndarray, ...]) -> np.ndarray:
    """Segments by rings: whether they share a point with a side, ends included."""
    x3, y3, x4, y4 = sides
    x1, y1, x2, y2 = a["x1"], a["y1"], a["x2"], a["y2"]
    turn = lambda ax, ay, bx, by, cx, cy: np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    among = lambda v, p, q: (v >= np.minimum(p, q)) & (v <= np.maximum(p, q))
    t3, t4, t1, t2 = turn(x1, y1, x2, y2, x3, y3), turn(x1, y1, x2, y2, x4, y4), turn(x3, y3, x4, y4, x1, y1), turn(x3, y3, x4, y4, x2, y2)
    meets = (t3 * t4 < 0) & (t1 * t2 < 0)
    for zero, x, y, p, q, r, s in ((t3, x3, y3, x1, x2, y1, y2), (t4, x4, y4, x1, x2, y1, y2), (t1, x1, y1, x3, x4, y3, y4), (t2, x2, y2, x3, x4, y3, y4)):
        meets |= (zero == 0) & among(x, p, q) & among(y, r, s)
    return np.logical_or.reduceat(meets, first, axis=1)


def _matrix(decide: Callable[[dict, np.ndarray, tuple], np.ndarray]) -> blocks.Test:
    """A test of blocks by `decide`, which takes as many rows at a time as their rings' sides allow."""

    def test(a: dict, b: dict) -> blocks.Found:
        named, first, ends = _sides_of(b["ring"])
        if not len(named):
            return np.empty(0, int), np.empty(0, int), {}
        some, out = max(1, CELLS // len(ends[0])), []
        for at in range(0, len(a["x1"]), some):
            i, j = np.nonzero(decide({c: a[c][at : at + some, None] for c in ("x1", "y1", "x2", "y2")}, first, ends))
            out.append((i + at, named[j]))
        return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out]), {}

    return test


def _convex(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Of rings, a row each: 1 or -1 where every corner lies on that side of all sides that it does not end; else 0."""
    k = x.shape[1]
    ahead = (np.arange(k) + 1) % k
    dx, dy = x[:, ahead] - x, y[:, ahead] - y
    turn = dx[:, :, None] * (y[:, None, :] - y[:, :, None]) - dy[:, :, None] * (x[:, None, :] - x[:, :, None])
    apart = np.ones((k, k), bool)
    apart[np.arange(k), np.arange(k)] = apart[np.arange(k), ahead] = False
    return (turn[:, apart] > least).all(axis=1).astype(np.int8) - (turn[:, apart] < -least).all(axis=1)


def _count_blocked(a: dict, b: dict) -> np.ndarray:
    """How many rings of a block each segment meets or lies in.

    A segment and a convex ring are apart if all corners are on one side of the segment's line, or both
    its ends are outside of one side.  Products of matrices tell how far at least; where rounding might
    decide, and for other rings, all sides are looked at as in `blocked`.
    """
    ends = [a[c] for c in ("x1", "y1", "x2", "y2")]
    n = np.zeros(len(ends[0]), np.int64)
    named, first, sides = _sides_of(b["ring"])
    if not len(named):
        return n
    exact = lambda rows, begin, of: (_held(a["x1"][rows, None], a["y1"][rows, None], begin, of) | _touched({c: a[c][rows, None] for c in ("x1", "y1", "x2", "y2")}, begin, of)).sum(axis=1)

    def all_sides(rows: np.ndarray, at: np.ndarray) -> None:
        begin, of = np.arange(len(at)) * at.shape[1], tuple(v[at.ravel()] for v in sides)
        some = max(1, CELLS // at.size)
        for k in range(0, len(rows), some):
            n[rows[k : k + some]] += exact(rows[k : k + some], begin, of)

    with np.errstate(over="ignore", invalid="ignore"):
        near = 1e-12 * max(np.abs(v).max() for v in (*ends, *sides)) ** 2
    x1, y1, x2, y2 = ends
    line = np.stack([y1 - y2, x2 - x1, (y2 - y1) * x1 - (x2 - x1) * y1], axis=1)
    tips = [np.stack([x, y, np.ones_like(x)], axis=1) for x, y in ((x1, y1), (x2, y2))]
    size = np.diff(np.append(first, len(sides[0])))
    for k in np.unique(size):
        at = first[size == k][:, None] + np.arange(k)
        x, y = sides[0][at], sides[1][at]
        turned = _convex(x, y, near) if 3 <= k <= CORNERS else np.zeros(len(at), np.int8)
        if not turned.all():
            all_sides(np.arange(len(n)), at[turned == 0])
        at, x, y, turned = at[turned != 0], x[turned != 0], y[turned != 0], turned[turned != 0]
        if not len(at):
            continue
        corners = [np.stack([x[:, c], y[:, c], np.ones(len(at))]) for c in range(k)]
        px, py, qx, qy = x, y, np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
        inner = [turned * np.stack([v[:, c] for v in (py - qy, qx - px, (qy - py) * px - (qx - px) * py)]) for c in range(k)]
        some = max(1, FEW // len(at))
        for begin in range(0, len(n), some):
            rows = slice(begin, begin + some)
            low = high = line[rows] @ corners[0]
            for c in corners[1:]:
                v = line[rows] @ c
                low, high = np.minimum(low, v), np.maximum(high, v)
            depth = np.minimum(-low, high)
            for side in inner:
                depth = np.minimum(depth, np.maximum(tips[0][rows] @ side, tips[1][rows] @ side))
            sure = (np.abs(depth) > near).all(axis=1)
            n[rows] += np.where(sure, (depth > 0).sum(axis=1), 0)
            if not sure.all():
                all_sides(begin + np.flatnonzero(~sure), at)
    return n


def _matches(segments: DataFrame, polygons: DataFrame, size: float, decide: Callable[[dict, np.ndarray, tuple], np.ndarray]) -> DataFrame:
    kinds = f"id {segments.schema['id'].dataType.simpleString()}, polygon {polygons.schema['polygon'].dataType.simpleString()}"
    one, two = blocks.packed(boxed(segments), size), blocks.packed(_rings(polygons), size, many="ring")
    return blocks.matches(one, two, size, _matrix(decide), ("id", "polygon"), kinds)


def _places(points: DataFrame) -> DataFrame:
    return points.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


def points_inside(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(id, polygon): points (id, x, y) inside polygons, by the parity of the sides to their right.

    Blocks of points meet blocks of whole rings, so a pair is decided where it meets: what is shuffled
    grows with points and corners, not with pairs.
    """
    return _matches(_places(points), polygons, size, lambda a, first, ends: _held(a["x1"], a["y1"], first, ends))


def blocked(segments: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(id, polygon): segments (id, x1, y1, x2, y2) that meet a polygon's sides or lie in it.

    A segment that meets no side is in or out as a whole, so one end tells.  Every pair is met once.
    """
    return _matches(segments, polygons, size, lambda a, first, ends: _held(a["x1"], a["y1"], first, ends) | _touched(a, first, ends))


def blocked_counts(segments: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(id, n): how many polygons each segment meets or lies in, as `blocked` tells; none that has none.

    Polygons are counted where blocks meet, so pairs make no rows.
    """
    one, two = blocks.packed(boxed(segments), size), blocks.packed(_rings(polygons), size, many="ring")
    return blocks.counts(one, two, size, _count_blocked, "id")


def blocked_points(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(id, polygon): points in a polygon or on its sides."""
    return blocked(_places(points), polygons, size)


def course_penalties(hops: DataFrame, courses: DataFrame, size: float, price: float, limit: float) -> DataFrame:
    """(edge_id, id, penalty): what a grid edge costs an edge for being away from its own course.

    hops(id, x1, y1, x2, y2) are grid edges of cells of `size`; courses(edge_id, geom), one row or more
    an edge (the pieces of a combined edge).  The distance is that of the farther end to the nearer
    course, in cells; the penalty is `price` times its square, and what costs more than `limit` is left
    out.  So a hop's ends are within sqrt(limit / price) cells of the course: it is found in the cells,
    that wide, around the course's segments, and the exact distance decides.
    """
    reach = (limit / price) ** 0.5 * size
    named = courses.select("edge_id", "geom").withColumn("course", F.xxhash64("edge_id", F.col("geom").cast("string")))
    ends = F.transform(F.slice("geom", F.lit(1), F.size("geom") - 1), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get("geom", i + 1)["x"].alias("x2"), F.get("geom", i + 1)["y"].alias("y2")))
    steps = named.where(F.size("geom") > 1).select("edge_id", "course", F.explode(ends).alias("s"))
    wide = lambda c: F.explode(F.sequence(cell(F.least(f"s.{c}1", f"s.{c}2") - reach, reach), cell(F.greatest(f"s.{c}1", f"s.{c}2") + reach, reach)))
    around = steps.withColumn("cx", wide("x")).withColumn("cy", wide("y")).select("edge_id", "course", "cx", "cy").distinct()
    at = hops.select("id", "x1", "y1", "x2", "y2", cell(F.col("x1"), reach).alias("cx"), cell(F.col("y1"), reach).alias("cy"))
    met = at.join(around, ["cx", "cy"]).join(named, ["edge_id", "course"])
    away = lambda n: geometry.nearest_on(F.col("geom"), F.col(f"x{n}"), F.col(f"y{n}"))["d"]
    far = met.withColumn("d", F.greatest(away(1), away(2)) / size).groupBy("edge_id", "id").agg(F.min("d").alias("d"))
    return far.select("edge_id", "id", (price * F.col("d") * F.col("d")).alias("penalty")).where(F.col("penalty") <= limit)
