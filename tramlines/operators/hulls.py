"""Convex hulls as an aggregate that merges, and grids cut to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

RUN = 1 << 14  # whole numbers that a row becomes at once


def hull_of(xy: np.ndarray) -> np.ndarray:
    """The corners of points' convex hull, counter-clockwise from the smallest; straight ones left out."""
    p = np.unique(xy[np.isfinite(xy).all(1)], axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, hull): the hull of each key's points (key, x, y), an array of structs x, y.

    Each task brings the points of every key that it holds down to their hull first, so what meets for a
    key is a few corners for each task, however many points the key has.  Points with a null or
    non-finite place don't count; a key without others has no row.
    """
    kind = points.schema[key].dataType.simpleString()
    rows = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, part in f.groupby(key, dropna=False, sort=False):
                corners = hull_of(part[["x", "y"]].to_numpy())
                yield pd.DataFrame({key: [k] * len(corners), "x": corners[:, 0], "y": corners[:, 1]}).astype({key: f[key].dtype})

    def final(f: pd.DataFrame) -> pd.DataFrame:
        corners = hull_of(f[["x", "y"]].to_numpy())
        return pd.DataFrame({key: f[key].iloc[:1], "hull": [[{"x": float(a), "y": float(b)} for a, b in corners]]})

    met = rows.mapInPandas(partial, f"{key} {kind}, x double, y double")
    return met.groupBy(key).applyInPandas(final, f"{key} {kind}, hull array<struct<x: double, y: double>>")


def inside(hull: Column, x: Column, y: Column) -> Column:
    """Whether a place is in a counter-clockwise convex hull or on its edge; never for fewer than three corners."""
    sides = F.transform(hull, lambda a, i: F.struct(a.alias("a"), F.get(hull, (i + 1) % F.size(hull)).alias("b")))
    left = F.forall(sides, lambda s: (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) >= (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"]))
    return (F.size(hull) > 2) & left


def _runs(rows: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """Rows for every whole number from low to high, dealt out in runs: a long one is not made in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.withColumn("_to", high).withColumn("_from", low).where("_from <= _to").withColumn("_at", F.explode(F.sequence("_from", "_to", F.lit(RUN).cast("long"))))
    return parts.repartition(n).withColumn(name, F.explode(F.sequence("_at", F.least("_to", F.col("_at") + RUN - 1)))).drop("_from", "_to", "_at")


def hull_grid(nodes: DataFrame, key: str, size: float) -> tuple[DataFrame, DataFrame]:
    """For each key the grid points in the hull of its nodes, and the edges between them in eight directions.

    Points (key, gx, gy, x, y) stand `size` apart from the lower left of the key's box; edges are (key,
    gx, gy, dir, to_gx, to_gy), dir clockwise from up.  All keys are made at once, each from its own
    table rows.  As a hull is convex, its points in a column are those from one to another, so edges come
    from pairs of columns: no point looks for its neighbours.
    """
    hulls = convex_hulls(nodes, key).select(key, "hull", F.array_min(F.transform("hull", lambda p: p["x"])).alias("x0"), F.array_min(F.transform("hull", lambda p: p["y"])).alias("y0"), F.array_max(F.transform("hull", lambda p: p["x"])).alias("x1"), F.array_max(F.transform("hull", lambda p: p["y"])).alias("y1"))
    zero, last = F.lit(0).cast("long"), lambda c: F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / size)
    spots = _runs(_runs(cut(hulls), zero, last("x"), "gx"), zero, last("y"), "gy")
    held = spots.where(inside(F.col("hull"), F.col("x0") + F.col("gx") * size, F.col("y0") + F.col("gy") * size))
    columns = cut(held.groupBy(key, "gx", "x0", "y0").agg(F.min("gy").alias("low"), F.max("gy").alias("high")))
    points = _runs(columns, F.col("low"), F.col("high"), "gy").select(key, "gx", "gy", (F.col("x0") + F.col("gx") * size).alias("x"), (F.col("y0") + F.col("gy") * size).alias("y"))
    moves = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    step = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(moves)]))
    ways = columns.select(key, "gx", "low", "high", step.alias("m")).select(key, "gx", "low", "high", "m.dir", "m.dy", (F.col("gx") + F.col("m.dx")).alias("to_gx"))
    beside = columns.select(key, F.col("gx").alias("to_gx"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = ways.join(beside, [key, "to_gx"])
    edges = _runs(pairs, F.greatest("low", F.col("low2") - F.col("dy")), F.least("high", F.col("high2") - F.col("dy")), "gy")
    return points, edges.select(key, "gx", "gy", "dir", "to_gx", (F.col("gy") + F.col("dy")).alias("to_gy"))
