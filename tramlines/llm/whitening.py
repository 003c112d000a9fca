"""Whitening of embeddings by MLlib's singular value decomposition of the centred rows.

Every entry c becomes the whole number x = floor(scale * c) + shift, so the sums of each dimension and
the deviations of each vector from the mean are exact.  The centred rows go to RowMatrix.computeSVD as
a distributed matrix; the right singular vectors are the components, a singular value s is an
eigenvalue s^2 / n of the covariance with divisor n.  The total variance is summed apart from that,
from the exact deviations.

Asked for all d values, computeSVD aggregates the d x d Gramian in a tree over the tasks and decomposes
it densely, exact to double precision; with fewer it would iterate to a tolerance of 1e-10.  The driver
holds d x d numbers, never rows.

Edge cases: null vectors, and vectors with a null or non-finite entry, go; so does a vector with an
entry of 2^52 or more in size, whose x is no long, and one whose length is not the most frequent one of
the rest (the longer of equally frequent ones), as it has no such dimensions.  Repeated rows count as
often as they stand there; a null id is returned as null.  Components whose eigenvalue is not above
1e-12 of the largest have no variance to divide by and are left out, so a table of equal vectors, of one
vector or of none gives an empty result.  Signs are set so that the entry of largest size is positive.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X

_WHOLE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Grid:
    """How entries become whole numbers."""

    scale: int = 1024
    shift: int = 100_000
    #: Entries of this size have no x that is a long.
    limit: float = 2.0**52


@dataclass(frozen=True)
class Basis:
    """n vectors of whole mean `mean` and remainder `rest` (sum = n * mean + rest); columns of `axes` by falling eigenvalue.

    `wide`: entries so far from the mean that sums of their squares need more than 64 bits.
    """

    n: int
    mean: np.ndarray
    rest: np.ndarray
    wide: bool
    axes: np.ndarray
    values: np.ndarray


def usable(vectors: DataFrame, grid: Grid = Grid(), d: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that remain, v as doubles, and their length, which is counted unless known."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < grid.limit)))  # NaN compares above all numbers
    if d is None:
        common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        d = common["d"] if common else 0
    return rows.where(F.size("v") == d), d


def _whole(column: pa.Array, d: int, grid: Grid) -> np.ndarray:
    """A batch of vectors as a matrix of x."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(grid.scale * flat).astype(np.int64).reshape(len(column), d) + grid.shift


def _sums(rows: DataFrame, d: int, grid: Grid) -> tuple[int, list[int], bool]:
    """n, the exact sum of each dimension, and whether 64 bits are too few for deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, least, most = 0, [0] * d, [0] * d, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(0), d, grid)
            n += len(x)
            high = [a + int(b) for a, b in zip(high, (x >> 31).sum(0))]
            low = [a + int(b) for a, b in zip(low, (x & (2**31 - 1)).sum(0))]
            least = x.min(0) if least is None else np.minimum(least, x.min(0))
            most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            total = pa.array([Decimal((a << 31) + b) for a, b in zip(high, low)], _WHOLE)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), total, pa.array(least), pa.array(most)], ["dim", "n", "total", "least", "most"])

    parts = rows.select("v").mapInArrow(run, "dim int, n long, total decimal(38,0), least long, most long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()  # d rows
    n, sums = found[0]["n"], [int(r["total"]) for r in found]
    far = max(max(r["most"] - s // n, s // n - r["least"]) for r, s in zip(found, sums))
    return n, sums, d * far * max(far, n) >= 2**62


def _centred(x: np.ndarray, n: int, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n in doubles: the difference from the whole mean is exact, the remainder below 1."""
    return (x - mean).astype(np.float64) - rest / n


def fit(vectors: DataFrame, components: int = 8, grid: Grid = Grid()) -> Basis | None:
    """The leading components of all usable vectors; None without variance."""
    rows, d = usable(vectors, grid)
    if not d:
        return None
    n, sums, wide = _sums(rows, d, grid)
    mean = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = _centred(_whole(batch.column(0), d, grid), n, mean, rest).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * d, pa.int32()), pa.array(body))], ["v"])

    centred = rows.select("v").mapInArrow(run, "v array<double>").select(array_to_vector("v").alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, d)
    svd = matrix.computeSVD(d, computeU=False, rCond=1e-6)  # a ratio of 1e-6 of singular values is 1e-12 of eigenvalues
    s, axes = svd.s.toArray(), svd.V.toArray()
    keep = np.argsort(-s, kind="stable")[: min(components, int((s > 0).sum()))]
    if not len(keep):
        return None
    axes = axes[:, keep]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Basis(n, mean, rest, wide, axes, s[keep] ** 2 / n)


def project(vectors: DataFrame, basis: Basis, grid: Grid = Grid()) -> DataFrame:
    """(vec_id, deviation, spread, whitened) of every usable vector.

    deviation: sum over dimensions of (n * x - S)^2 as decimal(38,0), null where it has more digits;
    spread: deviation / n^2; whitened: coordinates of unit variance, an array.
    """
    rows, d = usable(vectors, grid, len(basis.mean))
    n, mean, rest, wide, axes, values = basis.n, basis.mean, basis.rest, basis.wide, basis.axes, basis.values
    constant, scaled = sum(int(r) ** 2 for r in rest), axes / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1), d, grid)
            y, r = x - mean, rest
            if wide:  # whole numbers of any size
                y, r = y.astype(object), r.astype(object)
            # n x - S = n y - r, whose squares sum to n^2 (y . y) - 2 n (y . r) + r . r
            exact = [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip((y * y).sum(1), (y * r).sum(1))]
            w = (_centred(x, n, mean, rest) @ scaled).ravel()
            k = scaled.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w))
            whole = pa.array([Decimal(v) if v < 10**38 else None for v in exact], _WHOLE)
            yield pa.RecordBatch.from_arrays([batch.column(0), whole, pa.array([v / n**2 for v in exact], pa.float64()), lists], ["vec_id", "deviation", "spread", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), spread double, whitened array<double>")


def whiten(vectors: DataFrame, components: int = 8, grid: Grid = Grid()) -> DataFrame:
    """One row for each usable vector and component, with the figures of the fit.

    explained is e / trace(V), the trace being the mean spread; identity_error is the largest entry
    of the whitened coordinates' covariance minus the identity.
    """
    basis = fit(vectors, components, grid)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if basis is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = X.written(project(vectors, basis, grid), "whitened")
    k = len(basis.values)
    at = [F.col("whitened")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = rows.agg(F.sum("spread").alias("spread"), *[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()  # one row
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    trace = found["spread"] / basis.n
    share = F.array(*[F.lit(float(e) / trace) for e in basis.values])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(basis.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
