"""Whitening against a dense eigendecomposition and exact whole numbers."""

from fractions import Fraction

import numpy as np
import pytest

from tramlines.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, whitened string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "v", "w", "n") for i, e in rows], SCHEMA).repartition(3)


def check(got, rows, d, k, exact=True):
    """Rows of (vec_id, x) against numpy and Fractions."""
    xs = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in e] for _, e in rows]
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in xs])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = float(Fraction(sum(deviation), n**3))
    white = centred @ axes / np.sqrt(values)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-9
    assert len(got) == n * k
    sign = {}
    for at, (i, _) in enumerate(rows):
        for c in range(1, k + 1):
            found = by[i][c]
            assert any(int(r["deviation"]) == deviation[at] for r in found)
            if len(found) == 1:
                w = found[0]["whitened"]
                if abs(white[at, c - 1]) > 1e-6:
                    sign.setdefault(c, np.sign(w * white[at, c - 1]))
                assert abs(w - sign.get(c, 1) * white[at, c - 1]) < 1e-7 * max(1, abs(w))


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + rng.normal(size=d)).astype(np.float32).tolist()


def test_equals_dense_version(spark):
    rows = list(enumerate(vectors(1, 120, 12)))
    odd = [(500, None), (501, []), (502, [1.0] * 11), (503, [None] + [1.0] * 11), (504, [float("nan")] * 12), (505, [float("inf")] + [0.0] * 11), (506, [1e30] * 12)]
    check(whitening.whiten(table(spark, rows + odd)).collect(), rows, 12, 8)


def test_repeats_null_ids_and_few_dimensions(spark):
    rows = [(i % 40, e) for i, e in enumerate(vectors(2, 60, 3))] + [(None, [9.0, 1.0, 2.0])] * 3
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and sum(r["vec_id"] is None for r in got) == 9
    check(got, rows, 3, 3)


def test_far_entries_stay_exact(spark):
    """Sums of squares beyond 64 bits."""
    rows = [(i, [c * 2.0**40 for c in e]) for i, e in enumerate(vectors(3, 30, 4))]
    found = whitening.fit(table(spark, rows))
    assert found.wide
    check(whitening.whiten(table(spark, rows)).collect(), rows, 4, 4)


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(20)]
    assert {r["component"] for r in whitening.whiten(table(spark, rows)).collect()} == {1}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(table(spark, rows)).count() == 0
