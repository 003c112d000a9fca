"""Column expressions: coordinates, attribute aliases, permutations, drawing text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0


def mercator_x(lng: Column) -> Column:
    return F.radians(lng) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH


def lng_of(x: Column) -> Column:
    return F.degrees(x / EARTH)


def lat_of(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty, without surrounding quotes and spaces."""
    clean = [F.trim(F.regexp_replace(v, '^[ "]+|[ "]+$', "")) for v in values]
    return F.coalesce(*[F.when(c != "", c) for c in clean])


def html_colour(c: Column) -> Column:
    """Six lower-case hex digits: without '#', short forms doubled; other text is kept."""
    low = F.lower(F.regexp_replace(c, "^#", ""))
    return F.when(low.rlike("^[0-9a-f]{3}$"), F.regexp_replace(low, "(.)", "$1$1")).otherwise(low)


def permuted(values: Column, order: Column) -> Column:
    """values[order[0]], values[order[1]], ..."""
    return F.transform(order, lambda i: F.get(values, i))


def rotated(values: Column, k: Column) -> Column:
    """The array turned left by k places."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, F.pmod(i + k, n)))


def same_cycle(a: Column, b: Column) -> Column:
    """Arrays of distinct values that are equal up to rotation."""
    at = F.array_position(b, F.get(a, F.lit(0))).cast("int") - 1
    return (F.size(a) == F.size(b)) & F.coalesce(F.when(at >= 0, rotated(b, at) == a), F.size(a) == 0)


def inversions(v: Column) -> Column:
    """Number of pairs i < j with v[i] > v[j]."""
    pairs = F.transform(v, lambda x, i: F.size(F.filter(F.slice(v, i + 2, F.size(v)), lambda y: y < x)))
    return F.aggregate(pairs, F.lit(0), lambda s, n: s + n)


def _short(v: Column) -> Column:
    """A number with at most two decimals, as text."""
    return F.call_function("format_number", v, F.lit("0.##"))


def svg_polyline(points: Column, style: Column) -> Column:
    """An SVG polyline of an array of structs x, y."""
    text = F.array_join(F.transform(points, lambda p: F.concat_ws(",", _short(p["x"]), _short(p["y"]))), " ")
    return F.concat(F.lit('<polyline points="'), text, F.lit('" style="'), style, F.lit('"/>'))


def svg_circle(x: Column, y: Column, r: Column, style: Column) -> Column:
    return F.concat(F.lit('<circle cx="'), _short(x), F.lit('" cy="'), _short(y), F.lit('" r="'), _short(r), F.lit('" style="'), style, F.lit('"/>'))
