"""Vector tiles: clipping against plain geometry, and files that decode to the simplified input."""

import math
import os
import random

import numpy as np

from tramlines.operators import tiles
from tramlines.operators.spatial import WORLD
from tramlines.sources import mvt

LINES = "id string, geom array<struct<x: double, y: double>>"


def walks(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, line = rng.uniform(-4e6, 4e6), rng.uniform(-4e6, 4e6), []
        for _ in range(rng.randrange(2, 12)):
            line.append((x, y))
            x, y = x + rng.uniform(-1.5e6, 1.5e6), y + rng.uniform(-1.5e6, 1.5e6)
        out.append((f"l{i}", line))
    return out


def meets(p, q, box):
    """Whether a segment meets a box, by clipping."""
    t0, t1 = 0.0, 1.0
    for a, d, lo, hi in ((p[0], q[0] - p[0], box[0], box[2]), (p[1], q[1] - p[1], box[1], box[3])):
        if d == 0:
            if not lo <= a <= hi:
                return False
            continue
        s, e = sorted(((lo - a) / d, (hi - a) / d))
        t0, t1 = max(t0, s), min(t1, e)
    return t0 <= t1


def clipped(line, z, tx, ty):
    w = 2 * WORLD / (1 << z)
    pad, sy = w * tiles.PAD / tiles.EXTENT, (1 << z) - 1 - ty
    box = (tx * w - WORLD - pad, sy * w - WORLD - pad, (tx + 1) * w - WORLD + pad, (sy + 1) * w - WORLD + pad)
    parts, cur = [], []
    for p, q in zip(line, line[1:], strict=False):
        if meets(p, q, box):
            cur = [*cur, q] if cur else [p, q]
        elif cur:
            parts.append(cur)
            cur = []
    return [*parts, cur] if cur else parts


def test_parts_of_every_tile(spark):
    lines = walks(1, 12)
    got = {}
    for r in tiles.tiled(spark.createDataFrame(lines, LINES), [0, 3, 5]).collect():
        got[r.z, r.tx, r.ty, r.id, r.part] = [(p.x, p.y) for p in r.points]
    want = {(z, tx, ty, i, k): part for i, line in lines for z in (0, 3, 5) for tx in range(1 << z) for ty in range(1 << z) for k, part in enumerate(clipped(line, z, tx, ty))}
    assert got == want and len(want) > 60


def fields(body):
    at = 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = body[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(body):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number()
            yield key >> 3, body[at : at + size]
            at += size


def numbers(body):
    out, n, shift = [], 0, 0
    for b in body:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def decode(body):
    """{layer: [(points, attributes)]}."""
    out = {}
    for _, raw in fields(body):
        parts = list(fields(raw))
        keys, values = [v.decode() for k, v in parts if k == 3], [next(fields(v))[1].decode() for k, v in parts if k == 4]
        assert (5, tiles.EXTENT) in parts and (15, 2) in parts
        features = []
        for k, v in parts:
            if k == 2:
                f = dict(fields(v))
                geom, x, y, points = numbers(f[4]), 0, 0, []
                assert geom[0] == 9 and geom[3] & 7 == 2 and geom[3] >> 3 == (len(geom) - 4) // 2
                for dx, dy in zip(geom[1:2] + geom[4::2], geom[2:3] + geom[5::2], strict=True):
                    x, y = x + (dx >> 1 ^ -(dx & 1)), y + (dy >> 1 ^ -(dy & 1))
                    points.append((x, y))
                tags = numbers(f.get(2, b""))
                features.append((points, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}))
        out[parts[0][1].decode()] = features
    return out


def test_files_decode_to_the_clipped_lines(spark, tmp_path):
    lines = walks(2, 8)
    df = spark.createDataFrame([(i, line, "lines" if int(i[1:]) % 2 else "inner", {"color": f"c{int(i[1:]) % 3}", "line": i}) for i, line in lines], LINES + ", layer string, attributes map<string, string>")
    parts = tiles.tiled(df, [2, 4]).join(df.select("id", "layer", "attributes"), "id")
    made = mvt.encode(parts).cache()
    assert mvt.write(made, f"file://{tmp_path}") == made.count() == sum(len(f) for _, _, f in os.walk(tmp_path))
    seen = 0
    for z in (2, 4):
        unit = 2 * WORLD / (1 << z) / tiles.EXTENT
        for tx in range(1 << z):
            for ty in range(1 << z):
                want = {}
                for i, line in lines:
                    for part in clipped(line, z, tx, ty):
                        p = mvt.simplified(np.array(part), 2 * unit)
                        if len(p) > 2 or math.dist(*p) >= unit:
                            want.setdefault("lines" if int(i[1:]) % 2 else "inner", []).append(([tuple(q) for q in mvt.on_tile(p, z, tx, ty, tiles.EXTENT).tolist()], {"color": f"c{int(i[1:]) % 3}", "line": i}))
                path = tmp_path / str(z) / str(tx) / f"{ty}.mvt"
                assert path.exists() == bool(want)
                if want:
                    seen += 1
                    assert decode(path.read_bytes()) == want
    assert seen > 8


def test_simplification_keeps_corners():
    p = np.array([[0, 0], [1, 0.01], [2, 0], [2, 2], [2, 4.0]])
    assert mvt.simplified(p, 0.1).tolist() == [[0, 0], [2, 0], [2, 4]] and len(mvt.simplified(p, 0.001)) == 4
    assert mvt.varint(300) == b"\xac\x02" and mvt.commands(np.array([[3, -1], [4, -1]])) == [9, 6, 1, 10, 2, 0]
