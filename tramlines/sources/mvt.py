"""Vector tiles as files: the public protobuf format, one file for each tile under z/x/y.mvt."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import WORLD
from ..operators.tiles import EXTENT


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a line without those that a straight line passes within `tolerance` of, ends kept."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(p) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        v, w = p[b] - p[a], p[a + 1 : b] - p[a]
        square = v @ v
        t = np.clip(w @ v / square, 0, 1) if square else np.zeros(len(w))
        away = np.hypot(*(w - t[:, None] * v).T)
        far = int(away.argmax())
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            open_ += [(a, a + 1 + far), (a + 1 + far, b)]
    return p[keep]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes(field: int, body: bytes) -> bytes:
    """A length-delimited field."""
    return varint(field << 3 | 2) + varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n)


def commands(p: np.ndarray) -> list[int]:
    """Move to the first of the whole-number points, then lines to the others, as the format's integers."""
    zigzag = lambda d: (d << 1) ^ (d >> 63)
    steps = np.diff(p, axis=0, prepend=np.zeros((1, 2), p.dtype)).tolist()
    flat = [zigzag(d) for s in steps for d in s]
    return [1 | 1 << 3, *flat[:2], 2 | (len(p) - 1) << 3, *flat[2:]]


def layer(name: str, features: list[tuple[np.ndarray, dict[str, str]]], extent: int = EXTENT) -> bytes:
    """A layer of lines (whole-number points, attributes); keys and values are listed once."""
    keys, values, body = {}, {}, b""
    for points, attributes in features:
        tags = [n for k, v in sorted(attributes.items()) for n in (keys.setdefault(k, len(keys)), values.setdefault(v, len(values)))]
        feature = _number(1, 1) + (_bytes(2, b"".join(map(varint, tags))) if tags else b"") + _number(3, 2) + _bytes(4, b"".join(map(varint, commands(points))))
        body += _bytes(2, feature)
    listed = b"".join(_bytes(3, k.encode()) for k in keys) + b"".join(_bytes(4, _bytes(1, v.encode())) for v in values)
    return _bytes(1, name.encode()) + body + listed + _number(5, extent) + _number(15, 2)


def on_tile(p: np.ndarray, z: int, tx: int, ty: int, extent: int) -> np.ndarray:
    """Whole-number places on a tile, down from its upper left corner."""
    w = 2 * WORLD / (1 << z)
    return np.stack([(p[:, 0] + WORLD - tx * w) * (extent / w), (WORLD - p[:, 1] - ty * w) * (extent / w)], 1).astype(np.int64)


def encode(parts: DataFrame, extent: int = EXTENT, tolerance: float = 2.0) -> DataFrame:
    """(z, tx, ty, features, tile): tiles of parts (z, tx, ty, layer, id, part, points, attributes).

    Lines are simplified by `tolerance` units of the tile; what is then shorter than a unit is left out.
    A tile's features meet in one task, as they make one file.
    """

    def build(f: pd.DataFrame) -> pd.DataFrame:
        z, tx, ty = (int(f[c].iloc[0]) for c in ("z", "tx", "ty"))
        unit = 2 * WORLD / (1 << z) / extent
        out, n = b"", 0
        for name, rows in f.sort_values(["layer", "id", "part"]).groupby("layer", sort=True):
            features = []
            for points, attributes in zip(rows["points"], rows["attributes"], strict=True):
                p = simplified(np.array([[q["x"], q["y"]] for q in points]), tolerance * unit)
                if len(p) == 2 and np.hypot(*(p[1] - p[0])) < unit:
                    continue
                features.append((on_tile(p, z, tx, ty, extent), dict(attributes)))
            if features:
                out += _bytes(3, layer(str(name), features, extent))
                n += len(features)
        return pd.DataFrame({"z": [z], "tx": [tx], "ty": [ty], "features": [n], "tile": [out]})

    rows = parts.select(F.col("z").cast("int").alias("z"), F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "layer", F.col("id").cast("string").alias("id"), F.col("part").cast("long").alias("part"), "points", "attributes")
    return rows.groupBy("z", "tx", "ty").applyInPandas(build, "z int, tx long, ty long, features long, tile binary").where("features > 0")


def write(tiles: DataFrame, uri: str) -> int:
    """Write tiles (z, tx, ty, tile) to uri/z/x/y.mvt and return how many.

    Tasks write their own tiles, each under another name first and then moved, so a task that runs twice
    leaves whole files.  `uri` must lead to one store for all executors.
    """

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        n = 0
        for f in frames:
            for z, tx, ty, body in zip(f["z"], f["tx"], f["ty"], f["tile"], strict=True):
                folder = f"{base}/{z}/{tx}"
                store.create_dir(folder, recursive=True)
                name = f"{folder}/.{ty}-{uuid.uuid4().hex}"
                with store.open_output_stream(name) as out:
                    out.write(body)
                store.move(name, f"{folder}/{ty}.mvt")
                n += 1
        yield pd.DataFrame({"n": [n]})

    return tiles.select("z", "tx", "ty", "tile").mapInPandas(save, "n long").agg(F.sum("n")).first()[0] or 0
