"""Hierarchical residual best-fit packing of tokenised documents into fixed-length sequences.

1. One pass over the documents encodes each, cuts those longer than a sequence (the first piece
   takes the remainder) and packs the pieces of a batch best-fit, longest first.  Nearly full bins
   are final.
2. All other bins are items of the next round: they are dealt into groups of about `group_items`, packed
   best-fit again, and so on up to one group.

Two bins can only be joined if one of them is at most half full, and best-fit leaves at most one such
bin in a group, so few items remain to be joined after a round.  If they are still more than a group
holds and a round joins fewer than a hundredth of them (most bins are over half full and fit with
nothing), the rounds end there; no task ever holds more than a group.

Edge cases: a null or empty text holds the end id alone; rows that repeat an id, or have none, are
packed each on their own; pieces of equal length go in their order of arrival, so the sequences depend
on the split of the input, their number hardly; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest item first: each item's bin and offset, and each bin's fill."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has exactly r places left
    bins, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            left = n + ((fits & -fits).bit_length() - 1)
            b = room[left].pop()
            if not room[left]:
                open_ ^= 1 << left
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], at[i] = b, fill[b]
        fill[b] += n
        if left > n:
            room[left - n].append(b)
            open_ |= 1 << (left - n)
    return bins, at, np.array(fill, np.int64)


def _pieces(path: str, end: int, capacity: int, full: float, batch_items: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        doc, piece, start, length, crc = [], [], [], [], []
        opened = 0  # bins of this partition so far

        def packed() -> pa.RecordBatch:
            nonlocal opened
            n = np.array(length, np.int64)
            bins, at, fill = best_fit(n, capacity)
            first = (part << 40) + opened
            opened += len(fill)
            cols = [np.array(piece, np.int32), np.array(start, np.int64), n, np.array(crc, np.int64), first + bins, at, fill[bins]]
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *map(pa.array, cols)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = enc.encode(text.as_py() or "") + tail
                n = len(body) // 4
                cut, k = n % capacity or capacity, 0
                a, b = 0, min(n, cut)
                while a < n:
                    doc.append(d), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(body[4 * a : 4 * b]))
                    a, b, k = b, b + capacity, k + 1
                if len(doc) >= batch_items:
                    yield packed()
                    doc, piece, start, length, crc = [], [], [], [], []
        if doc:
            yield packed()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024, full: float = 0.995, group_items: int = 1 << 17, batch_items: int = 32_768) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    `batch_items` bounds the pieces of a local round (one document may add its own on top).
    """
    pieces = X.written(X.documents_of(docs).mapInArrow(_pieces(tokenizer or X.tokenizer_path(), end_id, capacity, full, batch_items), PIECES), "pieces")
    under = F.col("fill") < math.floor(full * capacity)
    level = X.written(pieces.where(under & (F.col("at") == 0)).select(F.col("bin").alias("item"), "fill"), "bins")
    moved = None

    def round_(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        b, at, fill = best_fit(pdf["fill"].to_numpy(), capacity)
        name = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(name, b, pdf["item"].to_numpy())
        return pd.DataFrame({"item": pdf["item"], "into": name[b], "at2": at, "fill": fill[b]})

    items, number = level.count(), 0
    while items > 1:
        groups = -(-items // group_items)
        deal = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)).alias("node")
        step = X.written(level.select("item", "fill", deal).groupBy("node").applyInPandas(round_, "item long, into long, at2 long, fill long"), "round")
        level = step.where(under & (F.col("at2") == 0)).select(F.col("into").alias("item"), "fill")
        hop = step.select("item", "into", "at2")
        if moved is None:
            moved = hop
        else:
            later = hop.select(F.col("item").alias("into"), F.col("into").alias("into2"), F.col("at2").alias("at3"))
            moved = X.written(moved.join(later, "into", "left").select("item", F.coalesce("into2", "into").alias("into"), (F.col("at2") + F.coalesce("at3", F.lit(0))).alias("at2")), "moved")
        before, items, number = items, level.count(), number + 1
        if groups == 1 or 100 * (before - items) < before:
            break
    out = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "at")
    if moved is None:
        return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    joined = out.join(moved.withColumnRenamed("item", "bin"), "bin", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("at2", F.lit(0))).alias("offset"))
