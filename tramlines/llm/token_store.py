"""Token ids as Parquet list columns that can be read selectively.

`write` lays documents out in ascending doc_id order: a range shuffle, a sort inside each range,
then one pass that encodes and numbers the ids within the range.  Files hold

* ``doc_id``, ``part`` (the range), ``local_start`` (ids before the document in its range) and
  ``n_tokens``: plain numbers, so token budgets and offsets need no token page;
* ``ids array<int>``: dictionary-encoded by default, or delta-encoded (writer v2, no dictionary).

Row-group and page sizes are parameters and page indexes are written, so a filter on doc_id reads
only the pages that hold it.  `read_index` returns global offsets without touching ``ids``;
`read` adds the ids.

Edge cases: a null or empty text holds the end id alone; rows that repeat an id are ordered by
their text; an empty table writes and reads back as empty; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops as X
from .tokens import encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Ids that one Arrow batch may hold.
BATCH_IDS = 1 << 21
#: Words that a worker's encoder keeps; when they are more, it begins again.
WORDS = 1_200_000


def _encode(path: str, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(path, WORDS), TaskContext.get().partitionId(), 0

        def batch_of(docs: list[int], bodies: list[bytes], at: int) -> pa.RecordBatch:
            n = np.array([len(b) // 4 for b in bodies], np.int64)
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(bodies), "<i4")))
            cols = [pa.array(docs, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n.astype(np.int32)), ids]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "local_start", "n_tokens", "ids"])

        for batch in batches:
            docs, bodies, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = enc.encode(text.as_py() or "") + tail
                docs.append(doc)
                bodies.append(body)
                held += len(body) // 4
                if held >= BATCH_IDS:
                    yield batch_of(docs, bodies, start)
                    start, docs, bodies, held = start + held, [], [], 0
            if docs:
                yield batch_of(docs, bodies, start)
                start += held

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode whole texts and write them to `path`; see the module text for the layout."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    ordered = X.documents_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
    }
    ordered.mapInArrow(_encode(tokenizer or X.tokenizer_path(), end_id), SCHEMA).write.options(**options).parquet(path)


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    parts = rows.sparkSession.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    # One row for each range: the only rows that a single task sees.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "part", "local_start")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start of every document; reads no token page."""
    return _with_start(spark.read.schema(SCHEMA).parquet(path).drop("ids"), path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and start of every document."""
    return _with_start(spark.read.schema(SCHEMA).parquet(path), path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian 32-bit integers, as the files hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").tobytes()
            offs = lists.offsets.to_numpy()
            n = np.diff(offs).astype(np.int64)
            crc = np.fromiter((zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offs[:-1], offs[1:], strict=True)), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc)], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "local_start", "ids")
    sums = stored.mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return _with_start(sums, path).select("doc_id", "start", "n_tokens", "ids_crc32")
