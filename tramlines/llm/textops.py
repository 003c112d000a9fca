"""Vectorised text primitives that run inside Spark tasks.

A batch of texts is one byte buffer plus offsets (the layout Arrow uses), so words, lines and
their 64-bit hashes come out of a few numpy passes with no Python loop over words.

Hashes are polynomial modulo 2**64 with an odd base: the hash of any substring follows from the
prefix sums by one subtraction and one multiplication with the base's inverse power, after which
a finaliser mixes the bits.  They are the same on every machine and in every process.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch between Spark and Python; bounds the buffers on either side.
BATCH_BYTES = 2 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = _WHITE.copy()
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the process and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16, 0 if have is None else 2 * len(have)), U64(base), np.uint64)
        p[0] = 1
        _powers[base] = have = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * powers(_BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start..end of each span, independent of where the span stands."""
    back = powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about `limit` bytes."""
    body, offs = text_buffer(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, end, body[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and the offsets of each text's words.

    Words are maximal runs of bytes other than ASCII white space (and ASCII punctuation if
    asked); a word never crosses from one text into the next.
    """
    inside = ~(_PUNCT if punctuation else _WHITE)[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = inside[heads]
    tails = offs[1:][offs[:-1] < offs[1:]] - 1
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def window_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words that lies in one text, and the index of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * U64(pow(_BASE, 2 * j + 1, 1 << 64))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(total[at]), at


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs values[bounds[i]:bounds[i+1]]; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder for a table that cuts lineage, under spark.checkpoint.dir.

    The setting is read from the session, so a cluster's shared store is used.  Only where it is
    unset in a local session (tests) a folder of this machine is chosen and put in its place; elsewhere
    that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='tramlines-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tramlines/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write `df` once as Parquet to the shared folder and read it back: lineage ends there."""
    path = shared_dir(df.sparkSession, what)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, unless the session has a limit: rows alone don't bound texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def documents_of(df: DataFrame) -> DataFrame:
    """The two columns the text operators use."""
    bound_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def release_memory() -> None:
    """Give freed memory back to the system: workers are reused, and what one task needed would stay theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies: TRAMLINES_TOKENIZERS, else the installed package."""
    if base := os.environ.get("TRAMLINES_TOKENIZERS"):
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)
