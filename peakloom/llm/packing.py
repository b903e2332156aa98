"""Key exchange between document batches and hash buckets, in packed blobs.

Rows that would carry one 8-byte key each are packed: a batch of documents sends to every bucket of
the key space one row whose blobs hold its *distinct* keys of that bucket, so a key that fills a
batch is sent once a batch (pre-aggregation before the shuffle), buckets stay even whatever keys are
hot, and the bucket answers each batch with the keys that matter to it.
"""

from __future__ import annotations

import ctypes
import math
from functools import lru_cache
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_U = np.uint64


#: Rows and bytes of text in one Arrow batch between the JVM and Python, in this session's plans with the corpus operators.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def bound_batches(spark) -> None:
    """Keep Arrow batches small, as rows hold whole texts: the defaults of 10,000 rows and 64 MB are far too many."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@lru_cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not this C library
        return lambda _: 0


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(work):
    """A generator of batches, or a function of one or two tables, that hands freed memory back at its end: Python workers live on beside those of later stages."""

    def stream(batches):
        yield from work(batches)
        give_back()

    def one(table):
        out = work(table)
        give_back()
        return out

    def two(left, right):
        out = work(left, right)
        give_back()
        return out

    return stream if isgeneratorfunction(work) else (one, two)[work.__code__.co_argcount - 1]


#: Bytes of text in one batch of documents: what a Python worker holds at a time, several times over.
BATCH_BYTES = 8 << 20


def text_batches(docs: DataFrame, text_col: str, target: int = BATCH_BYTES) -> int:
    """Enough batches that each holds about `target` bytes of text, never under the session's shuffle partitions. One scan of the texts' lengths."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / target))


def in_batches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(batch, id, text), shuffled by batch; all rows of an id are in one batch, those without one are spread by text.

    Plans that start from it share the exchange.
    """
    bound_batches(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    return docs.select(batch_of(key, n).alias("batch"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartition(n, "batch")


def batch_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(n)).cast("int")


def split_by_bucket(bucket: np.ndarray, *arrays: np.ndarray):
    """Yield (bucket number, *parts) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], edges]) if len(bucket) else edges
    ends = np.concatenate([edges, [len(bucket)]]) if len(bucket) else edges
    arrays = [a[order] for a in arrays]
    for s, e in zip(starts, ends, strict=True):
        yield int(bucket[s]), *(a[s:e] for a in arrays)


def blob(column: pa.ChunkedArray, i: int, dtype) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), dtype)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of equal values, run number of each position)."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1
