"""Small helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Arrow batches hold at most so many rows, so that long texts cannot fill a worker.
BATCH_ROWS = 512


_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set(_SETTING, str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, most: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs inside run with small batches; the session's own setting holds again behind them."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SETTING)
        else:
            spark.conf.set(_SETTING, before)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of *column*: slices of about *most* bytes, one row at least."""
    arr = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, len(arr))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal *keys* (at least one integer column), as tables; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([np.asarray(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False), np.int64) for k in keys], 1)
        cut = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1).tolist(), len(cols)]
        for a, b in zip(cut, cut[1:]):
            key = tuple(cols[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
