"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Rows that Spark hands to Python at a time.  With texts of a few kilobytes that is some megabytes.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are cut down to ``BATCH_ROWS``, as rows here hold whole texts."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(setting)) > BATCH_ROWS:
        df.sparkSession.conf.set(setting, BATCH_ROWS)
    return df


def release() -> None:
    """Gives memory that a task no longer uses back to the system, as its worker waits for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: what is free is used again by later tasks
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose ``column`` holds about ``max_bytes`` at most.

    One row larger than that is a run of its own, so memory follows the longest text.
    """
    if not batch.num_rows:
        return
    ends = np.cumsum(text_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null counts 0."""
    return pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as one byte array, and the n+1 offsets in it; null is empty."""
    large = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(large.buffers()[1], np.int64, len(large) + 1, large.offset * 8)
    data = large.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def int_lists(parts: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids, one byte string per row, as list<int32>."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` and more columns at its end."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], [*batch.schema.names, *columns]
    )
