"""What the corpus operators share: keys of texts and Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.plans.work import cut, cut_small, drop, hold, let_go, own_session, shared_dir, ship, work_path

__all__ = ["ascii_lower", "bounded", "cut", "cut_small", "drop", "hold", "let_go", "pieces", "shared_dir", "text_buffer", "text_key", "work_path"]

#: What one Python call gets at once: rows and bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def bounded(docs: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """docs in a session of its own with short batches, so that long texts don't pile up in readers and workers; the user's settings stay as they are.

    A reader's buffers hold whole batches of rows and double as they fill. Workers are sent this package.
    """
    ship(docs.sparkSession)
    return own_session(
        docs,
        {
            "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
            "spark.sql.execution.arrow.maxBytesPerBatch": str(size),
            "spark.sql.parquet.columnarReaderBatchSize": "256",
            "spark.sql.inMemoryColumnarStorage.batchSize": "1000",
        },
    )


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() is much faster; it is used where it does the same."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # Letters with a lower-case form are in Lu, Lt, Nl or So.
    other = c.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]")
    return F.when(other, F.translate(c, upper, small)).otherwise(F.lower(c))


def text_key(c: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs. Rows with the same text have the same key, null included."""
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(0x5EED), c, F.lit(7)).alias("k2")]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, and where each begins (one more than texts). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, whole rows each."""
    _, at = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
