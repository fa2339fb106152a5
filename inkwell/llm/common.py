"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an id table up to which it is broadcast (8 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_text(column: pa.Array) -> pa.Array:
    """Lower-cased text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column, "") if column.null_count else column)


def ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (null as 0) and a mask of those that are there."""
    there = np.asarray(column.is_valid())
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), there


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key isn't in ``ids``; null keys stay. Broadcasts only a table of a checked size."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, key, "left_anti").select(docs.columns)


def batches(it: Iterable[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches cut to a bounded number of rows."""
    for b in it:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
