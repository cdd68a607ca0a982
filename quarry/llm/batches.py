"""Texts of Arrow batches as numpy arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text handled at a time; a longer text forms a piece of its own.
PIECE_BYTES = 2 << 20
#: Rows per Arrow batch sent to Python.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with small batches, so that a Python worker's memory stays low."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def integer_ids(df: DataFrame, id_col: str) -> None:
    """TypeError if ids are no integers, instead of a failed cast in the middle of a job."""
    if (kind := df.select(id_col).dtypes[0][1]) not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; documents are ordered by an integer id")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives no bytes."""
    return column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).fill_null(b"").to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], column: str, size_bytes: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``size_bytes`` of text, or one row, and their texts."""
    for batch in batches:
        all_texts = texts(batch.column(column))
        at = 0
        while at < len(all_texts):
            end, size = at, 0
            while end < len(all_texts) and (end == at or size + len(all_texts[end]) <= size_bytes):
                size += len(all_texts[end])
                end += 1
            yield batch.slice(at, end - at), all_texts[at:end]
            at = end
