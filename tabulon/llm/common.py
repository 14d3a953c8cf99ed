"""What the operators of this package share: tables, durable intermediate results, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tabulon.session import discard, shared_dir, ship, stage  # noqa: F401

#: UTF-8 bytes of text that a Python worker handles at a time (one longer text is a slice of its own).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most ``size`` bytes of ``column``, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for row, length in enumerate(lengths):
            if row > start and total + length > size:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += length
        if batch.num_rows > start:
            yield batch.slice(start)


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)
