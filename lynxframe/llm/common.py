"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynxframe.shared import Scratch, hot_join, hot_keys, salted_join  # noqa: F401

#: Stands for a null document id: such a document comes after all others.
NO_ID = 9223372036854775807


def tasks_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` rows, never fewer than the shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def digest(col: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(col, 256))


def lean(run: Callable, rows: int = 2000) -> Callable:
    """A function on Arrow batches that sees ``rows`` rows at a time and then gives Arrow's unused memory back.

    Python workers live on between stages: what one holds for a whole batch stays with the executor.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches))
        gc.collect()
        pa.default_memory_pool().release_unused()

    return wrapped
