"""What the operators of this subpackage share: staged tables, size-checked joins, Arrow loops."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import BROADCAST_ROWS as BROADCAST_ROWS
from ..functions.staging import shared_dir as shared_dir
from ..functions.staging import sized as sized
from ..functions.staging import stage as stage

def release() -> None:
    """Give freed memory back; Python workers stay alive between tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(
    fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The loop of ``mapInArrow`` around a function of one batch; empty batches are passed over.

    Freed memory goes back after each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
            del batch
            release()

    return run


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While it lasts, queries that run send at most so many rows at once to Python: for wide rows that are staged inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` (a string or binary) has about ``most`` bytes."""
    size = 0
    start = 0
    for i, n in enumerate(byte_lengths(batch.column(column))):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def byte_lengths(arr: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(arr), 0).to_pylist()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
