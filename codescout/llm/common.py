"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from codescout.session import ship_package


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, whose Python workers can import this package from now on."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def tokenizer_file(spark: SparkSession, path: str):
    """A tokenizer file (a few MB, whatever the input) as a broadcast variable.

    Only the driver opens the path, so executors need no copy of the file.
    """
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def slices(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A batch in slices of a few rows, so that Python never holds more texts than that at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def per_slice(convert: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A function for mapInArrow that converts slice after slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield convert(part)

    return run


def tidy(convert: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``convert`` for mapInArrow that gives free memory of its worker, also what earlier tasks left, back before and after."""

    def release() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from convert(batches)
        release()

    return run
