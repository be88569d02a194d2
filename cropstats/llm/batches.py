"""Arrow batches of texts, split so that a piece holds a bounded number of bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PIECE_BYTES = 4 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(df: DataFrame) -> None:
    """Let Python workers find this package where the driver found it.

    On a cluster the package is installed or sent with ``--py-files``; this only
    helps where the driver put its folder on the path by itself.
    """
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with workers that can import this package and give memory back after each task."""
    importable(df)

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(parts)
        finally:
            trim()

    return df.mapInArrow(task, schema)


#: Schema of rows packed by :func:`dealt`.
DEALT = "bucket int, columns array<binary>"


def buckets(df: DataFrame) -> int:
    """Buckets to deal rows into; several a task, so that tasks are even: Spark sends a task's packed rows to Python at once."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """The rows of ``columns`` packed into one row per bucket, so that few large rows are shuffled."""
    bucket = bucket.astype(np.min_scalar_type(int(bucket.max(initial=0))))
    order = np.argsort(bucket, kind="stable")
    named, first = np.unique(bucket[order], return_index=True)
    columns = [x[order] for x in columns]
    packed = [[x[a:b].tobytes() for x in columns] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(named.astype(np.int32)), pa.array(packed, type=pa.list_(pa.binary()))], names=["bucket", "columns"])


def met(rows: DataFrame, types: tuple[type, ...], function: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``function`` yields for the columns of each bucket of rows packed by :func:`dealt`."""

    def unpacked(held: list[pa.Scalar]) -> Iterator[pa.RecordBatch]:
        columns = zip(*([x.as_buffer() for x in row.values] for row in held), strict=True)
        yield from function(*(np.concatenate([np.frombuffer(x, dtype=t) for x in c]) for c, t in zip(columns, types, strict=True)))

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for part in parts:
            for k, row in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if k != at and held:
                    yield from unpacked(held)
                    held = []
                at = k
                held.append(row)
        if held:
            yield from unpacked(held)

    return mapped(rows.repartition(buckets(rows) // 4, "bucket").sortWithinPartitions("bucket"), meet, schema)


def trim() -> None:
    """Return what this process has freed to the system.

    Spark keeps its Python workers for later tasks of other stages. The C
    library and Arrow keep freed pages for the next allocation, so an idle
    worker would hold the most that any of its tasks needed.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column``, or one row where a row alone exceeds it."""
    for batch in batches:
        sizes = [len(x) for x in _values(batch, column)]
        at = held = 0
        for i, size in enumerate(sizes):
            if i > at and held + size > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < len(sizes):
            yield batch.slice(at)


def _values(batch: pa.RecordBatch, column: str) -> Iterator[memoryview | bytes]:
    """The column's values as buffers without copying; null is empty."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_buffer() if x.is_valid else b""


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's strings as UTF-8 bytes; null is empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(batch.schema.get_field_index(column))]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
