"""Ranks of rows within groups, over the whole table and without a task per group.

Rows are range-partitioned by group and order over sampled borders, sorted, and
numbered inside their range. Only the first group of a range can go on from an
earlier one, so what is missing to the rank is one number per range, and that
table of at most as many rows as ranges is broadcast. A group that holds a third
of all rows spreads over a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropstats.llm import batches, scratch

_OWN = [T.StructField("__place", T.LongType()), T.StructField("__range", T.IntegerType()), T.StructField("__first", T.BooleanType())]


def _begins(values: pa.Array, last: object, fresh: bool) -> np.ndarray:
    """Places where a value differs from the one before; null equals null."""
    codes = pc.dictionary_encode(values, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.empty(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    new[0] = fresh or values[0].as_py() != last
    return np.flatnonzero(new)


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``rank``, from 0, within ``group`` (null is a group) by ``order``; written to the shared folder.

    Give an ``order`` without ties where repeated rows may be many: rows of one
    key stay in one range.
    """

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, ahead, first, fresh = TaskContext.get().partitionId(), None, 0, True, True
        for part in parts:
            if not part.num_rows:
                continue
            values = part.column(part.schema.get_field_index(group))
            begins = _begins(values, last, fresh)
            at = np.arange(part.num_rows, dtype=np.int64)
            origin = np.concatenate(([-ahead], begins))
            run = np.searchsorted(begins, at, side="right")
            places = at - origin[run]
            lead = (run == 0) if not fresh else (run == 1)
            if not first:
                lead[:] = False
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places), pa.array(np.full(len(at), own, dtype=np.int32)), pa.array(lead)], names=[*part.schema.names, *(f.name for f in _OWN)])
            first = first and bool(lead[-1])
            last, ahead, fresh = values[-1].as_py(), int(places[-1]) + 1, False

    by = [F.col(group).asc_nulls_first(), *order]
    sorted_ = rows.repartitionByRange(scratch.partitions(rows), *by).sortWithinPartitions(*by)
    numbered = scratch.stored(batches.mapped(sorted_, number, T.StructType([*rows.schema.fields, *_OWN])), name)
    runs = numbered.groupBy("__range", group).agg((F.max("__place") + 1).alias("n"), F.bool_or("__first").alias("__first"))
    ahead = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    borders = runs.select("__range", "__first", F.sum("n").over(ahead).alias("__before")).where("__first AND __before > 0").select("__range", "__before")
    placed = numbered.join(F.broadcast(borders), "__range", "left")
    return placed.select(*rows.columns, (F.col("__place") + F.when(F.col("__first"), F.coalesce("__before", F.lit(0))).otherwise(0)).alias("rank"))
