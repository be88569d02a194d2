"""Correlations of many columns, overall or per group, in one job (STA-2, STA-3).

``stats.corr_pairs`` writes an expression per pair, which is the plan to have up
to a few dozen columns; at 200 there are 20,100 pairs. Here a task turns its rows
into matrices: for every pair, over the rows that have both values, the count,
both means, both sums of squares and the co-moment, all from four matrix
products. Partial matrices of a group are merged by the pairwise update of means
and co-moments, which stays exact where plain sums cancel.

One shuffle deals partial matrices by group and block of ``BLOCK`` columns, so
even a group that holds a third of all rows is merged by as many tasks as there
are blocks, each holding one block of one group at a time. Tasks bound what they
hold before the shuffle to ``GROUPS`` groups and pass on the rest early.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropstats.session import importable

BLOCK, GROUPS = 32, 64
_PARTS = ("n", "mx", "my", "xx", "yy", "xy")


def moments(x: np.ndarray) -> np.ndarray:
    """Six k × k matrices (``_PARTS``) of the rows of ``x``; a NaN is missing.

    Entry (i, j) is about the rows where both i and j are there: ``mx`` the mean
    of i, ``my`` of j, ``xx`` and ``yy`` their squares about it, ``xy`` the co-moment.
    """
    there = ~np.isnan(x)
    # values less the column's first, so a constant column is exactly 0
    origin = np.where(there.any(0), x[there.argmax(0), np.arange(x.shape[1])], 0.0)
    mask, off = there.astype(float), np.where(there, x - origin, 0.0)
    n = mask.T @ mask
    sums, squares = off.T @ mask, (off * off).T @ mask
    mean = np.divide(sums, n, out=np.zeros_like(n), where=n > 0)
    xx = np.clip(squares - n * mean * mean, 0, None)
    return np.stack([n, mean + origin[:, None], (mean + origin[:, None]).T, xx, xx.T, off.T @ off - n * mean * mean.T])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    # the mean of no rows is no mean
    dx, dy = (np.where((a[0] > 0) & (b[0] > 0), b[i] - a[i], 0.0) for i in (1, 2))
    mx, my = (np.where(a[0] > 0, a[i] + d * share, b[i]) for i, d in ((1, dx), (2, dy)))
    weight = a[0] * share
    return np.stack([n, mx, my, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight])


def corr_wide(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int | None = None,
              x_col: str = "var_x", y_col: str = "var_y", r_col: str = "r") -> DataFrame:
    """``stats.corr_pairs`` for any number of columns: ``(by…, var_x, var_y, r)``, pairwise complete.

    NULL and NaN are missing; r is NULL with fewer than two rows or without spread.
    """
    importable(df.sparkSession)
    cols, k = list(columns), len(columns)
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, keys, strict=True)], *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    key_fields = rows.schema.fields[:len(by)]
    partial = T.StructType([*key_fields, T.StructField("block", T.IntegerType()), *[T.StructField(p, T.ArrayType(T.DoubleType())) for p in _PARTS]])

    def partials(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, m in held.items():
                starts = range(0, k, BLOCK)
                flat = [pa.array([m[p, s:s + BLOCK].ravel() for s in starts], type=pa.list_(pa.float64())) for p in range(len(_PARTS))]
                head = [pa.array([v] * len(starts), type=t) for v, t in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(range(len(starts)), type=pa.int32()), *flat], names=partial.names)
            held.clear()

        types: list[pa.DataType] = []
        for part in parts:
            if not part.num_rows:
                continue
            types = [part.schema.field(n).type for n in keys]
            x = np.column_stack([part.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)])
            if keys:
                table = [part.column(i).to_pylist() for i in range(len(keys))]
                codes, uniques = pd.factorize(pd.Series(list(zip(*table, strict=True)), dtype=object))
                groups = [(u, x[codes == g]) for g, u in enumerate(uniques)]
            else:
                groups = [((), x)]
            for key, values in groups:
                made = moments(values)
                held[key] = merged(held[key], made) if key in held else made
                if len(held) > GROUPS:
                    yield from flush()
        yield from flush()

    out = T.StructType([*key_fields, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("r", T.DoubleType())])

    def correlations(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, types = None, None, []

        def closed() -> pa.RecordBatch:
            size = held.shape[1]
            with np.errstate(invalid="ignore", divide="ignore"):
                r = np.clip(held[5] / np.sqrt(held[3] * held[4]), -1.0, 1.0)
            r = r.ravel()
            first = key[-1] * BLOCK
            head = [pa.array([v] * len(r), type=t) for v, t in zip(key[:-1], types, strict=True)]
            i, j = np.repeat(np.arange(first, first + size), k), np.tile(np.arange(k), size)
            return pa.RecordBatch.from_arrays([*head, pa.array(i, type=pa.int32()), pa.array(j, type=pa.int32()), pa.array(r, mask=~np.isfinite(r))], names=out.names)

        for part in parts:
            types = [part.schema.field(n).type for n in keys]
            names = list(zip(*[part.column(i).to_pylist() for i in range(len(keys) + 1)], strict=True))
            for row, now in enumerate(names):
                made = np.stack([part.column(len(keys) + 1 + p)[row].values.to_numpy(zero_copy_only=False).reshape(-1, k) for p in range(len(_PARTS))])
                if now != key:
                    if held is not None:
                        yield closed()
                    key, held = now, made
                else:
                    held = merged(held, made)
        if held is not None:
            yield closed()

    dealt = rows.mapInArrow(partials, partial).repartition(*keys, "block").sortWithinPartitions(*keys, "block")
    names = F.array(*[F.lit(c) for c in cols])
    r = F.round("r", digits) if digits is not None else F.col("r")
    found = dealt.mapInArrow(correlations, out)
    return found.select(*[F.col(n).alias(c) for n, c in zip(keys, by, strict=True)], names[F.col("i")].alias(x_col), names[F.col("j")].alias(y_col), r.alias(r_col))
