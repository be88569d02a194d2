"""Exploration helpers (JOB-16: AGG-1, AGG-2, AGG-9, FLT-3, FLT-7, LIM-1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key (AGG-1): ``groupBy(keys).count()``."""
    return df.groupBy(*keys).count()


def members(df: DataFrame, predicate: str, columns: Sequence[str]) -> DataFrame:
    """Rows matching a SQL predicate, projected (FLT-7, PRJ-1), e.g. areas of one item."""
    return df.where(predicate).select(*columns)


def series_range(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Min and max of a series, per group if ``by`` is given (AGG-9)."""
    aggs = [F.min(value).alias(f"min_{value}"), F.max(value).alias(f"max_{value}")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def with_series_range(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Each row with its series' min and max (AGG-9): a window over the series, one scan.

    A series is one country's values of one item, a row per year, so a
    window's rows are few; use ``series_range`` on groups of any size.
    """
    if not by:
        raise ValueError("name the columns that tell series apart, or use series_range")
    series = Window.partitionBy(*by)
    return df.withColumns({f"min_{value}": F.min(value).over(series), f"max_{value}": F.max(value).over(series)})


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows, deterministic when ``order_by`` is given (LIM-1)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
