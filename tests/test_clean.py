"""Column cleaning: PRJ-3/4/6, FN-1..FN-8, K3, K4, K6, K7, K15."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cropstats.functions import clean


def test_k6_strip_and_cast_dirty_text_is_null_not_error(spark):
    df = spark.createDataFrame([("'004",), ("-",), ("12.0",), ("< 10,000",), (None,)], "s string")
    out = df.select(clean.strip_and_cast("s", "[<, ']", "int").alias("v")).collect()
    assert [r.v for r in out] == [4, None, 12, 10000, None]


def test_k6_bare_cast_fails_under_ansi(spark):
    df = spark.createDataFrame([("-",)], "s string")
    with pytest.raises(Exception):
        df.select(F.col("s").cast("int")).collect()


def test_k7_scale_truncate_toward_zero(spark):
    vals = [0.0, 1.19, 8.14, 9.99, 10.0, 5.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r.v for r in df.select(clean.scale_truncate("x", 10).alias("v")).collect()]
    assert out == [0, 11, 81, 99, 100, 55]


def test_k4_nan_scores_become_null_not_zero(spark):
    """FN-11, FN-12."""
    df = spark.createDataFrame([(float("nan"),), (7.5,), (None,)], "x double")
    out = [r.v for r in df.select(clean.scale_truncate("x", 10).alias("v")).collect()]
    assert out == [None, 75, None]
    nums = [r.v for r in df.select(clean.to_number("x").alias("v")).collect()]
    assert nums == [None, 7.5, None]


def test_k3_round_half_up_vs_display_half_even(spark):
    df = spark.createDataFrame([(0.125,), (1234.5,)], "x double")
    r = df.select(clean.round_to("x", 2).alias("r"),
                  clean.display_number("x", 2).alias("d")).collect()
    assert r[0].r == pytest.approx(0.13) and r[0].d == "0.12"
    assert r[1].d == "1,234.50"
    # the display string is not a number any more: try_cast gives NULL
    assert df.select(clean.to_number(clean.display_number("x", 2)).alias("n")) \
             .collect()[1].n is None


def test_clean_names_strips_and_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "`Area Code (M49)` int, `Item Code` int")
    assert clean.clean_names(df).columns == ["AreaCodeM49", "ItemCode"]
    clash = spark.createDataFrame([(1, 2)], "`A B` int, `AB` int")
    with pytest.raises(ValueError):
        clean.clean_names(clash)


def test_rename_and_map_columns_keep_order(spark):
    df = spark.createDataFrame([("1", "x", "2")], "a string, b string, c string")
    out = clean.map_columns(df, ["a", "c"], lambda c: c.cast("int"))
    assert out.columns == ["a", "b", "c"]
    assert out.collect()[0] == (1, "x", 2)
    assert clean.rename(df, {"b": "B", "zz": "q"}).columns == ["a", "B", "c"]
    other = clean.map_other_columns(df, ["b"], lambda c: c.cast("int"))
    assert other.collect()[0] == (1, "x", 2)


def test_null_to_zero_and_year_range(spark):
    """FN-7, FLT-1, FLT-6."""
    df = spark.createDataFrame([(1959, None), (1960, 5.0), (2022, 1.0), (2023, 2.0)],
                               "Year int, v double")
    assert [r.v for r in df.select(clean.null_to_zero("v").alias("v")).collect()] == \
        [0.0, 5.0, 1.0, 2.0]
    k12_closed = clean.year_range(df, "Year", 1960, 2022)
    assert sorted(r.Year for r in k12_closed.collect()) == [1960, 2022]
    k12_open = clean.year_range(df, "Year", 1960, None, low_inclusive=False)
    assert sorted(r.Year for r in k12_open.collect()) == [2022, 2023]


def test_k15_not_contains_drops_null(spark):
    df = spark.createDataFrame([("Germany",), ("All Countries",), (None,)], "c string")
    out = df.where(clean.not_contains("c", "All Countries")).collect()
    assert [r.c for r in out] == ["Germany"]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    out = [r.x for r in df.select(clean.nan_to_null("x").alias("x")).collect()]
    assert out[0] is None and out[1] == 1.0
    assert not any(isinstance(v, float) and math.isnan(v) for v in out)
