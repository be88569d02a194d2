"""Reshape operators: RSH-1..RSH-5, PRJ-7, PRJ-8, JON-1 parity, K1, K2, K5."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cropstats.operators import reshape

WIDE_SCHEMA = ("k string, u string, Y2000 double, Y2000F string, Y2000N string, "
               "Y2001 double, Y2001F string, Y2001N string")


def _wide(spark):
    return spark.createDataFrame([
        ("a", "t", 1.0, "A", None, 2.0, None, "n"),
        ("b", None, None, "E", None, 3.0, "X", None),  # NULL key u (K2)
    ], WIDE_SCHEMA)


def test_classify_year_columns_is_strict():
    cols = ["Year", "Area Code (M49)", "Y1961", "Y1961F", "Y1961N", "Y1962", "YF", "Y19612"]
    got = reshape.classify_year_columns(cols)
    assert got == {1961: {"value": "Y1961", "flag": "Y1961F", "note": "Y1961N"},
                   1962: {"value": "Y1962"}}


def test_unpivot_years_one_row_per_key_year(spark):
    out = reshape.unpivot_years(_wide(spark), id_cols=["k", "u"])
    assert out.columns == ["k", "u", "Year", "Yield", "YearFlag", "YearNote"]
    rows = {(r.k, r.Year): (r.Yield, r.YearFlag, r.YearNote) for r in out.collect()}
    assert rows == {("a", 2000): (1.0, "A", None), ("a", 2001): (2.0, None, "n"),
                    ("b", 2000): (None, "E", None), ("b", 2001): (3.0, "X", None)}


def test_k2_three_melt_form_loses_flags_on_null_keys(spark):
    single = reshape.unpivot_years(_wide(spark), id_cols=["k", "u"])
    strict = reshape.unpivot_years(_wide(spark), id_cols=["k", "u"], strict_join=True)
    # equal where keys are non-null
    assert (single.where("u IS NOT NULL").exceptAll(strict.where("u IS NOT NULL")).count() == 0)
    s = {r.Year: r.YearFlag for r in strict.where("k = 'b'").collect()}
    assert s == {2000: None, 2001: None}  # the left join never matches a NULL key
    k = {r.Year: r.YearFlag for r in single.where("k = 'b'").collect()}
    assert k == {2000: "E", 2001: "X"}


def test_unpivot_years_has_no_exchange(spark):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        reshape.unpivot_years(_wide(spark), id_cols=["k", "u"]).explain("formatted")
    plan = buf.getvalue()
    assert "Exchange" not in plan and "Generate" in plan


def test_k5_unpivot_mixed_types_with_value_type(spark):
    df = spark.createDataFrame([("a", "1.5", 2)], "k string, Y2000 string, Y2001 int")
    with pytest.raises(Exception):
        df.unpivot(["k"], ["Y2000", "Y2001"], "v", "x").collect()
    out = reshape.unpivot(df, ["k"], ["Y2000", "Y2001"], "Year", "x", value_type="double")
    assert sorted((r.Year, r.x) for r in out.collect()) == [("Y2000", 1.5), ("Y2001", 2.0)]


def test_rsh5_year_of(spark):
    df = spark.createDataFrame([("Y1961",), ("Y1961F",), ("Y2022N",)], "c string")
    assert [r.y for r in df.select(reshape.year_of("c").alias("y")).collect()] == \
        [1961, 1961, 2022]


def test_explode_measures_names_and_integer_labels(spark):
    df = spark.createDataFrame([("DE", 1.0, None, 9)], "c string, a double, b double, t int")
    out = reshape.explode_measures(df, ["c", "t"], ["a", "b"], "Religion", "Followers")
    got = sorted([(r.Religion, r.Followers, r.t) for r in out.collect()], key=str)
    assert got == sorted([("a", 1.0, 9), ("b", None, 9)], key=str)
    years = reshape.explode_measures(df, ["c"], {2012: "a", 2013: "b"}, "Year", "CPI",
                                     name_type="int")
    assert [(r.Year, r.CPI) for r in years.orderBy("Year").collect()] == \
        [(2012, 1.0), (2013, None)]


def test_k1_row_id_unique(spark):
    df = spark.range(100).repartition(4)
    ids = [r.Id for r in reshape.add_row_id(df).collect()]
    assert len(set(ids)) == 100


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]),
                          st.integers(1990, 1994),
                          st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)),
                          st.sampled_from([None, "A", "E"])),
                min_size=1, max_size=25, unique_by=lambda t: (t[0], t[1])))
def test_property_pivot_unpivot_round_trip(spark, rows):
    long = spark.createDataFrame(rows, "k string, Year int, Yield double, YearFlag string")
    wide = reshape.pivot_years(long, ["k"], "Year", "Yield", "YearFlag")
    back = reshape.unpivot_years(wide, id_cols=["k"]).drop("YearNote")
    back = back.where(F.col("Yield").isNotNull() | F.col("YearFlag").isNotNull())
    src = long.where(F.col("Yield").isNotNull() | F.col("YearFlag").isNotNull())
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, src.collect()), key=str)
