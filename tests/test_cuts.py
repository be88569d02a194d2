"""Nothing is cut by size: key filters, wide sheets, long integers, large yields, refreshed sources."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cropstats.functions.clean import strip_and_cast
from cropstats.operators.features import build_features
from cropstats.operators.joins import filter_to_keys
from cropstats.plans.tables import landed_path
from cropstats.sources.files import read_sheet_export


def test_key_filter_keeps_the_same_rows_for_any_number_of_keys(spark):
    rows = spark.range(10)
    for n in (1, 3, 10):
        assert filter_to_keys(rows, "id", spark.range(n).withColumnRenamed("id", "k"), "k").count() == n


def test_sheet_of_more_than_256_columns(spark, tmp_path):
    names = ["ISO3", *[f"c{i}" for i in range(300)]]
    (tmp_path / "sheet.csv").write_text("title\n" + ",".join(names) + "\nABC," + ",".join(map(str, range(300))) + "\n")
    got = read_sheet_export(spark, str(tmp_path), {"ISO3": "string", "c290": "int"}, "ISO3", "^[A-Z]{3}$").collect()
    assert [tuple(r) for r in got] == [("ABC", 290)]


def test_long_integers_keep_every_digit(spark):
    df = spark.createDataFrame([("9007199254740993",), ("12.0",), ("x",)], "s string")
    assert [r[0] for r in df.select(strip_and_cast("s", "[,]", "bigint")).collect()] == [9007199254740993, 12, None]


def test_large_yields_are_kept_and_parts_of_a_version_are_refused(spark):
    facts = spark.createDataFrame([(2000, "A", "Wheat", "Yield", "u", 3e9, 1)], "Year int, Country string, Item string, Element string, Unit string, Yield double, AreaCodeM49 int")
    codes = spark.createDataFrame([(1, "AAA")], "ISONum int, ISO3 string")
    warm = spark.createDataFrame([("AAA", 2000, 1.5)], "ISO3 string, Year int, Temperature double")
    assert build_features(facts, codes, warm).collect()[0]["Yield"] == 3_000_000_000
    with pytest.raises(ValueError):
        build_features(facts, codes, warm, corruption=warm)


def test_a_refreshed_source_lands_anew(spark, tmp_path):
    source = str(tmp_path / "src")
    spark.range(3).write.parquet(f"{source}/t.parquet")
    before = landed_path(spark, "n", source, ["t"])[0]
    assert landed_path(spark, "n", source, ["t"])[0] == before
    spark.range(30).select(F.col("id") + 1).write.mode("overwrite").parquet(f"{source}/t.parquet")
    assert landed_path(spark, "n", source, ["t"])[0] != before
