"""End-to-end jobs on hand-made inputs: JOB-1..JOB-16, K2, K4, K7, K13, K14, K15."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cropstats.plans import jobs
from cropstats.sources import catalog
from tests import fixtures

DB = "cropstats_test_db"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    paths = fixtures.all_inputs(str(root))
    catalog.ensure_database(spark, DB, str(root / "warehouse"))
    out = {
        "crop": jobs.load_production(spark, paths["production"], DB),
        "urban": jobs.load_urban_population(spark, paths["urban"], DB),
        "gdp": jobs.load_gdp_share(spark, paths["gdp"], DB),
        "religion": jobs.load_religion(spark, paths["religion"], DB),
        "cpi": jobs.load_corruption(spark, paths["cpi_yearly"], paths["cpi_sheet"], DB),
        "emissions": jobs.load_emissions(spark, paths["emissions"], DB),
        "temperature": jobs.load_surface_temperature(spark, paths["temperature"], DB),
        "codes": jobs.load_country_codes(spark, paths["codes"], DB),
    }
    out["weather"] = jobs.load_weather(spark, paths["stations"], paths["daily"], DB)
    out["paths"] = paths
    return out


def test_job1_crop_yield_long(spark, loaded):
    """JOB-1: PRJ-2, PRJ-4, PRJ-6, PRJ-7, FN-1, FN-2, RSH-2, RSH-5, SNK-1, SRC-6."""
    crop = catalog.table(spark, f"{DB}.crop_yield")
    assert crop.columns == ["AreaCode", "AreaCodeM49", "Country", "ItemCode", "Item",
                            "ElementCode", "Element", "Unit", "Year", "Yield", "YearFlag",
                            "YearNote"]
    assert crop.count() == 4 * 4
    de = {(r.Element, r.Year): (r.Yield, r.YearFlag)
          for r in crop.where("Country = 'Germany' AND Item = 'Wheat'").collect()}
    assert de[("Yield", 2022)] == (130.0, "A")
    assert de[("Production", 1961)] == (None, "M")      # flag without value
    assert de[("Production", 1960)] == (5.0, None)      # value without flag
    assert de[("Production", 2023)] == (None, None)     # '-' → NULL (K6)
    assert {r.AreaCodeM49 for r in crop.collect()} == {276, 4}


def test_job1_k2_null_unit_keeps_flag_single_pass_only(spark, loaded):
    raw = jobs.read_production(spark, loaded["paths"]["production"])
    single = jobs.production_long(raw)
    strict = jobs.production_long(raw, strict_join=True)
    af = lambda df: {r.Year: r.YearFlag for r in df.where("Country = 'Afghanistan'").collect()}
    assert af(single)[1960] == "A"
    assert af(strict)[1960] is None
    nonnull = "Unit IS NOT NULL"
    assert single.where(nonnull).exceptAll(strict.where(nonnull)).count() == 0


def test_job1b_keeps_cpc_and_raw_m49(spark, loaded):
    raw = jobs.read_production(spark, loaded["paths"]["production"])
    out = jobs.production_long(raw, keep_cpc=True, row_id=True)
    assert "ItemCodeCPC" in out.columns and "Id" in out.columns
    assert dict(out.dtypes)["AreaCodeM49"] == "string"


def test_job1_a_year_alone_and_buckets(spark, loaded, tmp_path):
    """SNK-1 from the loader: laid out by year and area code, one year written again."""
    db = "cropstats_layout_db"
    catalog.ensure_database(spark, db, str(tmp_path / "db"))
    path = loaded["paths"]["production"]
    whole = jobs.load_production(spark, path, db, buckets=4)
    hub = jobs.load_country_codes(spark, loaded["paths"]["codes"], db, buckets=4)
    rows = whole.count()
    spark.sql(f"ALTER TABLE {db}.crop_yield DROP PARTITION (Year = 2022)")
    assert catalog.table(spark, f"{db}.crop_yield").count() < rows
    again = jobs.load_production(spark, path, db, buckets=4, years=[2022])
    assert again.count() == rows and again.exceptAll(loaded["crop"].select(*again.columns)).count() == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = again.join(hub, again.AreaCodeM49 == hub.ISONum)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_job4_k15_religion(spark, loaded):
    """JOB-4: FLT-5, FN-8, FN-9, PRJ-3, PRJ-6, RSH-3."""
    rel = loaded["religion"]
    assert set(r.Country for r in rel.collect()) == {"Germany"}
    rows = {r.Religion: (r.Followers, r.Population) for r in rel.collect()}
    assert rows["Hindu"] == (10000, 82000000)
    assert rows["Christian"][0] == 58000000
    assert len(rows) == 7


def test_job5_two_eras_one_scale(spark, loaded):
    """JOB-5: SRC-2, SRC-5, SET-1, SET-2, PRJ-5, PRJ-9, RSH-4, FN-3, FN-4."""
    cpi = {(r.ISO, r.Year): r.CPI for r in loaded["cpi"].collect()}
    assert cpi[("DEU", 1995)] == 81 and cpi[("DEU", 1996)] == 82   # K7, K16
    assert cpi[("AFG", 1995)] is None and cpi[("AFG", 1996)] is None  # empty, NaN (K4)
    assert cpi[("DEU", 2012)] == 79 + 2012 % 3
    assert cpi[("AFG", 2013)] is None
    assert len([k for k in cpi if k[0] == "DEU"]) == 2 + 11


def test_job6_job7_rounding_and_bounds(spark, loaded):
    """JOB-6, JOB-7: FLT-1, PRJ-2, PRJ-3, FN-6."""
    em = loaded["emissions"].collect()
    assert sorted(r.Year for r in em) == [1961, 2022]
    assert [r.Contribution for r in em if r.Year == 1961] == [0.000235]
    t = loaded["temperature"]
    assert "Average surface temperature5" not in t.columns
    assert {r.Year for r in t.collect()} == {1961, 2022, 2023}


def test_job8_k9_codes_keep_na(spark, loaded):
    assert ("NA", "NAM") in {(r.ISO2, r.ISO3) for r in loaded["codes"].collect()}


def test_job9_weather_only_countries_with_facts(spark, loaded):
    """JOB-9: FLT-8, AGG-7, DST-1, JON-2, AGG-3, AGG-4, AGG-5, FN-10, UDF-1, UDF-3."""
    w = {(r.ISO2, r.Year): r for r in catalog.table(spark, f"{DB}.weather_data").collect()}
    assert {k[0] for k in w} == {"DE", "AF"}   # NA has no facts, FR no code
    assert w[("DE", 1960)].AverageTemperature == pytest.approx(7.5)
    assert w[("DE", 1960)].Country == "Germany"


def test_job10_job11_features(spark, loaded):
    """JOB-10, JOB-11: JON-3, JON-4, JON-5, AGG-6, FN-3, FN-6, FN-7, FN-11, FLT-2, FLT-4, PRJ-10, PRJ-11."""
    v1 = jobs.feature_table(spark, 1, DB)
    assert set(v1.columns) == {"Year", "Country", "Item", "Element", "Unit", "Yield",
                               "Temperature"}
    rows = {(r.Country, r.Item, r.Year): r for r in v1.collect()}
    assert rows[("Germany", "Wheat", 2022)].Yield == 130
    assert rows[("Germany", "Almonds, in shell", 2022)].Yield == 30
    # K13: missing yield → 0; only years present in the temperature table join
    assert {k[2] for k in rows} == {1961, 2022, 2023}
    assert rows[("Afghanistan", "Wheat", 2022)].Temperature == pytest.approx(15.25)
    v2 = jobs.feature_table(spark, 2, DB)
    assert {"CorruptionIndex", "GDP", "UrbanPopulation"} <= set(v2.columns)
    assert v2.where(F.col("CorruptionIndex").isNull()).count() == 0
    assert {r.Year for r in v2.collect()} == {2022}


def test_job12_series_and_r(spark, loaded):
    """JOB-12: FLT-3, PRJ-1, ORD-1, STA-2."""
    feats = jobs.feature_table(spark, 1, DB)
    series, ranges, r = jobs.series_correlation(feats, "Germany", "Wheat")
    rows = series.collect()
    assert [row.Year for row in rows] == [1961, 2022, 2023]
    got = ranges.first()
    assert (got.min_Yield, got.max_Yield) == (min(x.Yield for x in rows), max(x.Yield for x in rows))
    assert (got.min_Temperature, got.max_Temperature) == (min(x.Temperature for x in rows), max(x.Temperature for x in rows))
    assert -1 <= r.collect()[0].r <= 1


def test_job13_regression_metrics(spark, loaded):
    feats = jobs.feature_table(spark, 1, DB)
    out = jobs.regression(feats, "m1", key_cols=["Country", "Item", "Year"]).collect()
    assert len(out) == 1


def test_job14_correlation_tables(spark, loaded):
    """JOB-14: STA-2, STA-3 (all groups at once instead of LIM-2's loop)."""
    feats = jobs.feature_table(spark, 1, DB)
    overall, by_group = jobs.correlation_tables(feats, ["Yield", "Temperature"])
    assert overall.count() == 4
    assert by_group.select("Country", "Item").distinct().count() == 3


def test_job15_pca_by_country(spark, loaded):
    feats = jobs.feature_table(spark, 1, DB).withColumn("GDP", F.lit(1.0) * F.col("Year")) \
        .withColumn("CorruptionIndex", F.col("Yield") * 0.5 + F.col("Year")) \
        .withColumn("UrbanPopulation", F.col("Temperature") * 3 - F.col("Year")) \
        .withColumn("RuralPopulation", F.col("Yield") * 1.0)
    for cats in (True, False):
        out = jobs.pca_by_country(feats, with_categories=cats)
        assert out.columns == ["Country", "PC1", "PC2"]
        assert out.count() == 2


def test_job16_explore(spark, loaded):
    """JOB-16: AGG-1, AGG-2, FLT-3, FLT-7, PRJ-1."""
    raw = spark.read.option("header", True).csv(loaded["paths"]["production"])
    parts = jobs.explore_production(raw, "Wheat", "Germany")
    counts = {r.Item: r["count"] for r in parts["item_counts"].collect()}
    assert counts == {"Wheat": 3, "Almonds, in shell": 1}
    assert parts["areas_of_item"].count() == 3
    assert {r.Element for r in parts["elements"].collect()} == {"Yield", "Production"}
    with_year = jobs.explore_production(raw, "Wheat", "Germany", years=[2022])["elements"]
    assert with_year.columns == ["Area", "Item", "Element", "Unit", "Y2022"] and "130.0" in {str(float(r.Y2022)) for r in with_year.collect() if r.Y2022}


def test_app_runs_every_step(spark, tmp_path):
    from cropstats.plans import app

    paths = fixtures.all_inputs(str(tmp_path / "in"))
    db = "cropstats_app_db"
    done = app.load(spark, paths, db, location=str(tmp_path / "wh"))
    assert set(done) == set(app.LOADERS)
    app.weather(spark, paths, db)
    tables = app.analyze(spark, db, series=("Germany", "Wheat"))
    assert {"features_v1", "features_v2", "correlations_overall", "pca_by_country",
            "model_metrics", "series_r"} <= set(tables)
    metrics = catalog.table(spark, tables["model_metrics"])
    assert sorted(r.recipe for r in metrics.collect()) == ["m1", "m2", "m3"]
