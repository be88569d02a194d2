"""One key holding a third of all rows: results stay exact, plans pre-aggregate."""

from __future__ import annotations

import contextlib
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropstats.operators import joins, stats, weather
from cropstats.plans.tables import land_csv


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    keys = ["hot"] * (n // 3) + [f"k{i % 200}" for i in range(n - n // 3)]
    x = rng.normal(size=n)
    y = 2 * x + rng.normal(size=n)
    rows = [(k, float(a), float(b)) for k, a, b in zip(keys, x, y)]
    return spark.createDataFrame(rows, "k string, x double, y double").repartition(8), x, y


def test_hot_group_correlation_exact_and_partially_aggregated(spark, skewed):
    df, x, y = skewed
    out = stats.corr_pairs(df, ["x", "y"], by=["k"])
    hot = {(r.var_x, r.var_y): r.r for r in out.where("k = 'hot'").collect()}
    assert hot[("x", "y")] == pytest.approx(np.corrcoef(x[:1000], y[:1000])[0, 1], abs=1e-12)
    plan = _plan(out)
    assert "partial_covar_pop" in plan  # map-side partial aggregate before the exchange


def test_hot_station_two_level_aggregate(spark, skewed):
    df, x, _ = skewed
    ms = (weather.Measure("m", "mean", "x"), weather.Measure("s", "sum", "x"))
    st = weather.station_period(df.withColumn("d", F.lit("2024-01-01")), ["k"],
                                F.to_date("d"), "Day", ms)
    assert "partial_avg" in _plan(st)
    hot = st.where("k = 'hot'").collect()[0]
    assert hot.m == pytest.approx(float(np.mean(x[:1000])), abs=1e-12)


def test_hot_key_semi_join_reduces_to_distinct_keys(spark, skewed):
    df, _, _ = skewed
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "code string, v int")
    out = joins.keys_present_in(dim, df, "code", "k")
    assert sorted(r.code for r in out.collect()) == ["hot", "k1"]
    plan = _plan(out)
    assert "LeftSemi" in plan and "HashAggregate" in plan


def test_landing_spreads_a_hot_key_over_several_files(spark, skewed, tmp_path):
    df, _, _ = skewed
    path = str(tmp_path / "landed")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "4k")  # tiny data: make the hot key exceed the advisory size
    try:
        land_csv(df, path, "k")
    finally:
        spark.conf.set(key, old)
    files = [f for f in os.listdir(os.path.join(path, "k=hot")) if f.endswith(".csv")]
    assert len(files) >= 2
    assert spark.read.option("header", True).csv(os.path.join(path, "k=hot")).count() == 1000


def test_skew_join_splitting_is_on(spark):
    """CFG-1, CFG-2: session settings of session.build."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
