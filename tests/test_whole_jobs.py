"""Queries whose SQL once left out a part of their job do the whole of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropstats.plans import queries, tables
from tests.conftest import SF_SMALL


def _sum_of_years(spark):
    """Whole order totals per nation and year of one item, and all nations and years."""
    names = dict(map(tuple, tables.nation_names(spark, SF_SMALL).collect()))
    facts = tables.yearly_order_facts(spark, SF_SMALL).where("c_mktsegment = 'BUILDING'").collect()
    return {(names[r.c_nationkey], r.yr): int(r.v) for r in facts}


def test_features_count_orders_of_every_status_in_every_year(spark):
    got = queries.q10_feature_join(spark, SF_SMALL)
    yields = {(r.Country, r.Year): r.Yield for r in got.collect()}
    want = _sum_of_years(spark)
    years = {y for _, y in want}
    warm = {(r.ISO3, r.Year) for r in tables.surface_temperature(spark, SF_SMALL).collect()}
    assert yields == {(c, y): want.get((c, y), 0) for c in {c for c, _ in want} for y in years if (c, y) in warm}
    assert got.where(F.col("ElementYield") < F.col("Yield")).count() > 0 and got.where("Element IS NULL").count() > 0


def test_correlations_cover_every_measure_of_all_orders(spark):
    import numpy as np

    got = {(r.Country, r.var_x, r.var_y): r.r for r in queries.q13_corr_by_group(spark, SF_SMALL).collect()}
    rows = tables.whole_features(spark, SF_SMALL).toPandas()
    assert {(x, y) for _, x, y in got} == {(x, y) for x in queries.WHOLE_VARS for y in queries.WHOLE_VARS}
    for country, part in rows.groupby("Country"):
        want = np.corrcoef(part["Yield"], part["GDP"])[0, 1]
        assert abs(got[country, "Yield", "GDP"] - want) < 1e-4
    assert {c for c, _, _ in got} == set(rows["Country"])


def _events_of_many_users(spark, folder, users=70):
    """A source whose users are more than the 64 stations that were once landed, negative ids too."""
    events = spark.range(2 * users).select(
        (F.floor(F.col("id") / 2) - 3).alias("user_id"), F.col("id").alias("event_id"),
        F.to_timestamp(F.lit("2024-01-05 10:00:00")).alias("ts"), F.col("id").cast("double").alias("value"))
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return {(str(u), 2024, 100 * (2 * (u + 3) + 0.5)) for u in range(-3, users - 3)}


def test_station_files_keep_every_user_as_a_station(spark, tmp_path):
    want = _events_of_many_users(spark, str(tmp_path))
    got = queries.q29_station_files(spark, str(tmp_path))
    assert {(r.StationId, r.Year, r.AverageTemperature) for r in got.collect()} == want


def test_stream_ingest_keeps_every_user_as_a_station(spark, tmp_path):
    want = _events_of_many_users(spark, str(tmp_path))
    for _ in range(2):  # a second run finds no new files
        got = queries.q32_stream_ingest(spark, str(tmp_path))
        assert {(r.StationId, r.Year, r.AverageTemperature) for r in got.collect()} == want
