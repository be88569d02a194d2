"""Streaming ingest of landed station files: each file exactly once across runs."""

from __future__ import annotations

import gzip
import os

from cropstats.operators import weather
from cropstats.streaming.stations import ingest_station_files


def _land(folder, sid, rows):
    os.makedirs(folder, exist_ok=True)
    with gzip.open(os.path.join(folder, f"{sid}.csv.gz"), "wt") as f:
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_ingest_picks_up_new_files_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("daily", "landed", "ckpt"))
    row = ("1990-01-01", 1.0, 0.0, 2.0, 1.0, 0, 0, 1.0, 1.0, 1000.0, 10)
    _land(src, "A1", [row, ("1990-01-02",) + row[1:]])
    ingest_station_files(spark, src, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    _land(src, "B2", [("1991-05-01",) + row[1:]])
    ingest_station_files(spark, src, out, ckpt).awaitTermination()  # restart from checkpoint
    landed = spark.read.parquet(out)
    assert landed.count() == 3
    assert {r.StationId for r in landed.select("StationId").distinct().collect()} == {"A1", "B2"}
    years = weather.station_year(landed, "StationId", "Date")
    assert {(r.StationId, r.Year) for r in years.collect()} == {("A1", 1990), ("B2", 1991)}


def test_driver_stream_query_is_idempotent(spark):
    from cropstats.plans.queries import q32_stream_ingest
    from tests.conftest import SF_SMALL

    first = sorted(map(tuple, q32_stream_ingest(spark, SF_SMALL).collect()), key=str)
    second = sorted(map(tuple, q32_stream_ingest(spark, SF_SMALL).collect()), key=str)
    assert first == second and len(first) > 0


def test_listing_takes_few_tasks_and_the_callers_settings(spark, tmp_path):
    """A folder per station: without a bound, each listing has a task for every folder and every file."""
    src, out, ckpt = (str(tmp_path / n) for n in ("daily", "landed", "ckpt"))
    row = ("1990-01-01", 1.0, 0.0, 2.0, 1.0, 0, 0, 1.0, 1.0, 1000.0, 10)
    most, n = 4 * spark.sparkContext.defaultParallelism, 150
    assert most < n
    for i in range(n):
        _land(f"{src}/station={i}", "part-0", [row])
    threshold = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "8")
    try:
        query = ingest_station_files(spark, src, out, ckpt, id_regex=r"station=([^/]+)/")
        query.awaitTermination()
    finally:
        spark.conf.set(threshold, before)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(str(query.runId)) for s in status.getJobInfo(j).stageIds]
    assert any(s.numTasks > 1 for s in stages if s) and max(s.numTasks for s in stages if s) <= most
    assert {r.StationId for r in spark.read.parquet(out).select("StationId").distinct().collect()} == {str(i) for i in range(n)}
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) > most
