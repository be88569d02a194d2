"""Readers and catalog: SRC-1..SRC-8, CAT-1/2, SNK-1/2, K8, K9, K16."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cropstats import schemas
from cropstats.sources import catalog, files
from tests import fixtures


def test_k9_flags_bom_is_stripped(spark, tmp_path):
    df = files.read_lookup(spark, fixtures.flags(str(tmp_path)))
    assert df.columns == ["Flag", "Flags"]
    rows = dict(map(tuple, df.collect()))
    assert len(rows) == 11 and rows["A"] == "Official figure"
    assert rows == dict(schemas.FLAG_VALUES)


def test_k8_duplicate_header_gets_position_suffix(spark, tmp_path):
    inferred = files.read_delimited(spark, fixtures.surface_temperature(str(tmp_path)))
    assert "Average surface temperature4" in inferred.columns
    assert "Average surface temperature5" in inferred.columns


def test_k16_yearly_files_bind_by_name_not_position(spark, tmp_path):
    d = fixtures.cpi_yearly(str(tmp_path))
    df = files.read_yearly_files(spark, d, schemas.CPI_COLUMNS, r"CPI-(\d{4})\.csv")
    got = sorted((r.Year, r.iso, r.country, r.score) for r in df.collect()
                 if r.score is None or r.score == r.score)
    assert (1995, "DEU", "Germany", 8.14) in got
    assert (1996, "DEU", "Germany", 8.27) in got  # reordered file still binds by name
    assert (1995, "AFG", "Afghanistan", None) in got
    assert df.count() == 4


def test_src3_station_files_gzip_id_from_name(spark, tmp_path):
    d = fixtures.daily(str(tmp_path))
    df = files.read_station_daily(spark, d)
    ids = {r.StationId for r in df.select("StationId").distinct().collect()}
    assert ids == {"ST001", "ST002", "ST003", "ST004", "ST005"}
    assert df.count() == 10
    assert dict(df.dtypes)["Date"] == "date"


def test_src4_k9_station_list_keeps_namibia(spark, tmp_path):
    """SRC-4, UDF-2 (no rdd.map of dicts: schema-first JSON read)."""
    df = files.read_stations(spark, fixtures.stations(str(tmp_path)))
    assert df.columns == ["id", "country"]
    assert ("ST004", "NA") in {tuple(r) for r in df.collect()}


def test_src5_sheet_export_header_below_preamble(spark, tmp_path):
    path = fixtures.cpi_sheet(str(tmp_path))
    df = files.read_sheet_export(spark, path, {"ISO3": "string", "CPI Score 2013": "double",
                                               "CPI Score 2022": "double"},
                                 key_col="ISO3", key_regex="^[A-Z]{3}$")
    rows = {r.ISO3: (r["CPI Score 2013"], r["CPI Score 2022"]) for r in df.collect()}
    assert set(rows) == {"DEU", "AFG"}
    assert rows["AFG"][0] is None  # empty score → NULL


def test_catalog_roundtrip_database_table(spark, tmp_path):
    catalog.ensure_database(spark, "t_roundtrip", str(tmp_path / "db"))
    assert "t_roundtrip" in catalog.databases(spark)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    catalog.save_table(df, "t_roundtrip.small", partition_by=["k"])
    back = catalog.table(spark, "t_roundtrip.small")
    assert sorted((r.k, r.v) for r in back.collect()) == [(1, "a"), (2, "b")]
    out = str(tmp_path / "files")
    catalog.save_files(df, out, fmt="parquet")
    assert os.path.isdir(out) and spark.read.parquet(out).count() == 2


def test_k16_yearly_file_without_header_is_an_error_not_a_silent_drop(spark, tmp_path):
    """SRC-2: a file lacking a wanted column must fail the read, not vanish."""
    import pytest

    d = fixtures.cpi_yearly(str(tmp_path))
    with open(os.path.join(d, "CPI-1997.csv"), "w") as f:
        f.write("country,rank\nGermany,1\n")
    with pytest.raises(ValueError, match="CPI-1997"):
        files.read_yearly_files(spark, d, schemas.CPI_COLUMNS, r"CPI-(\d{4})\.csv")


def test_src2_binds_names_in_any_case_and_reads_only_first_lines_ahead(spark, tmp_path):
    import gzip

    import pytest

    d = tmp_path / "years"
    d.mkdir()
    (d / "CPI-1995.csv").write_text("\ufeffCountry,ISO,Score\nGermany,DEU,8.1\n")
    (d / "CPI-1996.csv").write_text("\n\nSCORE,country,iso\n8.2,\"A, B\",DEU\n")
    (d / "CPI-1997.csv").write_text("")  # no rows, no error
    (d / "CPI-1998.csv").write_text('country,iso,score\n"country,iso,score",X,1\n')  # a data line longer than the header, naming all
    with gzip.open(d / "CPI-1999.csv.gz", "wt") as f:
        f.write("iso,score,country\nAFG,1.5,Afghanistan\n")
    df = files.read_yearly_files(spark, str(d), schemas.CPI_COLUMNS, r"CPI-(\d{4})\.csv")
    assert sorted((r.Year, r.iso, r.country, r.score) for r in df.collect()) == [
        (1995, "DEU", "Germany", 8.1), (1996, "DEU", "A, B", 8.2), (1998, "X", "country,iso,score", 1.0), (1999, "AFG", "Afghanistan", 1.5)]
    (d / "CPI-2000.csv").write_text("Country,COUNTRY,iso,score\na,b,c,1\n")
    with pytest.raises(ValueError, match="ambiguous"):
        files.read_yearly_files(spark, str(d), schemas.CPI_COLUMNS, r"CPI-(\d{4})\.csv")


def test_src2_data_is_scanned_once_per_layout(spark, tmp_path):
    df = files.read_yearly_files(spark, fixtures.cpi_yearly(str(tmp_path)), schemas.CPI_COLUMNS, r"CPI-(\d{4})\.csv")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2 and "text" not in plan.replace("string", "")


def test_src5_keeps_rows_with_blank_or_odd_keys(spark, tmp_path):
    import pytest

    path = tmp_path / "sheet.csv"
    body = "".join(f"Land {i},L{i:02d},{i}\n" for i in range(2000))
    path.write_text('Title,,\nISO3 is the key,,\n"Country, or territory",Iso3,Score\n' + body + 'Nowhere,,5\n,,\n"quoted, name",L1,"7"\nISO3,ISO3,ISO3\n')
    columns = {"Country, or territory": "string", "ISO3": "string", "Score": "double"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits of one file
    try:
        rows = [tuple(r) for r in files.read_sheet_export(spark, str(path), columns, key_col="ISO3").collect()]
        assert len(rows) == 2003 and ("Nowhere", None, 5.0) in rows and ("quoted, name", "L1", 7.0) in rows and ("ISO3", "ISO3", None) in rows
        assert len(files.read_sheet_export(spark, str(path), columns, key_col="ISO3", key_regex=r"^L\d+$").collect()) == 2001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="none.csv"):
        files.read_sheet_export(spark, str(tmp_path / "other"), columns, key_col="ISO3")


def _tree(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_snk1_a_year_is_rewritten_alone(spark, tmp_path):
    catalog.ensure_database(spark, "t_layout", str(tmp_path / "db"))
    df = spark.createDataFrame([(y, k, float(k)) for y in (2000, 2001) for k in range(20)], "Year int, k int, v double")
    catalog.replace_partitions(df, "t_layout.facts", bucket_by=(4, ["k"]))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    catalog.replace_partitions(df.where("Year = 2001 AND k < 5").withColumn("v", df.v + 100), "t_layout.facts")
    catalog.replace_partitions(df.where("Year = 2001").withColumn("Year", df.Year + 1), "t_layout.facts")
    rows = catalog.table(spark, "t_layout.facts").groupBy("Year").agg(F.count("k"), F.max("v")).collect()
    assert sorted(map(tuple, rows)) == [(2000, 20, 19.0), (2001, 5, 104.0), (2002, 20, 19.0)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_snk1_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    catalog.ensure_database(spark, "t_layout2", str(tmp_path / "db"))
    facts = spark.range(500).selectExpr("CAST(id % 50 AS INT) AS k", "CAST(2000 + id % 3 AS INT) AS Year", "id AS v")
    hub = spark.range(50).selectExpr("CAST(id AS INT) AS num", "concat('c', id) AS name")
    catalog.save_table(facts, "t_layout2.facts", partition_by=["Year"], bucket_by=(4, ["k"]), sort_by=["k"])
    catalog.save_table(hub, "t_layout2.hub", bucket_by=(4, ["num"]), sort_by=["num"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f, h = catalog.table(spark, "t_layout2.facts"), catalog.table(spark, "t_layout2.hub")
        joined = f.join(h, f.k == h.num)
        assert "SortMergeJoin" in _tree(joined) and "Exchange" not in _tree(joined) and joined.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_jon5_statistics_order_the_star_and_pick_broadcasts(spark, tmp_path):
    from cropstats.operators.joins import Dim, star_join

    catalog.ensure_database(spark, "t_cost", str(tmp_path / "db"))
    save = lambda df, n: (catalog.save_table(df, f"t_cost.{n}"), catalog.analyze_table(spark, f"t_cost.{n}"))
    save(spark.range(20000).selectExpr("CAST(id % 4000 AS INT) AS a", "CAST(id % 4000 AS INT) AS b", "id AS v"), "facts")
    save(spark.range(4000).selectExpr("CAST(id AS INT) AS ka", "concat('long name of a member ', id) AS na"), "wide")
    save(spark.range(4000).selectExpr("CAST(id AS INT) AS kb", "CAST(id % 2000 AS INT) AS nb"), "narrow")
    t = lambda n: catalog.table(spark, f"t_cost.{n}")
    star = star_join(t("facts"), [Dim(t("wide"), {"a": "ka"}, ["na"]), Dim(t("narrow").where("nb = 7"), {"b": "kb"}, ["nb"])])
    plan = star._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.rindex("Join Inner"):]
    assert "narrow" in inner and "wide" not in inner.split("narrow")[0], plan  # the selective side is joined first
    assert star.columns == ["a", "b", "v", "na", "nb"] and star.count() == 10
    assert "BroadcastHashJoin" in _tree(star)


def test_lim1_snk2_src1_in_one_chain(spark, tmp_path):
    from cropstats.operators.explore import preview

    out = str(tmp_path / "csv")
    catalog.save_files(spark.range(50).selectExpr("id AS k", "id * 2 AS v"), out, fmt="csv", header="true")
    back = files.read_delimited(spark, out, "k bigint, v bigint")
    assert [tuple(r) for r in preview(back, 3, ["k"]).collect()] == [(0, 0), (1, 2), (2, 4)]
