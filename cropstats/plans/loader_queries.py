"""The loaders (JOB-1..JOB-8, JOB-12, JOB-16) on files landed from the driver's tables.

Each query lands its input once per source, in the layout that the loader
expects (text keys, flag and note columns, preambles, thousands separators),
runs the shipped loader, and returns the saved table. The oracle states the same
figures over the tables themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropstats import schemas
from cropstats.operators.explore import preview
from cropstats.plans import jobs, tables
from cropstats.plans.queries import SQL_FACTS, SQL_FEATURES, register, sql_round
from cropstats.plans.tables import LANDING_LOCK, landed_path, load, mark_landed
from cropstats.session import checkpoint_dir, scratch_path
from cropstats.sources import catalog, files


def landed(spark: SparkSession, sf_dir: str, name: str, sources: Sequence[str], write: Callable[[str], None]) -> str:
    """The folder that ``write`` fills, once per source."""
    with LANDING_LOCK:
        base, done = landed_path(spark, name, sf_dir, sources)
        if not done:
            write(base)
            mark_landed(spark, base)
    return base


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def database(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A database for the loaded tables of one query and source."""
    db = f"cropstats_{name}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    catalog.ensure_database(spark, db, f"{checkpoint_dir(spark).rstrip('/')}/warehouse/{db}")
    return db


def iso3(key: str) -> F.Column:
    """Three letters from a nation key."""
    return F.concat(F.chr(F.expr(f"65 + {key} div 26")), F.chr(65 + F.col(key) % 26), F.lit("X"))


SQL_ISO3 = "chr(CAST(65 + n_nationkey // 26 AS INTEGER)) || chr(CAST(65 + n_nationkey % 26 AS INTEGER)) || 'X'"


def production_file(spark: SparkSession, sf_dir: str) -> str:
    """The yearly order totals as a production file: quoted area codes, value, flag and note per year."""

    def write(base: str) -> None:
        wide = tables.yearly_orders_wide(spark, sf_dir)
        keys = {"Area Code": F.col("n_nationkey"), "Area Code (M49)": F.concat(F.lit("'"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")),
                "Area": F.col("n_name"), "Item Code": F.length("c_mktsegment"), "Item Code (CPC)": F.lit("'01"), "Item": F.col("c_mktsegment"),
                "Element Code": F.lit(5510), "Element": F.lit("Yield"), "Unit": F.lit("USD")}
        years = [c for c in wide.columns if c.startswith("Y")]
        csv(wide.select(*[c.alias(n) for n, c in keys.items()], *years), f"{base}/production")

    return landed(spark, sf_dir, "production", ["orders", "customer", "nation"], write) + "/production"


@register("q40_load_production", "WITH" + SQL_FACTS + """
SELECT n_nationkey AS "AreaCode", n_nationkey AS "AreaCodeM49", n_name AS "Country", length(c_mktsegment) AS "ItemCode",
       c_mktsegment AS "Item", 5510 AS "ElementCode", 'Yield' AS "Element", 'USD' AS "Unit", "Year", "Yield", "YearFlag", "YearNote"
FROM long""")
def q40_load_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-1, SRC-1, PRJ-2/4/6/7, RSH-2, SNK-1: the production loader, laid out by year and area code."""
    return jobs.load_production(spark, production_file(spark, sf_dir), database(spark, sf_dir, "production"), buckets=4)


@register("q40b_production_row_ids", "WITH" + SQL_FACTS + """
SELECT n_name AS "Country", count(*) AS long_rows, count(DISTINCT c_mktsegment) AS wide_rows FROM long GROUP BY 1""")
def q40b_production_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-1b, PRJ-8: one id per row of the wide file, carried by all its long rows."""
    long = jobs.production_long(jobs.read_production(spark, production_file(spark, sf_dir)), keep_cpc=True, row_id=True)
    return long.groupBy("Country").agg(F.count("*").alias("long_rows"), F.count_distinct("Id").alias("wide_rows"))


@register("q41_explore_production", "WITH" + SQL_FACTS + """
SELECT n_name AS "Area", c_mktsegment AS "Item", 'Yield' AS "Element", 'USD' AS "Unit", "Yield" AS "Y1997"
FROM long WHERE c_mktsegment = 'BUILDING' AND n_name = 'NATION_1' AND "Year" = 1997""")
def q41_explore_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-16: the elements of one item in one area, with a year's value as it stands in the file."""
    raw = files.read_delimited(spark, production_file(spark, sf_dir), infer=False)
    out = jobs.explore_production(raw, "BUILDING", "NATION_1", years=[1997])["elements"]
    return out.withColumn("Y1997", F.col("Y1997").cast("double"))


SQL_ORDERS_BY_NATION = f"""
by_nation AS (
  SELECT n_name, {SQL_ISO3} AS iso3, n_nationkey, CAST(year(o_orderdate) AS INTEGER) AS "Year",
         count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent,
         count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, 3, 4)"""
ORDER_SOURCES = ["orders", "customer", "nation"]


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orders_by_nation(spark, sf_dir).withColumn("iso3", iso3("n_nationkey"))


@register("q42_load_population", "WITH" + SQL_ORDERS_BY_NATION + """
SELECT n_name AS "Country", iso3 AS "Code", "Year", finished AS "UrbanPopulation", open AS "RuralPopulation" FROM by_nation""")
def q42_load_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-2, SRC-1, PRJ-3, SNK-1: urban and rural population."""
    base = landed(spark, sf_dir, "population", ORDER_SOURCES, lambda at: csv(by_nation(spark, sf_dir).select(
        F.col("n_name").alias("Entity"), F.col("iso3").alias("Code"), "Year", F.col("finished").alias("Urban population"), F.col("open").alias("Rural population")), f"{at}/urban"))
    return jobs.load_urban_population(spark, f"{base}/urban", database(spark, sf_dir, "population"))


@register("q43_load_gdp", """
SELECT n_name AS "Country", """ + SQL_ISO3 + """ AS "Code", CAST(year(l_shipdate) AS INTEGER) AS "Year",
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_extendedprice) AS "GDP"
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3""")
def q43_load_gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-3: a share of GDP per country and year."""

    def write(base: str) -> None:
        means = tables.supplier_nation_means(spark, sf_dir, {"GDP": "l_extendedprice"})
        nation = tables.nation_names(spark, sf_dir).withColumn("iso3", iso3("n_nationkey"))
        csv(means.join(nation, F.col("nationkey") == F.col("n_nationkey")).select(
            F.col("n_name").alias("Entity"), F.col("iso3").alias("Code"), "Year", F.col("GDP").alias(schemas.GDP_SHARE.names[3])), f"{base}/gdp")

    base = landed(spark, sf_dir, "gdp", ["lineitem", "supplier", "nation"], write)
    return jobs.load_gdp_share(spark, f"{base}/gdp", database(spark, sf_dir, "gdp"))


RELIGION_COUNTS = {"Christians": "urgent", "Muslims": "finished", "Hindus": "open", "Buddhists": "urgent", "Folk Religions": "finished",
                   "Other Religions": "open", "Jews": "urgent", "All Religions": "finished"}


@register("q44_load_religion", "WITH" + SQL_ORDERS_BY_NATION + ",\nfew AS (SELECT n_name, \"Year\", "
          + ", ".join(f"CASE WHEN {c} < 2 THEN 10000 ELSE {c} * 1000 END AS {c}" for c in ("urgent", "finished", "open")) + " FROM by_nation)\n"
          + "\nUNION ALL\n".join(f"""SELECT "Year", n_name AS "Country", '{jobs.RELIGIONS[r]}' AS "Religion", {c} AS "Followers", finished AS "Population" FROM few"""
                                 for r, c in RELIGION_COUNTS.items() if r != "All Religions"))
def q44_load_religion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-4, FLT-5, FN-1/2/8/9, RSH-3: text numbers such as ``12,000`` and ``< 10,000``, totals of the world left out."""

    def text(c: str) -> F.Column:
        return F.when(F.col(c) < 2, "< 10,000").otherwise(F.format_number(F.col(c) * 1000, 0))

    def write(base: str) -> None:
        rows = by_nation(spark, sf_dir).select(F.lit(1).alias("row_number"), F.lit(2).alias("level"), F.col("n_nationkey").alias("Nation_fk"), F.lit("r").alias("Region"),
                                               "Year", F.col("n_name").alias("Country"), *[text(c).alias(r) for r, c in RELIGION_COUNTS.items()])
        world = rows.withColumn("Country", F.lit("All Countries"))
        csv(rows.unionByName(world), f"{base}/religion")

    base = landed(spark, sf_dir, "religion", ORDER_SOURCES, write)
    return jobs.load_religion(spark, f"{base}/religion", database(spark, sf_dir, "religion"))


@register("q45_load_corruption", "WITH" + SQL_ORDERS_BY_NATION + """
SELECT n_name AS "Country", iso3 AS "ISO", CASE WHEN "Year" <= 1997 THEN CAST(trunc((finished / 8.0) * 10) AS INTEGER) ELSE CAST(open AS INTEGER) END AS "CPI", "Year"
FROM by_nation WHERE "Year" BETWEEN 1995 AND 2001
UNION ALL
SELECT n.n_name, """ + SQL_ISO3 + """, NULL, y.y FROM nation n, (SELECT unnest(range(1998, 2002)) AS y) y
WHERE n.n_nationkey IN (SELECT n_nationkey FROM by_nation)
  AND (n.n_nationkey, y.y) NOT IN (SELECT (n_nationkey, "Year") FROM by_nation)""")
def q45_load_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-5, SRC-2, SRC-5, RSH-4, SET-1/2, FN-3/4: files per year in two layouts, then a sheet with a column per year."""
    late = range(1998, 2002)

    def write(base: str) -> None:
        rows = by_nation(spark, sf_dir).select("n_name", "iso3", "Year", "finished", "open")
        for year in (1995, 1996, 1997):
            one = rows.where(F.col("Year") == year).select(F.col("n_name").alias("country"), F.col("iso3").alias("iso"), (F.col("finished") / 8.0).alias("score"))
            csv(one if year % 2 else one.select("score", F.lit(1).alias("Rank"), F.col("iso").alias("ISO"), F.col("country").alias("Country")), f"{base}/yearly/CPI-{year}.csv")
        wide = rows.groupBy("n_name", "iso3").pivot("Year", list(late)).agg(F.first("open"))
        columns = ["Country / Territory", "ISO3", *[f"CPI Score {y}" for y in late]]
        line = wide.select(F.lit(1).alias("part"), F.to_csv(F.struct(*wide.columns)).alias("line"))
        head = spark.createDataFrame([(0, i, t) for i, t in enumerate(["CPI 1998-2001,,,,,", "source: sheet,,,,,", ",".join(columns)])], "part int, at int, line string")
        (line.withColumn("at", F.lit(0)).unionByName(head).repartition(1).sortWithinPartitions("part", "at").select("line")  # a row per nation
         .write.mode("overwrite").text(f"{base}/sheet"))

    base = landed(spark, sf_dir, "corruption", ORDER_SOURCES, write)
    out = jobs.corruption_index(spark, f"{base}/yearly", f"{base}/sheet", late[0], late[-1])
    name = f"{database(spark, sf_dir, 'corruption')}.corruption_index"
    catalog.save_table(out, name)
    return catalog.table(spark, name)


SQL_SHIPPED = """
SELECT n_name AS "Country", """ + SQL_ISO3 + """ AS "ISO3", CAST(year(l_shipdate) AS INTEGER) AS "Year",
       CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_tax) AS v
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3"""


def taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = tables.supplier_nation_means(spark, sf_dir, {"v": "l_tax"})
    nation = tables.nation_names(spark, sf_dir).withColumn("iso3", iso3("n_nationkey"))
    return means.join(nation, F.col("nationkey") == F.col("n_nationkey"))


@register("q46_load_emissions", f"""WITH t AS ({SQL_SHIPPED})
SELECT "Country", "ISO3", "Year", {sql_round("v", 6)} AS "Contribution" FROM t WHERE "Year" > 1960""")
def q46_load_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-6, FLT-1, FN-6: contributions after 1960, rounded to six digits."""
    base = landed(spark, sf_dir, "emissions", ["lineitem", "supplier", "nation"], lambda at: csv(taxes(spark, sf_dir).select(
        F.col("n_name").alias("Entity"), F.col("iso3").alias("Code"), "Year", F.col("v").alias(schemas.EMISSION_CONTRIBUTION.names[3])), f"{at}/emissions"))
    return jobs.load_emissions(spark, f"{base}/emissions", database(spark, sf_dir, "emissions"))


@register("q47_load_temperature", f"""WITH t AS ({SQL_SHIPPED})
SELECT "Country", "ISO3", "Year", "Year" || '-01-15' AS "Day", {sql_round("v * 100", 2)} AS "Temperature" FROM t WHERE "Year" > 1960""")
def q47_load_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-7, K8: a header that names a column twice, the second dropped; rounded to two digits."""

    def write(base: str) -> None:
        rows = taxes(spark, sf_dir).select(F.col("n_name").alias("Entity"), F.col("iso3").alias("Code"), F.col("Year").alias("year"),
                                           F.concat("Year", F.lit("-01-15")).alias("Day"), (F.col("v") * 100).alias("Average surface temperature4"),
                                           F.lit(0.0).alias("Average surface temperature5"))
        csv(rows, f"{base}/temperature")

    base = landed(spark, sf_dir, "temperature", ["lineitem", "supplier", "nation"], write)
    return jobs.load_surface_temperature(spark, f"{base}/temperature", database(spark, sf_dir, "temperature"))


@register("q48_load_codes_and_stations", f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, 'N' || n_nationkey AS "ISO2", {SQL_ISO3} AS "ISO3", n_nationkey AS "ISONum", n_name AS "Country"
FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY c_custkey LIMIT 100""")
def q48_load_codes_and_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-8, SRC-4, JON-2, LIM-1: the hub from its file, stations from JSON arrays, the first hundred by id."""

    def write(base: str) -> None:
        nation = tables.nation_names(spark, sf_dir)
        csv(nation.select(F.concat(F.lit("N"), "n_nationkey").alias("iso2"), iso3("n_nationkey").alias("iso3"), F.col("n_nationkey").alias("iso_num"),
                          F.col("n_name").alias("country"), F.col("n_name").alias("country_common")), f"{base}/codes")
        station = F.struct(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("country"), F.lit(1).alias("elevation"))
        # a station list is a JSON array; one array per hundred stations here
        arrays = load(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 100").alias("part")).agg(F.collect_list(station).alias("list"))
        arrays.select(F.to_json("list")).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 1).text(f"{base}/stations")

    base = landed(spark, sf_dir, "codes-and-stations", ["customer", "nation"], write)
    codes = jobs.load_country_codes(spark, f"{base}/codes", database(spark, sf_dir, "codes"))
    stations = files.read_stations(spark, f"{base}/stations").withColumnRenamed("country", "At")
    rows = stations.join(codes, F.col("At") == F.col("ISO2")).select("id", "ISO2", "ISO3", "ISONum", "Country", F.col("id").cast("long").alias("at"))
    return preview(rows, 100, ["at"]).drop("at")


@register("q49_flags_from_file", """
SELECT o_orderstatus AS "Flag", f.text AS "Flags", count(*) AS "count"
FROM orders LEFT JOIN (VALUES """ + ", ".join(f"('{c}', '{t}')" for c, t in schemas.FLAG_VALUES) + """) f(code, text) ON f.code = o_orderstatus GROUP BY 1, 2""")
def q49_flags_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8, SNK-2: the flag table written as a file, read back and joined to the facts."""
    path = scratch_path(spark, "flags")
    catalog.save_files(files.lookup_from_values(spark, schemas.FLAG_VALUES).coalesce(1), path, fmt="csv", header="true")
    counts = load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("Flag")).count()
    return counts.join(files.read_lookup(spark, path), "Flag", "left").select("Flag", "Flags", "count")


@register("q50_series_range_and_r", "WITH" + SQL_FEATURES + """,
s AS (SELECT * FROM features WHERE "Country" = 'NATION_1' AND "Item" = 'BUILDING')
SELECT 'min_Yield' AS figure, CAST(min("Yield") AS DOUBLE) AS value FROM s UNION ALL SELECT 'max_Yield', max("Yield") FROM s
UNION ALL SELECT 'min_Temperature', min("Temperature") FROM s UNION ALL SELECT 'max_Temperature', max("Temperature") FROM s
UNION ALL SELECT 'r', round(CASE WHEN isnan(corr("Temperature", "Yield")) THEN NULL ELSE corr("Temperature", "Yield") END, 6) + CAST(0 AS DOUBLE) FROM s""")
def q50_series_range_and_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-12, FLT-3, AGG-9, STA-2: one series' ranges and correlation, as figures."""
    _, ranges, r = jobs.series_correlation(tables.star_features(spark, sf_dir), "NATION_1", "BUILDING")
    figures = F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in ranges.columns]))
    return ranges.select(figures).unionByName(r.select(F.lit("r").alias("figure"), F.round("r", 6).alias("value")))
