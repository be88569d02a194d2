"""Star-schema analogues of every operator, with their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and reads whole tables from
``sf_dir``; ``ORACLE`` holds the equivalent DuckDB SQL over the same tables
(pre-registered as views). Computed columns carry the same alias on both
sides. Results are compared exactly, so sums never depend on the order
partial results are combined in: money is summed as integer cents in Spark
and as ``DECIMAL(18,2)`` in DuckDB (the same exact total, the same nearest
double); two-decimal readings are given as whole cents, whose sums and means
are exact; ``sql_round`` rounds in DuckDB the way Spark's ``round`` does.
Regressions and principal components are solved in SQL too, by elimination and
by repeated squaring; recipe m3 has no oracle and is tested against numpy in
``tests/test_queries.py``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cropstats.functions.clean import (
    clean_name,
    clean_names,
    display_number,
    map_columns,
    not_contains,
    null_to_zero,
    rename,
    scale_truncate,
    strip_and_cast,
)
from cropstats.operators import linear
from cropstats.operators.explore import members, value_counts, with_series_range
from cropstats.operators.joins import (
    keys_present_in,
)
from cropstats.operators.ml import (
    assemble,
    bucket_split,
    categorical,
    digest_bucket,
    evaluate,
    linear_regression,
    minmax,
    pca_by_group,
    pca_pipeline,
    recipe,
    standardize,
)
from cropstats.operators.reshape import explode_measures, unpivot_years
from cropstats.operators.stats import corr_matrix, corr_pairs, matrix_to_long
from cropstats.operators.wide_stats import corr_wide
from cropstats.operators.weather import (
    Measure,
    combine_stations,
    station_period,
    station_year,
)
from cropstats.plans.jobs import SCORED, country_weather, regression, scored_table
from cropstats.plans.tables import (
    LANDING_LOCK,
    crop_yield,
    land_csv,
    landed_path,
    load,
    mark_landed,
    money,
    star_features,
    whole_features,
    yearly_orders_wide,
)
from cropstats.schemas import FLAG_VALUES
from cropstats.session import checkpoint_dir, scratch_path
from cropstats.sources import models
from cropstats.sources.catalog import databases, ensure_database, save_table, table
from cropstats.streaming.stations import ingest_station_files
from cropstats.sources.files import (
    lookup_from_values,
    read_sheet_export,
    read_station_daily,
    read_yearly_files,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# --- shared SQL fragments -------------------------------------------------------

def sql_round(expr: str, digits: int) -> str:
    """DuckDB rounding that matches Spark's ``round`` of a double.

    Spark rounds half-up on the double's shortest decimal text (35.935 →
    35.94); DuckDB's ``round(double)`` works on the binary value
    (35.934999… → 35.93). Going through text and an exact DECIMAL gives the
    Spark result.
    """
    return (f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,18)), {digits}) "
            f"AS DOUBLE)")


SQL_FACTS = """
facts AS (
  SELECT c.c_nationkey, c.c_mktsegment, CAST(year(o.o_orderdate) AS INTEGER) AS yr,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v,
         MAX(o.o_orderstatus) AS f, MAX(o.o_orderpriority) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2, 3),
fkeys AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM facts),
fyears AS (SELECT DISTINCT yr FROM facts),
long AS (
  SELECT nn.n_nationkey, nn.n_name, k.c_mktsegment, y.yr AS "Year",
         facts.v AS "Yield", facts.f AS "YearFlag", facts.n AS "YearNote"
  FROM fkeys k CROSS JOIN fyears y
  JOIN nation nn ON nn.n_nationkey = k.c_nationkey
  LEFT JOIN facts ON facts.c_nationkey = k.c_nationkey
       AND facts.c_mktsegment = k.c_mktsegment AND facts.yr = y.yr)"""

SQL_FEATURES = """
facts AS (
  SELECT c.c_nationkey, c.c_mktsegment AS "Item", CAST(year(o.o_orderdate) AS INTEGER) AS "Year",
         o.o_orderstatus AS "Element",
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2, 3, 4),
shipped AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS "Year", SUM(l_quantity) AS units
  FROM lineitem GROUP BY 1, 2),
temp AS (
  SELECT s.s_nationkey AS nationkey, "Year", AVG(units) AS "Temperature"
  FROM shipped JOIN supplier s ON l_suppkey = s.s_suppkey GROUP BY 1, 2),
features AS (
  SELECT facts."Year", n.n_name AS "Country", "Item", "Element", 'USD' AS "Unit",
         CAST(trunc(v) AS BIGINT) AS "Yield", """ + sql_round('temp."Temperature"', 2) + """ AS "Temperature"
  FROM facts JOIN nation n ON n.n_nationkey = c_nationkey
  JOIN temp ON temp.nationkey = c_nationkey AND temp."Year" = facts."Year"
  WHERE "Element" = 'F')"""

#: The features of all orders, zero where a nation's item has none in a year, beside those of one element.
SQL_WHOLE_FEATURES = SQL_FEATURES.replace("facts", "elements").replace("features AS", "element_features AS") + "," + SQL_FACTS + """,
price AS (
  SELECT s.s_nationkey AS nationkey, CAST(year(l.l_shipdate) AS INTEGER) AS "Year",
         CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l.l_extendedprice) AS "GDP"
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
attr AS (
  SELECT c_nationkey AS nationkey,
         CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(c_acctbal) AS "AcctBal"
  FROM customer GROUP BY 1),
features AS (
  SELECT long."Year", long.n_name AS "Country", long.c_mktsegment AS "Item", 'USD' AS "Unit",
         hub.n_regionkey AS "Region",
         CASE WHEN long."Yield" IS NULL THEN 0 ELSE CAST(trunc(long."Yield") AS BIGINT) END AS "Yield",
         """ + sql_round('temp."Temperature"', 2) + """ AS "Temperature",
         """ + sql_round('price."GDP"', 2) + """ AS "GDP", attr."AcctBal",
         e."Element", e."Yield" AS "ElementYield"
  FROM long
  JOIN nation hub ON hub.n_nationkey = long.n_nationkey
  JOIN temp ON temp.nationkey = long.n_nationkey AND temp."Year" = long."Year"
  JOIN price ON price.nationkey = long.n_nationkey AND price."Year" = long."Year"
  JOIN attr ON attr.nationkey = long.n_nationkey
  LEFT JOIN element_features e ON e."Country" = long.n_name AND e."Item" = long.c_mktsegment
       AND e."Year" = long."Year")"""

LONG_KEYS = ["n_nationkey", "n_name", "c_mktsegment"]


# --- Q01/Q02: wide yearly layout → long ------------------------------------------

@register("q01_unpivot_years", "WITH" + SQL_FACTS + "\nSELECT * FROM long")
def q01_unpivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-2, PRJ-7: one Generate over one scan of the wide table."""
    return unpivot_years(yearly_orders_wide(spark, sf_dir), id_cols=LONG_KEYS)


@register("q02_unpivot_three_melts", "WITH" + SQL_FACTS + "\nSELECT * FROM long")
def q02_unpivot_three_melts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-1, RSH-5, JON-1: the reference's three melts + two left joins (keys non-null)."""
    return unpivot_years(yearly_orders_wide(spark, sf_dir), id_cols=LONG_KEYS, strict_join=True)


# --- Q10/Q13: features through the hub, correlations per group ---------------------

@register("q10_feature_join", "WITH" + SQL_WHOLE_FEATURES
          + "\nSELECT * FROM features WHERE \"Item\" = 'BUILDING'")
def q10_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-10, JON-3/4/5, AGG-6, FN-3/6/7/11, FLT-2: wide table → long → ``build_features`` for one item.

    All orders count in ``Yield``; the element (finished orders) is a column
    beside it and drops no row. The item filter reaches the scans of the wide
    table and of customer, the element filter that of the element's orders.
    """
    return whole_features(spark, sf_dir).where(F.col("Item") == "BUILDING")


SQL_FEATURES_V2 = SQL_FEATURES + """,
gdp AS (
  SELECT s.s_nationkey AS nationkey, CAST(year(l.l_shipdate) AS INTEGER) AS "Year",
         CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l.l_extendedprice)
           AS "GDP"
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
attrs AS (
  SELECT c.c_nationkey AS nationkey, CAST(year(o.o_orderdate) AS INTEGER) AS "Year",
         nullif(count(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 END), 0) AS "CorruptionIndex",
         count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) AS "UrbanPopulation",
         count(CASE WHEN o.o_orderstatus = 'O' THEN 1 END) AS "RuralPopulation"
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2),
features_v2 AS (
  SELECT f.*, """ + sql_round("gdp.\"GDP\"", 2) + """ AS "GDP", a."CorruptionIndex",
         a."UrbanPopulation", a."RuralPopulation"
  FROM features f
  JOIN nation hub2 ON hub2.n_name = f."Country"
  JOIN gdp ON gdp.nationkey = hub2.n_nationkey AND gdp."Year" = f."Year"
  JOIN attrs a ON a.nationkey = hub2.n_nationkey AND a."Year" = f."Year"
  WHERE a."CorruptionIndex" IS NOT NULL)"""


@register("q10b_feature_join_v2", "WITH" + SQL_FEATURES_V2
          + "\nSELECT * FROM features_v2 WHERE \"Item\" = 'BUILDING'")
def q10b_feature_join_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-11, JON-5, FLT-4, FN-6: ``build_features`` over the six-table star, two-column keys."""
    return star_features(spark, sf_dir, version=2).where(F.col("Item") == "BUILDING")


FEATURE_VARS = ["Yield", "Temperature"]


def _sql_corr_pairs(source: str, cols: list[str], by: list[str], digits: int) -> str:
    """DuckDB: every ordered pair's corr, NaN → NULL, rounded; ``+ 0.0`` turns the
    -0.0 DuckDB's round can return into 0.0 (Spark's round never gives -0.0)."""
    keys = ", ".join(f'"{k}"' for k in by)
    parts = []
    for a in cols:
        for b in cols:
            parts.append(
                f"SELECT {keys + ', ' if keys else ''}'{a}' AS var_x, '{b}' AS var_y, "
                f"round(CASE WHEN isnan(corr(\"{a}\", \"{b}\")) THEN NULL "
                f"ELSE corr(\"{a}\", \"{b}\") END, {digits}) + CAST(0 AS DOUBLE) AS r "
                f"FROM {source}" + (f" GROUP BY {keys}" if keys else ""))
    return "\nUNION ALL\n".join(parts)


WHOLE_VARS = ["Yield", "Temperature", "GDP", "AcctBal", "ElementYield"]


@register("q13_corr_by_group", "WITH" + SQL_WHOLE_FEATURES + "\n"
          + _sql_corr_pairs("features", WHOLE_VARS, ["Country"], 4))
def q13_corr_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-3: all 5×5 correlations per country in one grouped aggregate, over orders of every status and year."""
    return corr_pairs(whole_features(spark, sf_dir), WHOLE_VARS, by=["Country"], digits=4)


FEATURE_VARS_V2 = ["Yield", "Temperature", "GDP", "CorruptionIndex", "UrbanPopulation",
                   "RuralPopulation"]


@register("q13c_corr_features_v2", "WITH" + SQL_FEATURES_V2 + "\n"
          + _sql_corr_pairs("features_v2", FEATURE_VARS_V2, ["Country"], 4))
def q13c_corr_features_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-3 on the v2 feature table (JOB-14 analogue): 6 × 6 correlations per country."""
    return corr_pairs(star_features(spark, sf_dir, version=2), FEATURE_VARS_V2,
                      by=["Country"], digits=4)


DIMENSIONS, SLICES = 64, 4


@register("q13d_corr_many_columns", f"""
WITH e AS (SELECT vec_id % {SLICES} AS slice, vec_id, unnest(embedding) AS x, unnest(range({DIMENSIONS})) AS i FROM embeddings)
SELECT a.slice, 'd' || a.i AS var_x, 'd' || b.i AS var_y,
       round(CASE WHEN isnan(corr(a.x::DOUBLE, b.x::DOUBLE)) THEN NULL ELSE corr(a.x::DOUBLE, b.x::DOUBLE) END, 6) + CAST(0 AS DOUBLE) AS r
FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2, 3""")
def q13d_corr_many_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-2/STA-3 over 64 columns: every pair of embedding dimensions per slice, one job."""
    vectors = load(spark, sf_dir, "embeddings").select(
        F.pmod("vec_id", F.lit(SLICES)).alias("slice"), *[F.get("embedding", F.lit(i)).alias(f"d{i}") for i in range(DIMENSIONS)])
    return corr_wide(vectors, [f"d{i}" for i in range(DIMENSIONS)], ["slice"], digits=6)


# --- Q03..Q09: reshaping, cleaning, unions, semi joins --------------------------------

@register("q03_explode_measures", """
SELECT c_custkey, 'c_acctbal' AS "Measure", CAST(c_acctbal AS DOUBLE) AS "Value" FROM customer
UNION ALL
SELECT c_custkey, 'c_nationkey' AS "Measure", CAST(c_nationkey AS DOUBLE) AS "Value" FROM customer""")
def q03_explode_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-3, FN-9, PRJ-9: several measure columns → (name, value) rows."""
    return explode_measures(load(spark, sf_dir, "customer"), ["c_custkey"],
                            ["c_acctbal", "c_nationkey"], value_type="double")


@register("q03b_explode_years", """
WITH f AS (
  SELECT c.c_nationkey, CAST(year(o.o_orderdate) AS INTEGER) AS yr, count(*) AS v
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2),
k AS (SELECT DISTINCT c_nationkey FROM f),
y AS (SELECT DISTINCT yr FROM f)
SELECT k.c_nationkey, y.yr AS "Year", f.v AS "Value"
FROM k CROSS JOIN y LEFT JOIN f ON f.c_nationkey = k.c_nationkey AND f.yr = y.yr""")
def q03b_explode_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-4: integer-labelled columns (orders per year, pivoted) → (Year, Value) rows."""
    counts = (load(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"))
              .join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
                    F.col("o_custkey") == F.col("c_custkey"))
              .groupBy("c_nationkey", "yr").count())
    # nations × years rows, checkpointed; the distinct years are observed in
    # the same job, so the pivot needs no second pass over orders ⋈ customer
    checkpoint_dir(spark)
    seen = Observation("count_years")
    counts = counts.observe(seen, F.collect_set("yr").alias("years")).checkpoint(eager=True)
    wide = counts.groupBy("c_nationkey").pivot("yr", sorted(seen.get["years"])).sum("count")
    years = [c for c in wide.columns if c != "c_nationkey"]
    return explode_measures(wide, ["c_nationkey"], {int(y): y for y in years},
                            name_col="Year", value_col="Value", name_type="int")


@register("q04_strip_and_cast", """
SELECT c_custkey, TRY_CAST(TRY_CAST(replace(c_name, 'Customer#', '') AS DOUBLE) AS INTEGER) AS c_name
FROM customer""")
def q04_strip_and_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-1, FN-2, PRJ-6: strip a pattern from chosen columns and cast, ANSI-safe."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return map_columns(customers, ["c_name"], lambda c: strip_and_cast(c, "Customer#", "int"))


@register("q05_format_number", """
SELECT s_suppkey, format('{:,.2f}', s_acctbal) AS acctbal_text FROM supplier""")
def q05_format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-5: presentation string with thousands separators."""
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey", display_number("s_acctbal", 2).alias("acctbal_text"))


@register("q06_rescale_truncate", """
SELECT s_suppkey, CAST(trunc(s_acctbal * 10) AS INTEGER) AS score FROM supplier""")
def q06_rescale_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-3, FN-4: (x × 10) truncated to int, as the corruption-index rescale."""
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey", scale_truncate("s_acctbal", 10).alias("score"))


@register("q07_null_to_zero", """
SELECT n.n_nationkey, n.n_name,
       CASE WHEN s.total IS NULL THEN 0 ELSE s.total END AS supplier_acctbal
FROM nation n LEFT JOIN (
  SELECT s_nationkey, CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def q07_null_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-7, JON-1: left join to a pre-aggregated side, missing → 0."""
    totals = (load(spark, sf_dir, "supplier").groupBy("s_nationkey")
              .agg(money("s_acctbal").alias("total")))
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (nation.join(totals, F.col("n_nationkey") == F.col("s_nationkey"), "left")
                  .select("n_nationkey", "n_name",
                          null_to_zero("total").alias("supplier_acctbal")))


@register("q08_union_years", """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS "Year"
FROM orders""")
def q08_union_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SET-1, SET-2, PRJ-5: per-year files in two column layouts, unioned by name.

    The orders are landed (once per source folder) as one CSV folder per year,
    even years in one column order, odd years reordered, with an extra column
    and names in another case;
    the query reads them back with the year taken from the path.
    """
    with LANDING_LOCK:
        base, done = landed_path(spark, "orders-by-year-2", sf_dir, ["orders"])
        if not done:
            orders = load(spark, sf_dir, "orders").select(
                "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("yr"))
            even = F.pmod(F.col("yr"), F.lit(2)) == 0
            land_csv(orders.where(even).select("o_orderkey", "o_custkey", "o_totalprice", "yr"),
                     f"{base}/layout_a", "yr")
            land_csv(orders.where(~even).select(F.col("o_totalprice").alias("O_TotalPrice"), F.lit("x").alias("note"),
                                                "o_custkey", F.col("o_orderkey").alias("O_ORDERKEY"), "yr"),
                     f"{base}/layout_b", "yr")
            mark_landed(spark, base)
    return read_yearly_files(spark, base, {"o_orderkey": "bigint", "o_custkey": "bigint",
                                           "o_totalprice": "double"}, r"yr=(\d{4})")


@register("q09_country_dim", """
SELECT DISTINCT n.n_nationkey, n.n_name, n.n_regionkey
FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey""")
def q09_country_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-8, AGG-7: codes that occur in the facts, as a left-semi join + distinct."""
    return keys_present_in(load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer"),
                           "n_nationkey", "c_nationkey")


# --- Q11: two-level aggregate (weather analogue) ----------------------------------------

EVENT_MEASURES = (
    Measure("AverageValue", "mean", "value", country_digits=2),
    Measure("MinimumValue", "min", "value"),
    Measure("MaximumValue", "max", "value"),
    Measure("TotalValue", "sum", "value", country_digits=2),
)


def whole_cents(c: str) -> F.Column:
    """Two-decimal readings as whole numbers: sums and means of them are exact in any order."""
    return F.rint(F.col(c) * 100)


SQL_CENTS = "CAST(round(value * 100) AS BIGINT)"


@register("q11_two_level_agg", f"""
WITH st AS (
  SELECT event_type, user_id, CAST(ts AS DATE) AS "Day", AVG({SQL_CENTS}) AS m,
         min({SQL_CENTS}) AS mn, max({SQL_CENTS}) AS mx, CAST(COALESCE(SUM({SQL_CENTS}), 0) AS DOUBLE) AS tc
  FROM events GROUP BY 1, 2, 3)
SELECT event_type, "Day", {sql_round("avg(m)", 2)} AS "AverageValue",
       CAST(min(mn) AS DOUBLE) AS "MinimumValue", CAST(max(mx) AS DOUBLE) AS "MaximumValue", sum(tc) AS "TotalValue"
FROM st GROUP BY 1, 2""")
def q11_two_level_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3/4/5, FN-10: per (station, day) figures, then per (country, day).

    Station = (event type, user), country = event type: each station belongs
    to one country, as in the weather job. Readings are whole cents, so a
    station's mean is the exact sum over the count.
    """
    events = load(spark, sf_dir, "events").withColumn("value", whole_cents("value"))
    per_station = station_period(events, ["event_type", "user_id"],
                                 F.to_date("ts"), "Day", EVENT_MEASURES)
    return combine_stations(per_station, ["event_type", "Day"], EVENT_MEASURES)


# --- Q12..Q14: correlations ---------------------------------------------------------------

LINE_VARS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("q12_corr_pairs", "WITH t AS (SELECT * FROM lineitem)\n"
          + _sql_corr_pairs("t", LINE_VARS, [], 6))
def q12_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-2: all pairs, pairwise-complete, one aggregate, long output."""
    return corr_pairs(load(spark, sf_dir, "lineitem"), LINE_VARS, digits=6)


@register("q13b_corr_returnflag", "WITH t AS (SELECT * FROM lineitem)\n"
          + _sql_corr_pairs("t", ["l_quantity", "l_extendedprice"], ["l_returnflag"], 6))
def q13b_corr_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-3 on a raw table: pairs per return flag."""
    return corr_pairs(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"],
                      by=["l_returnflag"], digits=6)


@register("q14_corr_matrix", "WITH t AS (SELECT * FROM lineitem)\n"
          + _sql_corr_pairs("t", LINE_VARS, [], 6))
def q14_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STA-1, ML-1: ``Correlation.corr`` matrix (k × k) → long table."""
    m = corr_matrix(load(spark, sf_dir, "lineitem"), LINE_VARS)
    return matrix_to_long(spark, m, LINE_VARS, digits=6)


# --- Q15..Q22: ML stages ------------------------------------------------------------------

SQL_TYPE_RANK = """
ranked AS (
  SELECT p_type, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS INTEGER) AS idx
  FROM part GROUP BY p_type)"""


@register("q15_string_index", "WITH" + SQL_TYPE_RANK
          + "\nSELECT p_type, idx AS p_type_idx FROM ranked")
def q15_string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2, FN-13: frequency-ordered label index (ties by label)."""
    part = load(spark, sf_dir, "part")
    stages = categorical(["p_type"])
    model = stages[0].fit(part)
    return (model.transform(part)
            .select("p_type", F.col("p_type_rank").cast("int").alias("p_type_idx"))
            .distinct())


ONE_HOT_WIDTH = 5  # six part types, last level dropped


@register("q16_one_hot", "WITH" + SQL_TYPE_RANK + "\nSELECT p.p_partkey, "
          + ", ".join(f"CAST(CASE WHEN r.idx = {j} THEN 1 ELSE 0 END AS DOUBLE) AS oh_{j}"
                      for j in range(ONE_HOT_WIDTH))
          + "\nFROM part p JOIN ranked r ON r.p_type = p.p_type")
def q16_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-3: one-hot of the label index, last level dropped, as columns."""
    part = load(spark, sf_dir, "part")
    model = Pipeline(stages=categorical(["p_type"], drop_last=True)).fit(part)
    width = len(model.stages[0].labelsArray[0]) - 1
    arr = vector_to_array(F.col("p_type_dummies"))
    return model.transform(part).select(
        "p_partkey", *[arr[j].alias(f"oh_{j}") for j in range(width)])


@register("q17_min_max", """
SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ())
       / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 9) AS scaled
FROM part""")
def q17_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-5: MinMaxScaler over one column."""
    part = load(spark, sf_dir, "part")
    model = Pipeline(stages=minmax("p_retailprice", "scaled_vec")).fit(part)
    return model.transform(part).select(
        "p_partkey", F.round(vector_to_array(F.col("scaled_vec"))[0], 9).alias("scaled"))


@register("q18_standardize", """
SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ())
       / stddev_samp(p_retailprice) OVER (), 9) + CAST(0 AS DOUBLE) AS standardized
FROM part""")
def q18_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6: StandardScaler with mean and std."""
    part = load(spark, sf_dir, "part")
    model = Pipeline(stages=[assemble(["p_retailprice"], "v"),
                             standardize("v", "std_vec")]).fit(part)
    return model.transform(part).select(
        "p_partkey", F.round(vector_to_array(F.col("std_vec"))[0], 9).alias("standardized"))


SQL_PART_STD = """
s AS (
  SELECT p_type,
         (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS x,
         (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS y
  FROM part),
c AS (SELECT corr(p_retailprice, p_size) AS r FROM part)"""

PCA_INPUTS = ["p_retailprice", "p_size"]


def _part_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_type", *[F.col(c).cast("double").alias(c) for c in PCA_INPUTS])


@register("q19_pca_by_group", "WITH" + SQL_PART_STD + """
SELECT p_type, round(abs(avg((x + sign(c.r) * y) / sqrt(2))), 6) AS pc1_mean_abs,
       round(abs(avg((x - sign(c.r) * y) / sqrt(2))), 6) AS pc2_mean_abs
FROM s, c GROUP BY p_type""")
def q19_pca_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6/7/8, AGG-8: PCA(2) of standardised columns, mean coordinates per group.

    Absolute values: with two standardised inputs both loadings of a
    component have equal magnitude, so no sign rule can fix them (K19).
    """
    means = pca_by_group(_part_numeric(spark, sf_dir), PCA_INPUTS, ["p_type"], k=2)
    return means.select("p_type", F.round(F.abs("PC1"), 6).alias("pc1_mean_abs"),
                        F.round(F.abs("PC2"), 6).alias("pc2_mean_abs"))


@register("q20_pca_variance", """
WITH c AS (SELECT corr(p_retailprice, p_size) AS r FROM part)
SELECT 1 AS component, round((1 + abs(r)) / 2, 9) AS explained FROM c
UNION ALL
SELECT 2 AS component, round((1 - abs(r)) / 2, 9) AS explained FROM c""")
def q20_pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-7: explained variance ratio of each component (k values)."""
    model = pca_pipeline(PCA_INPUTS, k=2).fit(_part_numeric(spark, sf_dir))
    ratios = [float(v) for v in model.stages[-1].explainedVariance]
    out = spark.createDataFrame([(i + 1, v) for i, v in enumerate(ratios)],
                                "component int, explained double")
    return out.withColumn("explained", F.round("explained", 9))


PCA_V2_INPUTS = ["Temperature", "GDP", "CorruptionIndex", "UrbanPopulation", "RuralPopulation"]
CATEGORIES = ["Country", "Item"]


def _sql_design(source: str, numeric: list[str], categories: list[str], label: str | None) -> str:
    """CTEs: levels, means and the Gram matrix (a list of lists, the label last) of a design.

    Columns: 1, the levels of each category by frequency, the centred numeric
    columns. ``width`` has the number of levels of each category.
    """
    values = [*numeric, *([label] if label else [])]
    names = ", ".join(f'"{c}"' for c in [*categories, *values])
    ctes = [f"train AS (SELECT row_number() OVER () AS rid, {names} FROM {source})",
            "mu AS (SELECT count(*) AS n" + "".join(f', avg("{x}") AS m{j}' for j, x in enumerate(numeric)) + " FROM train)"]
    for k, c in enumerate(categories):
        ctes.append(f'lv{k} AS (SELECT "{c}", row_number() OVER (ORDER BY count(*) DESC, "{c}") AS idx FROM train GROUP BY 1)')
    before = ["1"]
    for k in range(len(categories)):
        before.append(f"{before[-1]} + (SELECT count(*) FROM lv{k})")
    parts = ["SELECT rid, 1 AS i, CAST(1 AS DOUBLE) AS x FROM train"]
    parts += [f'SELECT rid, {before[k]} + idx, 1 FROM train JOIN lv{k} USING ("{c}")' for k, c in enumerate(categories)]
    parts += [f'SELECT rid, {before[-1]} + {j + 1}, "{x}" - ' + (f"m{j}" if j < len(numeric) else "0") + " FROM train, mu" for j, x in enumerate(values)]
    ctes += ["design AS (" + " UNION ALL ".join(parts) + ")", f"width AS (SELECT {before[-1]} + {len(numeric)} AS k)",
             "products AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM design a JOIN design b USING (rid) GROUP BY 1, 2)",
             f"grid AS (SELECT a.i, b.j FROM (SELECT unnest(range(1, k + 1)) AS i FROM width) a, (SELECT unnest(range(1, k + {1 + bool(label)})) AS j FROM width) b)",
             "lines AS (SELECT i, list(coalesce(v, 0) ORDER BY j) AS r FROM grid LEFT JOIN products USING (i, j) GROUP BY i)",
             "gram AS (SELECT list(r ORDER BY i) AS m FROM lines)"]
    return ",\n".join(ctes)


def _sql_least_squares(source: str, numeric: list[str]) -> str:
    """CTEs that solve the normal equations of ``source`` by elimination: ``coef`` has the list ``b``."""
    return _sql_design(source, numeric, CATEGORIES, "Yield") + """,
elim AS (
  SELECT 0 AS step, m, list_transform(m, lambda r, i: r[i]) AS d FROM gram
  UNION ALL
  SELECT step + 1,
         CASE WHEN m[step + 1][step + 1] <= 1e-9 * d[step + 1]
              THEN list_transform(m, lambda r, i: list_transform(r, lambda z, j: CASE WHEN i = step + 1 OR j = step + 1 THEN 0 ELSE z END))
              ELSE list_transform(m, lambda r, i: CASE WHEN i = step + 1 THEN list_transform(r, lambda z: z / m[step + 1][step + 1])
                   ELSE list_transform(r, lambda z, j: z - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END) END, d
  FROM elim WHERE step < len(d)),
coef AS (SELECT list_transform(m, lambda r: r[len(r)]) AS b FROM elim WHERE step = len(d))"""


def _sql_scored(source: str, numeric: list[str]) -> str:
    """A SELECT of ``source`` with ``prediction`` (NULL where a level is unseen), after ``_sql_least_squares``."""
    terms = " + ".join(f'b[1 + (SELECT count(*) FROM lv0) + (SELECT count(*) FROM lv1) + {j + 1}] * (s."{x}" - m{j})' for j, x in enumerate(numeric))
    return f"""SELECT s.*, b[1] + b[1 + lv0.idx] + b[1 + (SELECT count(*) FROM lv0) + lv1.idx] + {terms} AS prediction
FROM {source} s LEFT JOIN lv0 USING ("Country") LEFT JOIN lv1 USING ("Item"), mu, coef"""


def _sql_spectrum(source: str, numeric: list[str], categories: list[str], k: int) -> str:
    """CTEs of the first ``k`` principal components of a standardised design: ``pc<j>`` has vector ``v``; ``st`` scale and mean."""
    product = "list_transform(a, lambda r: list_transform(r, lambda z, j: list_sum(list_transform(r, lambda y, i: y * a[i][j]))))"
    sql = _sql_design(source, numeric, categories, None) + """,
cov AS (SELECT n, list_transform(m[2:], lambda r, i: list_transform(r[2:], lambda z, j: (z - m[1][i + 1] * m[1][j + 1] / n) / (n - 1))) AS c,
               list_transform(m[1][2:], lambda z: z / n) AS mean FROM gram, mu),
st AS (SELECT list_transform(c, lambda r, i: CASE WHEN r[i] > 1e-24 THEN 1 / sqrt(r[i]) ELSE 0 END) AS scale, mean, c FROM cov),
rest0 AS (SELECT list_transform(c, lambda r, i: list_transform(r, lambda z, j: z * scale[i] * scale[j])) AS a FROM st)"""
    for j in range(k):
        sql += f""",
sq{j} AS (
  SELECT 0 AS step, a FROM rest{j}
  UNION ALL
  SELECT step + 1, {product}
  FROM (SELECT step, list_transform(a, lambda r: list_transform(r, lambda z: z / list_max(list_transform(a, lambda q: list_max(list_transform(q, lambda y: abs(y))))))) AS a FROM sq{j}) WHERE step < 40),
col{j} AS (SELECT a[list_position(nn, list_max(nn))] AS u FROM (SELECT a, list_transform(a, lambda r: list_sum(list_transform(r, lambda z: z * z))) AS nn FROM sq{j} WHERE step = 40)),
pc{j} AS (
  SELECT list_transform(u, lambda z: z / sqrt(list_sum(list_transform(u, lambda y: y * y)))
         * CASE WHEN u[list_position(list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))] < 0 THEN -1 ELSE 1 END) AS v FROM col{j}),
val{j} AS (SELECT list_sum(list_transform(a, lambda r, i: v[i] * list_sum(list_transform(r, lambda z, j: z * v[j])))) AS e FROM rest{j}, pc{j}),
rest{j + 1} AS (SELECT list_transform(a, lambda r, i: list_transform(r, lambda z, j: z - e * v[i] * v[j])) AS a FROM rest{j}, pc{j}, val{j})"""
    return sql


def _sql_pca_means(categories: list[str]) -> str:
    """Mean coordinates per country of the v2 features."""
    offset = " + ".join(["0", *[f"(SELECT count(*) FROM lv{k})" for k in range(len(categories))]])
    coordinate = lambda j: " + ".join(
        [*[f"pc{j}.v[{' + '.join(['0', *[f'(SELECT count(*) FROM lv{i})' for i in range(k)]])} + lv{k}.idx] * scale[{' + '.join(['0', *[f'(SELECT count(*) FROM lv{i})' for i in range(k)]])} + lv{k}.idx]" for k in range(len(categories))],
         *[f'pc{j}.v[{offset} + {i + 1}] * scale[{offset} + {i + 1}] * (f."{x}" - m{i})' for i, x in enumerate(PCA_V2_INPUTS)]])
    shift = lambda j: f"list_sum(list_transform(pc{j}.v, lambda z, i: z * scale[i] * mean[i]))"
    joins = "".join(f' JOIN lv{k} USING ("{c}")' for k, c in enumerate(categories))
    return ("WITH RECURSIVE" + SQL_FEATURES_V2 + ",\n" + _sql_spectrum("features_v2", PCA_V2_INPUTS, categories, 2) + """
SELECT "Country", """ + ", ".join(f"round(avg({coordinate(j)} - {shift(j)}), 6) + CAST(0 AS DOUBLE) AS \"PC{j + 1}\"" for j in range(2))
            + f"\nFROM features_v2 f{joins}, st, mu, pc0, pc1 GROUP BY 1")


def _pca_means(spark: SparkSession, sf_dir: str, categories: list[str]) -> DataFrame:
    features = star_features(spark, sf_dir, version=2)
    spectrum, _, _ = linear.components(linear.gram(features, PCA_V2_INPUTS, categories), 2)
    return (spectrum.score(features).groupBy("Country")
            .agg(F.round(F.avg("PC1"), 6).alias("PC1"), F.round(F.avg("PC2"), 6).alias("PC2")))


@register("q19b_pca_features_v2", _sql_pca_means([]))
def q19b_pca_features_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-6/7, AGG-8, JOB-15: PCA(2) of the standardised v2 features, mean PC1/PC2 per country (K19)."""
    return _pca_means(spark, sf_dir, [])


@register("q19c_pca_with_categories", _sql_pca_means(CATEGORIES))
def q19c_pca_with_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-4, JOB-15 with the one-hot country and item beside the numeric features."""
    return _pca_means(spark, sf_dir, CATEGORIES)


def split_bucket() -> F.Column:
    return F.pmod(F.col("l_orderkey") * F.lit(7919), F.lit(100))


@register("q21_regression_eval", """
WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, (l_orderkey * 7919) % 100 AS b
           FROM lineitem),
fit AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS c FROM d WHERE b < 80),
t AS (SELECT y, fit.c + fit.a * x AS p FROM d, fit WHERE b >= 80)
SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
       round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2
FROM t""")
def q21_regression_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-9, ML-11, ML-12: fit on a key-bucket split, RMSE and R² on the rest."""
    data = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    train, test = bucket_split(data, split_bucket(), 80)
    model = Pipeline(stages=[assemble(["l_quantity"]),
                             linear_regression(label="l_extendedprice")]).fit(train)
    scored = evaluate(model.transform(test), "l_extendedprice")
    return scored.select(F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@register("q22_regression_recipe", """
SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_type), 4) AS prediction
FROM part""")
def q22_regression_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2/3/9/10: indexer + one-hot + assembler + regression as one pipeline.

    On one-hot features alone the least-squares fit is the per-category mean,
    which gives the oracle.
    """
    part = load(spark, sf_dir, "part")
    pipe = Pipeline(stages=categorical(["p_type"], drop_last=True)
                    + [assemble(["p_type_dummies"]), linear_regression(label="p_retailprice")])
    return pipe.fit(part).transform(part).select(
        "p_partkey", F.round("prediction", 4).alias("prediction"))


@register("q22c_regression_covariate", """
WITH g AS (
  SELECT p_partkey, p_size AS x, p_retailprice AS y,
         avg(p_size) OVER (PARTITION BY p_type) AS mx,
         avg(p_retailprice) OVER (PARTITION BY p_type) AS my
  FROM part),
b AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS slope FROM g)
SELECT p_partkey, round(my + b.slope * (x - mx), 4) AS prediction FROM g, b""")
def q22c_regression_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-2/3/9/10: one-hot category plus a numeric covariate in one pipeline.

    Least squares with a full set of category dummies and one covariate has a
    closed form (one common within-category slope), which gives the oracle.
    """
    part = load(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    pipe = Pipeline(stages=categorical(["p_type"], drop_last=True)
                    + [assemble(["p_type_dummies", "p_size"]),
                       linear_regression(label="p_retailprice")])
    return pipe.fit(part).transform(part).select(
        "p_partkey", F.round("prediction", 4).alias("prediction"))


SPLIT_KEYS = ["Year", "Country", "Item"]
M1_NUMERIC = ["Temperature"]


def sql_bucket(keys: list[str]) -> str:
    """``ml.digest_bucket`` in SQL."""
    parts = ", ".join(f"""coalesce(octet_length(encode(CAST("{k}" AS VARCHAR))) || ':' || CAST("{k}" AS VARCHAR), '-')""" for k in keys)
    return f"(CAST('0x' || substr(md5(concat({parts})), 1, 8) AS BIGINT) % 100)"


def _sql_recipe(features: str, source: str, numeric: list[str]) -> str:
    """Metrics of a least-squares fit on the buckets below 80, over the other rows."""
    return ("WITH RECURSIVE" + features + f",\nhalf AS (SELECT *, {sql_bucket(SPLIT_KEYS)} AS bucket FROM {source}),\n"
            "fit_rows AS (SELECT * FROM half WHERE bucket < 80),\ntest_rows AS (SELECT * FROM half WHERE bucket >= 80),\n"
            + _sql_least_squares("fit_rows", numeric) + ",\np AS (" + _sql_scored("test_rows", numeric) + """)
SELECT round(sqrt(avg((CAST("Yield" AS DOUBLE) - prediction) ** 2)), 2) AS rmse,
       round(1 - sum((CAST("Yield" AS DOUBLE) - prediction) ** 2) / (count(prediction) * var_pop(CASE WHEN prediction IS NOT NULL THEN "Yield" END)), 6) AS r2,
       count(*) AS given, CAST(0 AS BIGINT) AS skipped_null, count(*) - count(prediction) AS skipped_unseen
FROM p""")


def _recipe_metrics(spark: SparkSession, sf_dir: str, name: str, version: int) -> DataFrame:
    out = regression(star_features(spark, sf_dir, version=version), name, key_cols=SPLIT_KEYS)
    return out.withColumns({"rmse": F.round("rmse", 2), "r2": F.round("r2", 6)})


@register("q22b_recipe_m1", _sql_recipe(SQL_FEATURES, "features", M1_NUMERIC))
def q22b_recipe_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-13, ML-11/12/13 (recipe m1): RMSE and R² on held-out rows, with the rows given and skipped."""
    return _recipe_metrics(spark, sf_dir, "m1", 1)


@register("q22d_recipe_m2", _sql_recipe(SQL_FEATURES_V2, "features_v2", PCA_V2_INPUTS))
def q22d_recipe_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-13, ML-4/5/13 (recipe m2) on the v2 features: full dummy sets and all five measures."""
    return _recipe_metrics(spark, sf_dir, "m2", 2)


@register("q22e_recipe_m3")
def q22e_recipe_m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-13, ML-6/7/13 (recipe m3): regression on PCA(2) of the standardised
    features plus the dummies. Tested against numpy."""
    return _recipe_metrics(spark, sf_dir, "m3", 2)


def _sql_scored_table(features: str, source: str, numeric: list[str]) -> str:
    return ("WITH RECURSIVE" + features + ",\n" + _sql_least_squares(source, numeric) + ",\np AS (" + _sql_scored(source, numeric)
            + """)\nSELECT "Year", "Country", "Item", "Temperature", "Yield", round(prediction, 1) + CAST(0 AS DOUBLE) AS prediction FROM p""")


@register("q33_scored_m1", _sql_scored_table(SQL_FEATURES, "features", M1_NUMERIC))
def q33_scored_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-13, ML-10: the scored table of recipe m1, fitted on all rows."""
    scored, _ = scored_table(star_features(spark, sf_dir), "m1")
    return scored.withColumn("prediction", F.round("prediction", 1))


@register("q33b_scored_m2", _sql_scored_table(SQL_FEATURES_V2, "features_v2", PCA_V2_INPUTS))
def q33b_scored_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-13, ML-10: the scored table of recipe m2 on the v2 features."""
    scored, _ = scored_table(star_features(spark, sf_dir, version=2), "m2")
    return scored.withColumn("prediction", F.round("prediction", 1))


def _sql_model_reused() -> str:
    return ("WITH RECURSIVE" + SQL_FEATURES + f",\nhalf AS (SELECT *, {sql_bucket(SPLIT_KEYS)} AS bucket FROM features),\n"
            "fit_rows AS (SELECT * FROM half WHERE bucket < 80),\ntest_rows AS (SELECT * FROM half WHERE bucket >= 80),\n"
            + _sql_least_squares("fit_rows", M1_NUMERIC) + ",\np AS (" + _sql_scored("test_rows", M1_NUMERIC) + """)
SELECT "Year", "Country", "Item", "Temperature", "Yield", round(prediction, 1) + CAST(0 AS DOUBLE) AS prediction
FROM p WHERE prediction IS NOT NULL""")


@register("q22f_model_reused", _sql_model_reused())
def q22f_model_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-10: recipe m1 as one fitted pipeline, stored, loaded and applied to other rows."""
    checkpoint_dir(spark)
    features = star_features(spark, sf_dir).checkpoint()  # read by several fit passes
    train, test = bucket_split(features, digest_bucket(*SPLIT_KEYS), 80)
    model = recipe("m1").fit(train)
    version = models.save(train, model, "order-features-m1", ["Country", "Item", "Temperature"])
    scored = models.load(spark, "order-features-m1", version).score(test)
    return scored.select(*SCORED[:-1], F.round("prediction", 1).alias("prediction"))


# --- Q23..Q29: exploration, filters, lookups, catalog, landed files ---------------------

@register("q23_value_counts", 'SELECT p_type, count(*) AS "count" FROM part GROUP BY p_type')
def q23_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, AGG-2: rows per label."""
    return value_counts(load(spark, sf_dir, "part"), "p_type")


@register("q24_series", "WITH" + SQL_FACTS + """,
s AS (SELECT * FROM long WHERE n_name = 'NATION_1' AND c_mktsegment = 'BUILDING')
SELECT s.n_name, s.c_mktsegment, s."Year", s."Yield", m."min_Yield", m."max_Yield"
FROM s JOIN (SELECT n_name, c_mktsegment, min("Yield") AS "min_Yield",
                    max("Yield") AS "max_Yield" FROM s GROUP BY 1, 2) m
  ON m.n_name = s.n_name AND m.c_mktsegment = s.c_mktsegment""")
def q24_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3, FLT-7, PRJ-1, ORD-1, AGG-9: one country-item series with its range."""
    series = members(q01_unpivot_years(spark, sf_dir),
                     "n_name = 'NATION_1' AND c_mktsegment = 'BUILDING'",
                     ["n_name", "c_mktsegment", "Year", "Yield"])
    return with_series_range(series, "Yield", ["n_name", "c_mktsegment"]).orderBy("Year")


@register("q25_not_contains", """
SELECT p_partkey, p_name, p_size, p_retailprice FROM part
WHERE NOT contains(p_name, 'red') AND p_size BETWEEN 10 AND 40
  AND p_retailprice > 950 AND p_brand IS NOT NULL""")
def q25_not_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, FLT-4, FLT-5, FLT-6, FN-8: pushed-down scan filters."""
    part = load(spark, sf_dir, "part")
    return (part.where(not_contains("p_name", "red") & F.col("p_size").between(10, 40)
                       & (F.col("p_retailprice") > 950) & F.col("p_brand").isNotNull())
                .select("p_partkey", "p_name", "p_size", "p_retailprice"))


def _sql_values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")"
                     for r in rows)


@register("q26_lookup_decode", f"""
SELECT o.o_orderkey, o.o_orderstatus, f.text AS status_text
FROM orders o LEFT JOIN (VALUES {_sql_values(FLAG_VALUES)}) f(code, text)
  ON f.code = o.o_orderstatus""")
def q26_lookup_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, SRC-8, JON-2: decode status codes with the flag lookup (11 rows, broadcast)."""
    flags = F.broadcast(lookup_from_values(spark, FLAG_VALUES))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return (orders.join(flags, F.col("o_orderstatus") == F.col("Flag"), "left")
                  .select("o_orderkey", "o_orderstatus", F.col("Flags").alias("status_text")))


@register("q27_table_roundtrip", "SELECT * FROM nation")
def q27_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAT-1, CAT-2, SNK-1, SRC-6: create a database, save a table, read it back."""
    db = "cropstats_roundtrip"
    ensure_database(spark, db, f"{checkpoint_dir(spark).rstrip('/')}/warehouse/{db}")
    if db not in databases(spark):
        raise RuntimeError(f"database {db} not listed")
    name = f"{db}.nation_{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"  # one table per source
    save_table(load(spark, sf_dir, "nation"), name, fmt="parquet")
    return table(spark, name)


MESSY_NAMES = {"p_partkey": "Part Key (ID)", "p_name": "Part Name", "p_brand": "Part Brand",
               "p_type": "Part Type", "p_size": "Part Size", "p_retailprice": "Retail Price (USD)"}


@register("q28_clean_names", "SELECT " + ", ".join(
    f'{k} AS "{clean_name(v)}"' for k, v in MESSY_NAMES.items()) + " FROM part")
def q28_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3, PRJ-4: rename several columns, then strip spaces and parentheses."""
    return clean_names(rename(load(spark, sf_dir, "part"), MESSY_NAMES))


def daily_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the daily weather schema: whole cents as temperatures and precipitation, the other readings missing."""
    v, none = whole_cents("value"), F.lit(None)
    return load(spark, sf_dir, "events").select(
        F.to_date("ts").alias("Date"), v.alias("AverageTemperature"),
        v.alias("MinimumTemperature"), v.alias("MaximumTemperature"),
        v.alias("Precipitation"), none.cast("double").alias("SnowDepth"),
        none.cast("int").alias("WindDirection"), none.cast("double").alias("WindSpeed"),
        none.cast("double").alias("PeakWindGust"),
        none.cast("double").alias("SeaLevelPressure"),
        none.cast("double").alias("SunshineDuration"), "user_id")


def land_station_files(spark: SparkSession, sf_dir: str) -> str:
    """Land events as headerless gzip CSV, one folder per station (once per source).

    Every user is a station, so the number of files grows with the users, as
    that of the reference's files grows with its stations. Returns the landing
    folder (files under ``daily/``).
    """
    with LANDING_LOCK:
        base, done = landed_path(spark, "user-station-daily", sf_dir, ["events"])
        if not done:
            daily = daily_readings(spark, sf_dir).withColumnRenamed("user_id", "station")
            land_csv(daily, f"{base}/daily", "station", header=False, compression="gzip")
            mark_landed(spark, base)
    return base


SQL_STATION_YEAR = f"""
SELECT CAST(user_id AS VARCHAR) AS "StationId", CAST(year(ts) AS INTEGER) AS "Year",
       AVG({SQL_CENTS}) AS "AverageTemperature",
       CAST(min({SQL_CENTS}) AS DOUBLE) AS "MinimumTemperature", CAST(max({SQL_CENTS}) AS DOUBLE) AS "MaximumTemperature",
       CAST(SUM({SQL_CENTS}) AS DOUBLE) AS "Precipitation",
       CAST(NULL AS DOUBLE) AS "SnowDepth", CAST(NULL AS DOUBLE) AS "WindSpeed",
       CAST(NULL AS DOUBLE) AS "PeakWindGust", CAST(NULL AS DOUBLE) AS "SeaLevelPressure",
       CAST(0 AS BIGINT) AS "SunshineDuration"
FROM events GROUP BY 1, 2"""


@register("q29_station_files", SQL_STATION_YEAR)
def q29_station_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3, AGG-4, FN-10, UDF-1 replacement: per-station gzip CSVs → station-year figures.

    Events are landed once per source folder by ``land_station_files``; the
    query reads them in one scan with the station id taken from the path.
    """
    base = land_station_files(spark, sf_dir)
    readings = read_station_daily(spark, f"{base}/daily", id_regex=r"station=([^/]+)/")
    return station_year(readings, "StationId", "Date", first_year=None, last_year=None)


# --- Q30/Q31: the weather job chain and the sheet-export reader on driver tables ------

@register("q30_weather_job", f"""
WITH st AS (
  SELECT user_id, CAST(year(ts) AS INTEGER) AS "Year", AVG({SQL_CENTS}) AS m, min({SQL_CENTS}) AS mn, max({SQL_CENTS}) AS mx,
         CAST(COALESCE(SUM({SQL_CENTS}), 0) AS DOUBLE) AS tc
  FROM events WHERE year(ts) BETWEEN 1960 AND 2100 GROUP BY 1, 2)
SELECT "Year", 'N' || c_nationkey AS "ISO2", n_name AS "Country", {sql_round("avg(m)", 2)} AS "AverageTemperature",
       CAST(min(mn) AS DOUBLE) AS "MinimumTemperature", CAST(max(mx) AS DOUBLE) AS "MaximumTemperature", sum(tc) AS "Precipitation",
       CAST(NULL AS DOUBLE) AS "SnowDepth", CAST(NULL AS DOUBLE) AS "WindSpeed", CAST(NULL AS DOUBLE) AS "PeakWindGust",
       CAST(NULL AS DOUBLE) AS "SeaLevelPressure", CAST(0 AS BIGINT) AS "SunshineDuration"
FROM st JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey
WHERE c_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
GROUP BY 1, 2, 3""")
def q30_weather_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-9 by ``country_weather``: FLT-8/AGG-7 → JON-2 → readings of wanted stations → AGG-4 → AGG-3/5.

    Customers stand for stations (id = custkey, country = nation), events for
    the daily readings of the station with the same id, nations with yield facts
    (finished orders) for the countries.
    """
    iso2 = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    stations = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), iso2("c_nationkey").alias("country"))
    daily = daily_readings(spark, sf_dir).withColumn("StationId", F.col("user_id").cast("string"))
    codes = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ISONum"), iso2("n_nationkey").alias("ISO2"),
                                                 F.col("n_name").alias("CountryCommon"))
    facts = crop_yield(spark, sf_dir).where("Element = 'F'")
    return country_weather(stations, daily, codes, facts, 1960, 2100)


SHEETS = 8


@register("q31_sheet_export", f"""
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier
UNION ALL
SELECT CAST(NULL AS BIGINT), 'Total, sheet ' || (s_suppkey % {SHEETS}), CAST(count(*) AS DOUBLE)
FROM supplier GROUP BY s_suppkey % {SHEETS}""")
def q31_sheet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: tables saved as sheets — title lines, a header below them, rows, and
    a total with a blank key — read back whole by header name."""
    with LANDING_LOCK:
        base, done = landed_path(spark, "supplier-sheets", sf_dir, ["supplier"])
        if not done:
            sheet = F.pmod(F.col("s_suppkey"), F.lit(SHEETS)).alias("sheet")
            supp = load(spark, sf_dir, "supplier")
            rows = supp.select(sheet, F.lit(1).alias("part"), F.col("s_suppkey").alias("at"),
                               F.to_csv(F.struct("s_suppkey", "s_name", "s_nationkey", "s_acctbal")).alias("line"))
            totals = supp.groupBy(sheet).count().select(
                "sheet", F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"),
                F.concat(F.lit(',"Total, sheet '), "sheet", F.lit('",,'), "count").alias("line"))
            heads = totals.select("sheet", F.lit(0).alias("part"),
                                  F.posexplode(F.array(F.lit("Supplier sheet export,,,"), F.lit(",,,"),
                                                       F.lit("S_SuppKey,s_name,s_nationkey,s_acctbal"))).alias("at", "line"))
            (rows.unionByName(totals).unionByName(heads).repartition("sheet")
             .sortWithinPartitions("sheet", "part", "at").select("sheet", "line")
             .write.mode("overwrite").partitionBy("sheet").text(f"{base}/sheets"))
            mark_landed(spark, base)
    return read_sheet_export(spark, f"{base}/sheets/*", {"s_suppkey": "bigint", "s_name": "string", "s_acctbal": "double"},
                             key_col="s_suppkey")


@register("q32_stream_ingest", SQL_STATION_YEAR)
def q32_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3 streaming form: landed station files ingested exactly once, then AGG-4.

    A file-source stream with a checkpoint appends every landed file to a
    parquet table (``trigger(availableNow=True)``); a second run finds no new
    files and adds nothing. Station-year figures are then computed from the
    ingested table, equal to reading the files directly (q29).
    """
    base = land_station_files(spark, sf_dir)
    target, ckpt = f"{base}/ingested", f"{base}/ingest_checkpoint"
    with LANDING_LOCK:  # one run at a time per checkpoint location
        ingest_station_files(spark, f"{base}/daily", target, ckpt,
                             id_regex=r"station=([^/]+)/").awaitTermination()
    return station_year(spark.read.parquet(target), "StationId", "Date", first_year=None, last_year=None)
