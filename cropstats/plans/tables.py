"""Loading the driver's star-schema tables and the shared analogue inputs.

The crop jobs (``plans.jobs``) run on the reference's own inputs; the driver
only ships a TPC-H-like star schema, so each reference role gets a stand-in
(see FIXTURES.md §3):

- production file (wide, years as columns)  → order totals per nation × segment
- yield facts (country × item × element × year) → order totals per nation × segment × status × year
- country-code hub                           → nation
- temperature readings per country and year  → units shipped per supplier and year
- share of GDP                               → mean extended price per supplier nation and year
- corruption index, population               → urgent, finished and open orders per nation and year
- stations and daily readings                → users (per event type) and events
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cropstats.operators.features import build_features, mean_temperature
from cropstats.operators.joins import Dim, star_join
from cropstats.operators.reshape import pivot_years, unpivot_years
from cropstats.session import checkpoint_dir


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cents(c: str):
    """A two-decimal amount as exact integer cents.

    ``rint(x · 100)`` is exact for |x| < 10^10 (the product is within 1e-6 of
    an integer), and long sums are exact, so totals do not depend on the order
    partial sums are combined in. Cheaper than a per-row decimal cast, which
    goes through a BigDecimal for every row.
    """
    return F.rint(F.col(c) * 100).cast("long")


def money(c: str):
    """Exact sum of a two-decimal money column, back as the nearest double."""
    return F.sum(cents(c)).cast("double") / F.lit(100.0)


def yearly_order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts (c_nationkey, c_mktsegment, yr, v, f, n): what the wide table is pivoted from.

    v = order total, f = highest status (flag), n = highest priority (note),
    both as whole strings. The first aggregate keeps status and priority as
    keys, so it is a hash aggregate with fixed-width buffers; ``max`` of a
    string, which sorts, only sees its few rows per group. The per-year
    aggregate runs before anything is joined to nation.
    """
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
        F.year("o_orderdate").alias("yr"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
                  .groupBy("c_nationkey", "c_mktsegment", "yr", "o_orderstatus", "o_orderpriority")
                  .agg(F.sum(cents("o_totalprice")).alias("cents"))
                  .groupBy("c_nationkey", "c_mktsegment", "yr")
                  .agg((F.sum("cents").cast("double") / F.lit(100.0)).alias("v"),
                       F.max("o_orderstatus").alias("f"),
                       F.max("o_orderpriority").alias("n")))


def yearly_orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table in the production-file layout: keys + Y<yr>, Y<yr>F, Y<yr>N.

    A saved table, as the production file is: pivoted and written once per
    source, then read. The distinct years (a bounded set) are observed while
    the facts are written, so the pivot needs no job to find them.
    """
    with LANDING_LOCK:
        base, done = landed_path(spark, "orders-wide", sf_dir, ["orders", "customer", "nation"])
        if not done:
            seen = Observation("fact_years")
            (yearly_order_facts(spark, sf_dir)
             .observe(seen, F.collect_set("yr").alias("years"))
             .write.mode("overwrite").parquet(f"{base}/facts"))
            wide = pivot_years(spark.read.parquet(f"{base}/facts"),
                               ["c_nationkey", "c_mktsegment"], "yr", "v", "f", "n",
                               years=sorted(seen.get.get("years") or []))
            nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
            (wide.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey")
             .write.mode("overwrite").parquet(f"{base}/wide"))
            mark_landed(spark, base)
    return spark.read.parquet(f"{base}/wide")


# --- stand-ins of the catalog tables that ``build_features`` joins ---------------

def nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name")


def crop_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield facts: order totals per nation, segment (item), year and status (element).

    Element and item are grouping keys, so a filter on either reaches the scan.
    """
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("Year"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    totals = (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
                    .groupBy(F.col("c_nationkey").alias("AreaCodeM49"), "Year",
                             F.col("c_mktsegment").alias("Item"),
                             F.col("o_orderstatus").alias("Element"))
                    .agg(money("o_totalprice").alias("Yield")))
    names = nation_names(spark, sf_dir)
    return (totals.join(names, F.col("AreaCodeM49") == F.col("n_nationkey"))
                  .select("AreaCodeM49", "Year", F.col("n_name").alias("Country"), "Item",
                          "Element", F.lit("USD").alias("Unit"), "Yield"))


def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hub: nation key → nation name, in place of M49 code → ISO3."""
    return nation_names(spark, sf_dir).select(F.col("n_nationkey").alias("ISONum"),
                                              F.col("n_name").alias("ISO3"))


def surface_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text, several per country and year: units shipped per supplier and year.

    Quantities are whole numbers, so their sums and means are the same in any order.
    """
    shipped = (load(spark, sf_dir, "lineitem")
               .groupBy("l_suppkey", F.year("l_shipdate").alias("Year"))
               .agg(F.sum("l_quantity").alias("units")))
    supp = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (shipped.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
                   .join(nation_names(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
                   .select(F.col("n_name").alias("Country"), "Year", F.col("n_name").alias("ISO3"),
                           F.col("units").cast("string").alias("Temperature")))


def gdp_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Code, Year, GDP): mean extended price per supplier nation and ship year."""
    means = supplier_nation_means(spark, sf_dir, {"GDP": "l_extendedprice"})
    return (means.join(nation_names(spark, sf_dir), F.col("nationkey") == F.col("n_nationkey"))
                 .select(F.col("n_name").alias("Code"), "Year", "GDP"))


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation and year: all, urgent, finished, open."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("Year"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    one = lambda cond: F.count(F.when(cond, 1))
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
                  .groupBy("c_nationkey", "Year")
                  .agg(one(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
                       one(F.col("o_orderstatus") == "F").alias("finished"),
                       one(F.col("o_orderstatus") == "O").alias("open"))
                  .join(nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")))


def corruption_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ISO, Year, CPI): urgent orders, NULL where there are none."""
    return orders_by_nation(spark, sf_dir).select(
        F.col("n_name").alias("ISO"), "Year", F.nullif("urgent", F.lit(0)).alias("CPI"))


def urban_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Code, Year, UrbanPopulation, RuralPopulation): finished and open orders."""
    return orders_by_nation(spark, sf_dir).select(
        F.col("n_name").alias("Code"), "Year", F.col("finished").alias("UrbanPopulation"),
        F.col("open").alias("RuralPopulation"))


def star_features(spark: SparkSession, sf_dir: str, version: int = 1,
                  element: str = "F") -> DataFrame:
    """JOB-10 (``version=1``) or JOB-11 (``version=2``) on the stand-ins, by the shipped builder."""
    temperature = mean_temperature(surface_temperature(spark, sf_dir))
    more = ([corruption_index(spark, sf_dir), gdp_share(spark, sf_dir),
             urban_population(spark, sf_dir)] if version == 2 else [])
    return build_features(crop_yield(spark, sf_dir), country_codes(spark, sf_dir), temperature,
                          *more, element=element)


def account_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Code, AcctBal): mean account balance per customer nation."""
    means = (load(spark, sf_dir, "customer").groupBy("c_nationkey")
             .agg((money("c_acctbal") / F.count("c_acctbal")).alias("AcctBal")))
    return (means.join(nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
                 .select(F.col("n_name").alias("Code"), "AcctBal"))


def long_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield facts of all orders, from the saved wide table: every item of a nation in every year."""
    keys = ["n_nationkey", "n_name", "c_mktsegment"]
    return unpivot_years(yearly_orders_wide(spark, sf_dir), id_cols=keys).select(
        F.col("n_nationkey").alias("AreaCodeM49"), "Year", F.col("n_name").alias("Country"),
        F.col("c_mktsegment").alias("Item"), F.lit(None).cast("string").alias("Element"),
        F.lit("USD").alias("Unit"), "Yield")


def whole_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOB-10 over the orders of every status, beside those of one element.

    Every item of a nation has a row for every year, with yield 0 where nothing
    was ordered. ``ElementYield`` is what ``star_features`` gives, NULL where it
    has no row.
    """
    temperature = mean_temperature(surface_temperature(spark, sf_dir))
    rows = build_features(long_yield(spark, sf_dir), country_codes(spark, sf_dir), temperature,
                          element=None).drop("Element")
    region = load(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("Region"))
    finished = star_features(spark, sf_dir).select(
        "Country", "Item", "Year", "Element", F.col("Yield").alias("ElementYield"))
    return star_join(rows, [
        Dim(region, {"Country": "n_name"}, ["Region"]),
        Dim(gdp_share(spark, sf_dir).withColumn("GDP", F.round("GDP", 2)),
            {"Country": "Code", "Year": "Year"}, ["GDP"]),
        Dim(account_balance(spark, sf_dir), {"Country": "Code"}, ["AcctBal"]),
        Dim(finished, {"Country": "Country", "Item": "Item", "Year": "Year"},
            ["Element", "ElementYield"], how="left")])


def supplier_nation_means(spark: SparkSession, sf_dir: str,
                          measures: dict[str, str]) -> DataFrame:
    """Means of lineitem measures per (supplier nation, ship year): (nationkey, Year, …).

    ``measures`` maps output name → lineitem column (two-decimal values).
    Pre-aggregates lineitem per (supplier, year) — exact cent sums and counts —
    before the supplier join, so the join and the final shuffle see
    suppliers × years rows, not lineitems; a hot supplier collapses on the map
    side. All measures come from the same single pass.
    """
    per_supp = (load(spark, sf_dir, "lineitem")
                .groupBy("l_suppkey", F.year("l_shipdate").alias("Year"))
                .agg(*[F.sum(cents(c)).alias(f"s_{o}") for o, c in measures.items()],
                     *[F.count(c).alias(f"c_{o}") for o, c in measures.items()]))
    supp = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (per_supp.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
                    .groupBy(F.col("s_nationkey").alias("nationkey"), "Year")
                    .agg(*[(F.sum(f"s_{o}").cast("double") / F.lit(100.0) / F.sum(f"c_{o}"))
                           .alias(o) for o in measures]))



# Landing checks and writes are serialised within a process, so two queries
# run from different threads never land the same folder at the same time.
LANDING_LOCK = threading.RLock()


def landed_path(spark: SparkSession, name: str, source: str,
                names: Sequence[str]) -> tuple[str, bool]:
    """Folder for files landed from tables ``names`` of ``source``, and whether they are complete.

    Landed inputs live below the shared checkpoint folder under a name
    derived from the source's files (path, time, length: a refreshed source
    lands anew), so repeated reads of the same source reuse them. The files are
    counted and hashed in Spark; one row reaches the driver. Completeness is a
    marker written after the last file.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load([f"{source.rstrip('/')}/{n}.parquet" for n in names]))
    state = files.agg(F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length")
                                          .cast("decimal(20,0)"))).first()
    digest = hashlib.sha1(f"{name}|{source}|{state[0]}|{state[1]}".encode()).hexdigest()[:16]
    path = f"{checkpoint_dir(spark).rstrip('/')}/landed/{name}-{digest}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_landed_marker")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path, fs.exists(marker)


def mark_landed(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([("done",)], "value string").coalesce(1).write \
        .mode("overwrite").text(f"{path}/_landed_marker")


def land_csv(df: DataFrame, path: str, partition_col: str, header: bool = True,
             compression: str | None = None) -> None:
    """Write ``df`` as CSV, one folder per value of ``partition_col``.

    Used to land inputs in the layout the file readers expect (one file
    group per year or per station). The ``rebalance`` hint clusters rows by
    the partition column and lets AQE split any partition above the advisory
    size, so a value holding a third of all rows is written by many tasks
    (many files), not one, while small values are packed together. The split
    follows the map outputs, so a retried task rewrites exactly the same rows.
    Tasks move their own files to their place: else the driver moves the folder
    of every station, one after another. Readers wait for ``mark_landed``.
    """
    writer = (df.hint("rebalance", partition_col).write.mode("overwrite")
              .partitionBy(partition_col).option("header", header)
              .option("mapreduce.fileoutputcommitter.algorithm.version", "2"))
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
