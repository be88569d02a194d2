"""The application's jobs on its own inputs (JOB-1..JOB-16).

Loaders (JOB-1..JOB-9) read landed files with explicit schemas, clean them
and write one catalog table each; analysis jobs (JOB-10..JOB-16) read the
tables and return DataFrames. Database name and table format are
parameters; every write is ``overwrite``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cropstats import schemas
from cropstats.functions.clean import (
    clean_names,
    map_other_columns,
    rename,
    round_to,
    scale_truncate,
    strip_and_cast,
    truncate_int,
    year_range,
)
from cropstats.operators import explore, features, linear, ml, stats, weather
from cropstats.operators.joins import filter_to_keys, keys_present_in
from cropstats.operators.reshape import add_row_id, explode_measures, unpivot_years
from cropstats.session import checkpoint_dir
from cropstats.sources import catalog, files

DATABASE = "cropstats_db"

PRODUCTION_IDS = ["Area Code", "Area Code (M49)", "Area", "Item Code", "Item",
                  "Element Code", "Element", "Unit"]

# Columns of the inputs that are dropped or read by name.
RELIGION_HELPERS = ["row_number", "level", "Nation_fk", "Region"]
WORLD_TOTAL = "All Countries"
SHEET_COUNTRY, SHEET_CODE, SHEET_SCORE = "Country / Territory", "ISO3", "CPI Score "
SECOND_TEMPERATURE = "Average surface temperature5"
CPC_CODE, AREA_CODE = "Item Code (CPC)", "Area Code (M49)"

# The religion columns kept, renamed to singular names.
RELIGIONS = {
    "Christians": "Christian",
    "Muslims": "Muslim",
    "Hindus": "Hindu",
    "Buddhists": "Buddhist",
    "Jews": "Jewish",
    "Folk Religions": "Folk",
    "Other Religions": "Other",
}


def _name(database: str, table: str) -> str:
    return f"{database}.{table}"


def _saved(df: DataFrame, database: str, table: str, fmt: str, **layout) -> DataFrame:
    """``df`` written as a catalog table with statistics; the table, so nothing reads the input again."""
    name = _name(database, table)
    catalog.save_table(df, name, fmt, **layout)
    catalog.analyze_table(df.sparkSession, name)
    return catalog.table(df.sparkSession, name)


# --- loaders ----------------------------------------------------------------------

def production_long(raw: DataFrame, keep_cpc: bool = False, row_id: bool = False,
                    strict_join: bool = False) -> DataFrame:
    """Wide production statistics → long crop-yield rows (JOB-1 / JOB-1b transform).

    Drops the CPC item code (PRJ-2; unless ``keep_cpc``), turns ``'004`` into 4,
    unpivots value / flag / note per year in one pass, cleans the names and
    calls the area ``Country``.
    """
    df = raw if keep_cpc else raw.drop(CPC_CODE)
    if not keep_cpc:
        df = df.withColumn(AREA_CODE, strip_and_cast(AREA_CODE, "[']", "int"))
    ids = PRODUCTION_IDS + ([CPC_CODE] if keep_cpc else [])
    ids = [c for c in df.columns if c in ids]
    if row_id:
        df = add_row_id(df)
        ids = ["Id"] + ids
    long = unpivot_years(df, id_cols=ids, strict_join=strict_join)
    return rename(clean_names(long), schemas.RENAMES["production"])


def read_production(spark: SparkSession, path: str) -> DataFrame:
    """Wide production file: every cell as text, bound by header name.

    The year columns are whatever the header lists (no inference pass, no
    positional schema); key columns get their types here, year cells are
    typed per column class by the unpivot (K5, K6).
    """
    raw = files.read_delimited(spark, path, infer=False)
    key_types = {f.name: f.dataType for f in schemas.PRODUCTION_KEYS.fields}
    return raw.select(*[F.col(f"`{c}`").try_cast(key_types[c]).alias(c) if c in key_types
                        else F.col(f"`{c}`") for c in raw.columns])


def load_production(spark: SparkSession, path: str, database: str = DATABASE,
                    fmt: str = "parquet", buckets: int | None = None,
                    years: Sequence[int] | None = None, **kw) -> DataFrame:
    """JOB-1: production statistics → ``crop_yield``.

    With ``buckets`` the table is laid out by year and, inside, by the area
    code of the hub join, so a join with a hub of as many buckets shuffles
    neither side. With ``years`` only those years are written again; the table's
    other years stay.
    """
    out = production_long(read_production(spark, path), **kw)
    table = schemas.TABLES["crop_yield"]
    keys = (buckets, ["AreaCodeM49"]) if buckets else None
    if years is not None:
        catalog.replace_partitions(out.where(F.col("Year").isin([int(y) for y in years])),
                                   _name(database, table), fmt, ["Year"], keys)
        catalog.analyze_table(spark, _name(database, table))
        return catalog.table(spark, _name(database, table))
    if not buckets:
        return _saved(out, database, table, fmt)
    return _saved(out, database, table, fmt, partition_by=["Year"], bucket_by=keys, sort_by=keys[1])


def load_urban_population(spark: SparkSession, path: str, database: str = DATABASE,
                          fmt: str = "parquet") -> DataFrame:
    """JOB-2: urban / rural population → ``urban_population``."""
    df = rename(files.read_delimited(spark, path, schemas.URBAN_POPULATION),
                schemas.RENAMES["urban_population"])
    return _saved(df, database, schemas.TABLES["urban_population"], fmt)


def load_gdp_share(spark: SparkSession, path: str, database: str = DATABASE,
                   fmt: str = "parquet") -> DataFrame:
    """JOB-3: agriculture share of GDP → ``share_of_gdp``."""
    df = rename(files.read_delimited(spark, path, schemas.GDP_SHARE),
                schemas.RENAMES["share_of_gdp"])
    return _saved(df, database, schemas.TABLES["share_of_gdp"], fmt)


def religion_long(sheet: DataFrame) -> DataFrame:
    """JOB-4 transform: drop helper columns, drop the world total (and NULL
    countries, K15), numbers out of text such as ``< 10,000``, one row per
    religion with the total population kept."""
    df = sheet.drop(*RELIGION_HELPERS)
    df = df.where(~F.col("Country").contains(WORLD_TOTAL))
    df = map_other_columns(df, ["Year", "Country"],
                           lambda c: strip_and_cast(c, "[<, ]", "bigint"))
    df = df.withColumn("Year", F.col("Year").try_cast("int"))
    df = rename(df, {**RELIGIONS, **schemas.RENAMES["religion_total"]})
    long = explode_measures(df, ["Year", "Country", "Population"], list(RELIGIONS.values()),
                            name_col="Religion", value_col="Followers")
    return long.select("Year", "Country", "Religion", "Followers", "Population")


def load_religion(spark: SparkSession, path: str, database: str = DATABASE,
                  fmt: str = "parquet") -> DataFrame:
    """JOB-4: religious composition (sheet exported as CSV) → ``religious_composition``."""
    sheet = files.read_delimited(spark, path, infer=False)  # text, bound by header name
    out = religion_long(sheet)
    return _saved(out, database, schemas.TABLES["religious_composition"], fmt)


def corruption_index(spark: SparkSession, yearly_path: str | Sequence[str], sheet_path: str,
                     first_sheet_year: int = 2012, last_sheet_year: int = 2022) -> DataFrame:
    """JOB-5 transform: two eras of the corruption index on one 0–100 scale.

    Era 1: one CSV per year (0–10 scale, columns selected by name whatever
    their order), year from the file name, score × 10 truncated (K7).
    Era 2: one sheet export with a ``CPI Score <year>`` column per year,
    unpivoted with integer year labels. NaN and empty scores are NULL (K4).
    """
    era1 = files.read_yearly_files(spark, yearly_path, schemas.CPI_COLUMNS,
                                   r"CPI-(\d{4})\.csv", year_col="Year")
    era1 = rename(era1.withColumn("score", scale_truncate("score", 10)),
                  schemas.RENAMES["cpi_yearly"]).select("Country", "ISO", "CPI", "Year")
    years = range(first_sheet_year, last_sheet_year + 1)
    score_cols = {f"{SHEET_SCORE}{y}": "double" for y in years}
    sheet = files.read_sheet_export(
        spark, sheet_path, {SHEET_COUNTRY: "string", SHEET_CODE: "string", **score_cols},
        key_col=SHEET_CODE, key_regex="^[A-Z]{3}$")
    sheet = sheet.select(SHEET_COUNTRY, SHEET_CODE,
                         *[truncate_int(c).alias(c) for c in score_cols])
    era2 = explode_measures(sheet, [SHEET_COUNTRY, SHEET_CODE],
                            {y: f"{SHEET_SCORE}{y}" for y in years},
                            name_col="Year", value_col="CPI", name_type="int")
    era2 = rename(era2, schemas.RENAMES["cpi_sheet"]).select("Country", "ISO", "CPI", "Year")
    return era1.unionByName(era2)


def load_corruption(spark: SparkSession, yearly_path: str | Sequence[str], sheet_path: str,
                    database: str = DATABASE, fmt: str = "parquet") -> DataFrame:
    """JOB-5 → ``corruption_index``."""
    out = corruption_index(spark, yearly_path, sheet_path)
    return _saved(out, database, schemas.TABLES["corruption_index"], fmt)


def emissions(raw: DataFrame, after_year: int = 1960) -> DataFrame:
    """JOB-6 transform: years after ``after_year`` (exclusive, K12), rounded to 6 (K3)."""
    df = year_range(raw, "Year", after_year, None, low_inclusive=False)
    df = rename(df, schemas.RENAMES["emissions"])
    return df.withColumn("Contribution", round_to("Contribution", 6))


def load_emissions(spark: SparkSession, path: str, database: str = DATABASE,
                   fmt: str = "parquet") -> DataFrame:
    """JOB-6 → ``temperature_change_by_greenhouse_emissions``."""
    out = emissions(files.read_delimited(spark, path, schemas.EMISSION_CONTRIBUTION))
    return _saved(out, database, schemas.TABLES["emissions"], fmt)


def surface_temperature(raw: DataFrame, after_year: int = 1960) -> DataFrame:
    """JOB-7 transform: drop the duplicate column (K8), years after 1960, round to 2 (K3)."""
    df = raw.drop(SECOND_TEMPERATURE)
    df = year_range(df, "year", after_year, None, low_inclusive=False)
    df = rename(df, schemas.RENAMES["temperature"])
    return df.withColumn("Temperature", round_to("Temperature", 2))


def load_surface_temperature(spark: SparkSession, path: str, database: str = DATABASE,
                             fmt: str = "parquet") -> DataFrame:
    """JOB-7 → ``average_surface_temperature``."""
    out = surface_temperature(files.read_delimited(spark, path, schemas.SURFACE_TEMPERATURE))
    return _saved(out, database, schemas.TABLES["temperature"], fmt)


def load_country_codes(spark: SparkSession, path: str, database: str = DATABASE,
                       fmt: str = "parquet", buckets: int | None = None) -> DataFrame:
    """JOB-8: country codes hub → ``country_codes``; ``buckets`` as in ``load_production``."""
    df = rename(files.read_delimited(spark, path, schemas.COUNTRY_CODES),
                schemas.RENAMES["country_codes"])
    layout = {"bucket_by": (buckets, ["ISONum"]), "sort_by": ["ISONum"]} if buckets else {}
    return _saved(df, database, schemas.TABLES["country_codes"], fmt, **layout)


def country_weather(stations: DataFrame, daily: DataFrame, country_codes: DataFrame,
                    crop_yield: DataFrame, first_year: int = 1960,
                    last_year: int = 2022) -> DataFrame:
    """JOB-9 transform: station readings → country-year weather.

    Countries = codes that occur in the yield facts (semi join); stations of
    those countries; readings of those stations; per station-year, then per
    country-year.
    """
    countries = keys_present_in(country_codes, crop_yield, "ISONum", "AreaCodeM49",
                                ["ISO2", "ISONum", "CountryCommon"])
    station_country = weather.stations_with_country(stations, countries)
    # readings of wanted stations only, before they are aggregated
    readings = filter_to_keys(daily, "StationId", station_country, "id")
    per_station = weather.station_year(readings, "StationId", "Date", first_year, last_year)
    return weather.country_year(
        per_station,
        station_country.select("id", "ISO2", F.col("CountryCommon").alias("Country")))


def load_weather(spark: SparkSession, stations_path: str, daily_path: str,
                 database: str = DATABASE, fmt: str = "parquet") -> DataFrame:
    """JOB-9 → ``weather_data``."""
    out = country_weather(files.read_stations(spark, stations_path),
                          files.read_station_daily(spark, daily_path),
                          catalog.table(spark, _name(database, schemas.TABLES["country_codes"])),
                          catalog.table(spark, _name(database, schemas.TABLES["crop_yield"])))
    return _saved(out, database, schemas.TABLES["weather_data"], fmt)


# --- analysis --------------------------------------------------------------------

def feature_table(spark: SparkSession, version: int = 2, database: str = DATABASE,
                  null_yield: str = "zero") -> DataFrame:
    """JOB-10 (``version=1``: temperature) and JOB-11 (``version=2``: all attributes)."""
    t = lambda n: catalog.table(spark, _name(database, n))
    temperature = features.mean_temperature(t("average_surface_temperature"))
    if version == 1:
        return features.build_features(t("crop_yield"), t("country_codes"), temperature,
                                       null_yield=null_yield)
    return features.build_features(t("crop_yield"), t("country_codes"), temperature,
                                   t("corruption_index"), t("share_of_gdp"),
                                   t("urban_population"), null_yield=null_yield)


def series_correlation(feature_df: DataFrame, country: str, item: str, x: str = "Temperature",
                       y: str = "Yield") -> tuple[DataFrame, DataFrame, DataFrame]:
    """JOB-12: one country-item series, the range of both its values, and Pearson r of x and y."""
    series = features.select_series(feature_df, {"Country": country, "Item": item},
                                    ["Year", y, x])
    ranges = series.agg(*[f(c).alias(f"{n}_{c}") for c in (y, x) for n, f in (("min", F.min), ("max", F.max))])
    r = stats.corr_pairs(series, [x, y], include_diagonal=False).where(
        (F.col("var_x") == x) & (F.col("var_y") == y)).select("r")
    return series.orderBy("Year"), ranges, r


def _split(data: DataFrame, train_percent: int, seed: int | None,
           key_cols: Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
    if key_cols:
        return ml.bucket_split(data, ml.digest_bucket(*key_cols), train_percent)
    train, test = ml.split(data, (train_percent / 100, 1 - train_percent / 100), seed)
    return train, test


def regression(feature_df: DataFrame, recipe_name: str = "m2", train_percent: int = 80,
               seed: int | None = 42, key_cols: Sequence[str] | None = None) -> DataFrame:
    """JOB-13: fit a recipe on the training split, RMSE and R² on the rest.

    One row: ``rmse``, ``r2``, and of the held-out rows how many were ``given``,
    ``skipped_null`` and ``skipped_unseen``. With ``key_cols`` the split is a
    hash of those columns (same rows on every run and layout); otherwise
    ``randomSplit`` with ``seed`` (K17). The input is checkpointed first: fit
    and scoring read it, and a partition recomputed after a lost executor is
    read back in the same order, so even ``randomSplit`` assigns it the same
    rows again.
    """
    checkpoint_dir(feature_df.sparkSession)
    data = feature_df.checkpoint(eager=True)
    train, test = _split(data, train_percent, seed, key_cols)
    spark = data.sparkSession
    try:
        model = linear.recipe(train, recipe_name)
    except linear.NoRows:  # nothing to fit on: metrics are undefined
        return spark.createDataFrame([(None, None, test.count(), None, None)],
                                     "rmse double, r2 double, given long, skipped_null long, skipped_unseen long")
    counts = Observation(f"scored_{recipe_name}")
    row = ml.evaluate(model.score(test, counts), "Yield").first()
    seen = counts.get
    return spark.createDataFrame([(row["rmse"], row["r2"], seen["given"], seen["skipped_null"], seen["skipped_unseen"])],
                                 "rmse double, r2 double, given long, skipped_null long, skipped_unseen long")


SCORED = ["Year", "Country", "Item", "Temperature", "Yield", "prediction"]


def scored_table(feature_df: DataFrame, recipe_name: str = "m2", fit_on: DataFrame | None = None,
                 keep: bool = False) -> tuple[DataFrame, Observation]:
    """JOB-13: the features with the prediction of a recipe fitted on them, or on ``fit_on``.

    The second value has the rows ``given``, ``skipped_null`` and
    ``skipped_unseen`` once the first was run. ``keep`` keeps those rows, with a
    NULL prediction.
    """
    counts = Observation(f"scored_{recipe_name}")
    model = linear.recipe(feature_df if fit_on is None else fit_on, recipe_name)
    return model.score(feature_df, counts, keep).select(*SCORED), counts


FEATURE_COLUMNS = ["Yield", "Temperature", "GDP", "CorruptionIndex", "UrbanPopulation",
                   "RuralPopulation"]


def correlation_tables(feature_df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS,
                       digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """JOB-14: all-pairs correlations overall and per (Country, Item), rounded."""
    return (stats.corr_pairs(feature_df, columns, digits=digits),
            stats.corr_pairs(feature_df, columns, by=["Country", "Item"], digits=digits))


PCA_NUMERIC = ["Temperature", "GDP", "CorruptionIndex", "UrbanPopulation", "RuralPopulation"]


def pca_by_country(feature_df: DataFrame, with_categories: bool = True) -> DataFrame:
    """JOB-15: mean PC1/PC2 per country, with or without one-hot country and item."""
    cats = ["Country", "Item"] if with_categories else []
    coordinates, _, _ = linear.components(linear.gram(feature_df, PCA_NUMERIC, cats), 2)
    return (coordinates.score(feature_df).groupBy("Country")
            .agg(F.avg("PC1").alias("PC1"), F.avg("PC2").alias("PC2")))


def explore_production(raw: DataFrame, item: str, area: str,
                       years: Sequence[int] = ()) -> dict[str, DataFrame]:
    """JOB-16: rows per item, areas of one item, elements of one item in one area.

    ``years`` adds those years' value columns (``Y<year>``) to the last.
    """
    it, ar = item.replace("'", "''"), area.replace("'", "''")
    return {
        "item_counts": explore.value_counts(raw, "Item"),
        "areas_of_item": explore.members(raw, f"Item == '{it}'", ["Area"]),
        "elements": explore.members(
            raw, f"Item == '{it}' AND Area == '{ar}'",
            ["Area", "Item", "Element", "Unit", *[f"Y{int(y)}" for y in years]]),
    }
