"""Run the application end to end: load, weather, analysis (JOB-1..JOB-16).

    python -m cropstats.plans.app --database cropstats_db \\
        --input production=/data/production.csv --input codes=/data/codes.csv ... \\
        [--steps load,weather,analyze] [--format parquet]

Inputs (``--input name=path``): production, urban, gdp, religion,
cpi_yearly (folder of ``CPI-<year>.csv``), cpi_sheet, emissions, temperature,
codes, stations (JSON array, gzip allowed), daily (folder of
``<station>.csv.gz``). Loaders run only for the inputs given. The analysis
step writes the data behind every chart and metric of the analysis
as tables instead of drawing them.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropstats.operators import stats
from cropstats.plans import jobs
from cropstats.session import build
from cropstats.sources import catalog

LOADERS = {
    "production": lambda s, p, db, fmt: jobs.load_production(s, p["production"], db, fmt),
    "urban": lambda s, p, db, fmt: jobs.load_urban_population(s, p["urban"], db, fmt),
    "gdp": lambda s, p, db, fmt: jobs.load_gdp_share(s, p["gdp"], db, fmt),
    "religion": lambda s, p, db, fmt: jobs.load_religion(s, p["religion"], db, fmt),
    "cpi_yearly": lambda s, p, db, fmt: jobs.load_corruption(s, p["cpi_yearly"], p["cpi_sheet"],
                                                             db, fmt),
    "emissions": lambda s, p, db, fmt: jobs.load_emissions(s, p["emissions"], db, fmt),
    "temperature": lambda s, p, db, fmt: jobs.load_surface_temperature(s, p["temperature"],
                                                                       db, fmt),
    "codes": lambda s, p, db, fmt: jobs.load_country_codes(s, p["codes"], db, fmt),
}


def load(spark: SparkSession, inputs: Mapping[str, str], database: str,
         fmt: str = "parquet", location: str | None = None) -> list[str]:
    """CAT-1 then every loader whose input is given; returns the loaders run."""
    catalog.ensure_database(spark, database, location)
    done = []
    for name, loader in LOADERS.items():
        if name in inputs:
            loader(spark, inputs, database, fmt)
            done.append(name)
    return done


def weather(spark: SparkSession, inputs: Mapping[str, str], database: str,
            fmt: str = "parquet") -> DataFrame:
    """JOB-9 (needs crop_yield and country_codes loaded)."""
    return jobs.load_weather(spark, inputs["stations"], inputs["daily"], database, fmt)


def analyze(spark: SparkSession, database: str, fmt: str = "parquet",
            series: tuple[str, str] | None = None,
            recipes: Sequence[str] = ("m1", "m2", "m3")) -> dict[str, str]:
    """JOB-10..JOB-15: feature tables, correlations, PCA and model metrics as tables."""
    out: dict[str, str] = {}

    def save(df: DataFrame, name: str) -> None:
        full = f"{database}.{name}"
        catalog.save_table(df, full, fmt)
        out[name] = full

    save(jobs.feature_table(spark, 1, database), "features_v1")
    save(jobs.feature_table(spark, 2, database), "features_v2")
    v1 = catalog.table(spark, f"{database}.features_v1")
    v2 = catalog.table(spark, f"{database}.features_v2")
    if series:
        points, ranges, r = jobs.series_correlation(v1, *series)
        save(points, "series_points")
        save(ranges, "series_range")
        save(r, "series_r")
    overall, by_group = jobs.correlation_tables(v2)
    save(overall, "correlations_overall")
    save(by_group, "correlations_by_country_item")
    save(stats.corr_pairs(v1, ["Temperature", "Yield"], by=["Country", "Item"], digits=2),
         "correlations_temperature_yield")
    save(jobs.pca_by_country(v2, with_categories=True), "pca_by_country")
    save(jobs.pca_by_country(v2, with_categories=False), "pca_by_country_numeric")
    for name in recipes:
        save(jobs.scored_table(v1 if name == "m1" else v2, name)[0], f"scored_{name}")
    metrics = None
    for name in recipes:
        data = v1 if name == "m1" else v2
        m = jobs.regression(data, name, key_cols=["Country", "Item", "Year"]) \
            .withColumn("recipe", F.lit(name))
        metrics = m if metrics is None else metrics.unionByName(m)
    if metrics is not None:
        save(metrics, "model_metrics")
    return out


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--database", default=jobs.DATABASE)
    ap.add_argument("--location", default=None, help="database location (CAT-1)")
    ap.add_argument("--input", action="append", default=[], help="name=path")
    ap.add_argument("--steps", default="load,weather,analyze")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--series", default=None, help="Country,Item for the single-series r")
    ap.add_argument("--cluster", action="store_true", help="apply the large-cluster settings")
    args = ap.parse_args(argv)
    inputs = dict(kv.split("=", 1) for kv in args.input)
    spark = build("cropstats-app", cluster=args.cluster)
    steps = set(args.steps.split(","))
    if "load" in steps:
        load(spark, inputs, args.database, args.format, args.location)
    if "weather" in steps and {"stations", "daily"} <= set(inputs):
        weather(spark, inputs, args.database, args.format)
    if "analyze" in steps:
        series = tuple(args.series.split(",", 1)) if args.series else None
        analyze(spark, args.database, args.format, series)
    spark.stop()


if __name__ == "__main__":
    main()
