"""Feature tables: facts joined through the country-code hub (JOB-10, JOB-11).

Shape of the plan: the long yield facts join the code hub, then one or more
(ISO3, Year) attribute tables. Nothing is counted in advance: a side is
broadcast when its size in bytes, from the files, the table statistics
(``catalog.analyze_table``) or the finished stage below it, is under Spark's
threshold; otherwise the join stays sort-merge with skew splitting on. Filters on
element and item, and null checks, go through the joins to the facts' scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropstats.functions.clean import to_number
from cropstats.operators.joins import Dim, star_join


def mean_temperature(temps: DataFrame, group_keys: Sequence[str] = ("Country", "Year", "ISO3"),
                     out_keys: Sequence[str] = ("Year", "ISO3"),
                     value: str = "Temperature") -> DataFrame:
    """AVG of a (possibly text) measure grouped by ``group_keys`` (AGG-6, FN-11).

    Grouping keeps ``Country`` while only (Year, ISO3) come out, as in the
    reference: two names sharing one ISO3 give two rows (K14). Use
    ``joins.assert_unique`` on the result where that matters.
    """
    return (temps.groupBy(*group_keys)
                 .agg(F.avg(to_number(value)).alias(value))
                 .select(*out_keys, value))


def finish_features(df: DataFrame, yield_col: str = "Yield",
                    round_cols: Sequence[str] = ("Temperature",), digits: int = 2,
                    element_col: str | None = "Element", element: str | None = "Yield",
                    not_null: Sequence[str] = (), null_yield: str = "zero",
                    yield_type: str = "bigint") -> DataFrame:
    """Post-join cleanup (FN-7, FN-3, FN-6, FLT-2, FLT-4, PRJ-10, K13).

    ``null_yield="zero"`` turns a missing yield into 0 (as the reference),
    ``"drop"`` removes the row instead. Yields are truncated to ``yield_type``.
    """
    y = F.col(yield_col)
    if null_yield == "zero":
        out = df.withColumn(yield_col, F.when(y.isNull(), F.lit(0))
                            .otherwise(y.try_cast(yield_type)))
    elif null_yield == "drop":
        out = df.where(y.isNotNull()).withColumn(yield_col, y.try_cast(yield_type))
    else:
        raise ValueError("null_yield must be 'zero' or 'drop'")
    out = out.withColumns({c: F.round(c, digits) for c in round_cols})
    cond = F.lit(True)
    if element_col and element is not None:
        cond = cond & (F.col(element_col) == element)
    for c in not_null:
        cond = cond & F.col(c).isNotNull()
    return out.where(cond)


def build_features(crop_yield: DataFrame, country_codes: DataFrame, temperature: DataFrame,
                   corruption: DataFrame | None = None, gdp: DataFrame | None = None,
                   population: DataFrame | None = None, null_yield: str = "zero",
                   element: str | None = "Yield") -> DataFrame:
    """Feature table v1 (temperature only) or v2 (all attributes).

    Column names follow the catalog tables of the loaders (``plans.jobs``):
    crop_yield(AreaCodeM49, Year, Country, Item, Element, Unit, Yield),
    country_codes(ISONum, ISO3), temperature = ``mean_temperature(...)``,
    corruption(ISO, Year, CPI), gdp(Code, Year, GDP),
    population(Code, Year, UrbanPopulation, RuralPopulation).
    """
    facts = crop_yield.select("Year", "Country", "Item", "Element", "Unit", "Yield",
                              "AreaCodeM49")
    dims = [
        Dim(country_codes, {"AreaCodeM49": "ISONum"}, ["ISO3"]),
        Dim(temperature, {"ISO3": "ISO3", "Year": "Year"}, ["Temperature"]),
    ]
    v2 = corruption is not None
    if v2 and (gdp is None or population is None):
        raise ValueError("the second version needs corruption, gdp and population together")
    if v2:
        dims += [
            Dim(corruption, {"ISO3": "ISO", "Year": "Year"}, ["CPI"]),
            Dim(gdp, {"ISO3": "Code", "Year": "Year"}, ["GDP"]),
            Dim(population, {"ISO3": "Code", "Year": "Year"},
                ["UrbanPopulation", "RuralPopulation"]),
        ]
    joined = star_join(facts, dims)
    cols = ["Year", "Country", "Item", "Element", "Unit", "Yield", "Temperature"]
    if v2:
        joined = joined.withColumnRenamed("CPI", "CorruptionIndex")
        cols += ["CorruptionIndex", "GDP", "UrbanPopulation", "RuralPopulation"]
    return finish_features(joined.select(*cols), null_yield=null_yield, element=element,
                           round_cols=("Temperature", "GDP") if v2 else ("Temperature",),
                           not_null=("CorruptionIndex",) if v2 else ())


def select_series(features: DataFrame, filters: dict[str, object],
                  columns: Sequence[str] | None = None,
                  order_by: Sequence[str] = ()) -> DataFrame:
    """One series, e.g. ``{"Country": "Germany", "Item": "Wheat"}`` (FLT-3, PRJ-1, ORD-1)."""
    cond = F.lit(True)
    for k, v in filters.items():
        cond = cond & (F.col(k) == F.lit(v))
    out = features.where(cond)
    if columns:
        out = out.select(*columns)
    return out.orderBy(*order_by) if order_by else out
