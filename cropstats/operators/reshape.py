"""Wide ↔ long reshaping (RSH-1..RSH-5, PRJ-7, PRJ-8).

The wide yearly layout has up to three columns per year: ``Y1961`` (value),
``Y1961F`` (flag) and ``Y1961N`` (note). ``unpivot_years`` turns it into one
long row per (keys, year) in a single ``Generate`` over one scan — no shuffle,
no row id, no rejoin. ``strict_join=True`` keeps the reference's three-melt
plus two-left-join form for parity checks; it needs three scans, and its
shuffled joins on nullable keys lose flags and notes where a key is NULL (K2).

Scale note: the long table has (rows × years) rows, so filter the keys before
unpivoting, not after.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR_COLUMN = re.compile(r"^Y(\d{4})([FN]?)$")
_KIND = {"": "value", "F": "flag", "N": "note"}


def classify_year_columns(columns: Iterable[str],
                          pattern: re.Pattern[str] = YEAR_COLUMN) -> dict[int, dict[str, str]]:
    """Map year → {"value"|"flag"|"note": column name} (PRJ-7).

    Names are matched with ``^Y(\\d{4})([FN]?)$``, which is tighter than the
    prefix/suffix test (a key column such as ``Year`` or ``Area Code (M49)``
    is never taken for a year column).
    """
    out: dict[int, dict[str, str]] = {}
    for name in columns:
        m = pattern.match(name)
        if m:
            out.setdefault(int(m.group(1)), {})[_KIND[m.group(2)]] = name
    return dict(sorted(out.items()))


def year_of(c: Column | str, letters: str = "YFN") -> Column:
    """``Y1961F`` → 1961 as int (RSH-5)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, f"[{letters}]", "").try_cast("int")


def add_row_id(df: DataFrame, name: str = "Id") -> DataFrame:
    """Row id (PRJ-8). Unique but partition-dependent: never a test key (K1)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            variable_col: str = "variable", value_col: str = "value",
            value_type: str | None = None) -> DataFrame:
    """Wide → long over ``values`` (RSH-1); NULL values are kept.

    ``value_type`` casts every value column first, so mixed types never hit
    the unpivot type check (K5).
    """
    src = df
    if value_type:
        src = df.select(*[_q(c) for c in ids],
                        *[_q(c).try_cast(value_type).alias(c) for c in values])
    return src.unpivot(list(ids), list(values), variable_col, value_col)


def unpivot_years(df: DataFrame, id_cols: Sequence[str] | None = None,
                  year_col: str = "Year", value_col: str = "Yield",
                  flag_col: str = "YearFlag", note_col: str = "YearNote",
                  value_type: str = "double", years: Iterable[int] | None = None,
                  strict_join: bool = False) -> DataFrame:
    """Wide yearly table → ``(ids…, Year, value, flag, note)`` (RSH-2).

    ``id_cols`` defaults to every column that is not a year column. A year
    with a value but no flag column gets a NULL flag (and the reverse).
    ``years`` restricts the output to those years (a plan-time choice).
    """
    groups = classify_year_columns(df.columns)
    if years is not None:
        wanted = set(years)
        groups = {y: g for y, g in groups.items() if y in wanted}
    ids = list(id_cols) if id_cols is not None else [
        c for c in df.columns if not YEAR_COLUMN.match(c)]
    if strict_join:
        return _unpivot_years_three_melts(df, ids, groups, year_col, value_col,
                                          flag_col, note_col, value_type)

    def part(group: Mapping[str, str], kind: str, to: str) -> Column:
        name = group.get(kind)
        # try_cast: a text cell such as '-' becomes NULL instead of failing (K6)
        return _q(name).try_cast(to) if name else F.lit(None).cast(to)

    entries = [
        F.struct(F.lit(year).cast("int").alias(year_col),
                 part(g, "value", value_type).alias(value_col),
                 part(g, "flag", "string").alias(flag_col),
                 part(g, "note", "string").alias(note_col))
        for year, g in groups.items()
    ]
    return df.select(*[_q(c) for c in ids], F.inline(F.array(*entries)))


def _unpivot_years_three_melts(df: DataFrame, ids: list[str],
                               groups: Mapping[int, Mapping[str, str]],
                               year_col: str, value_col: str, flag_col: str,
                               note_col: str, value_type: str) -> DataFrame:
    """Reference-shaped form: three melts re-joined on all keys plus year.

    Kept for parity tests and plan comparison only (JON-1). Left joins on
    nullable keys never match a NULL key, so such rows lose flag and note (K2).
    """
    def melt(kind: str, out: str, to: str) -> DataFrame:
        cols = [g[kind] for g in groups.values() if kind in g]
        long = unpivot(df, ids, cols, "__var", out, to)
        return (long.withColumn(year_col, year_of("__var"))
                    .drop("__var"))

    values = melt("value", value_col, value_type)
    flags = melt("flag", flag_col, "string")
    notes = melt("note", note_col, "string")
    keys = ids + [year_col]
    return (values.join(flags, on=keys, how="left")
                  .join(notes, on=keys, how="left")
                  .select(*[_q(c) for c in ids], year_col, value_col, flag_col, note_col))


def explode_measures(df: DataFrame, id_cols: Sequence[str],
                     measures: Mapping[object, str] | Sequence[str],
                     name_col: str = "Measure", value_col: str = "Value",
                     value_type: str | None = None,
                     name_type: str | None = None) -> DataFrame:
    """Several columns of one meaning → (name, value) rows (RSH-3, RSH-4).

    ``measures`` is a list of column names (the label is the name) or a
    mapping label → column, e.g. ``{2012: "CPI Score 2012", …}`` for integer
    labels. NULL measures are kept as rows with a NULL value.
    """
    pairs = (list(measures.items()) if isinstance(measures, Mapping)
             else [(c, c) for c in measures])

    def val(c: str) -> Column:
        return _q(c).cast(value_type) if value_type else _q(c)

    def lab(label: object) -> Column:
        return F.lit(label).cast(name_type) if name_type else F.lit(label)

    entries = [F.struct(lab(label).alias(name_col), val(c).alias(value_col))
               for label, c in pairs]
    return df.select(*[_q(c) for c in id_cols], F.inline(F.array(*entries)))


def pivot_years(long: DataFrame, id_cols: Sequence[str], year_col: str,
                value_col: str, flag_col: str | None = None,
                note_col: str | None = None,
                years: Iterable[int] | None = None) -> DataFrame:
    """Long → wide yearly layout (inverse of ``unpivot_years``).

    One hash aggregate keyed by ``id_cols``; with ``years`` given no extra
    job is run to find the pivot values. Each (ids, year) must occur once.
    """
    aggs = [F.first(value_col, ignorenulls=True).alias("v")]
    if flag_col:
        aggs.append(F.first(flag_col, ignorenulls=True).alias("f"))
    if note_col:
        aggs.append(F.first(note_col, ignorenulls=True).alias("n"))
    grouped = long.groupBy(*id_cols)
    grouped = grouped.pivot(year_col, list(years)) if years is not None else grouped.pivot(year_col)
    wide = grouped.agg(*aggs)
    renames: dict[str, str] = {}
    for c in wide.columns:
        if c in id_cols:
            continue
        year, _, kind = c.rpartition("_")
        if not year:  # single aggregate: Spark names the column by the pivot value only
            year, kind = c, "v"
        renames[c] = "Y" + year + {"v": "", "f": "F", "n": "N"}[kind]
    return wide.withColumnsRenamed(renames)
