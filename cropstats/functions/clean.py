"""Column cleaning under ANSI rules (PRJ-3, PRJ-4, PRJ-6, FN-1..FN-12).

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen. Casting of dirty text always goes through ``try_cast``: under ANSI a
bare ``cast('-' as int)`` fails the whole job (quirk K6).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- names -------------------------------------------------------------------

def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename several columns at once (PRJ-3); unknown names are ignored."""
    return df.withColumnsRenamed(dict(mapping))


def clean_name(name: str, remove: str = " ()") -> str:
    return "".join(ch for ch in name if ch not in remove)


def clean_names(df: DataFrame, remove: str = " ()") -> DataFrame:
    """Strip spaces and parentheses from every column name (PRJ-4).

    Raises when two columns would end up with the same name.
    """
    new = [clean_name(c, remove) for c in df.columns]
    if len(set(new)) != len(new):
        dupes = sorted({n for n in new if new.count(n) > 1})
        raise ValueError(f"cleaned column names collide: {dupes}")
    return df.toDF(*new)


def map_columns(df: DataFrame, columns: Iterable[str],
                fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to the chosen columns, keep the others and the order (PRJ-6)."""
    chosen = set(columns)
    return df.select(*[fn(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`")
                       for c in df.columns])


def map_other_columns(df: DataFrame, keep: Iterable[str],
                      fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to every column not in ``keep`` (PRJ-6, reverse form)."""
    kept = set(keep)
    return map_columns(df, [c for c in df.columns if c not in kept], fn)


# -- numbers out of text ------------------------------------------------------

def strip_and_cast(c: ColumnOrName, pattern: str, to: str = "int") -> Column:
    """Remove ``pattern`` (a regex) and cast what is left (FN-1, FN-2).

    ``'004`` with pattern ``[']`` gives 4; ``< 10,000`` with ``[<, ]`` gives
    10000. Text that is still not a number becomes NULL instead of failing.
    Integral targets go through an exact decimal first, so ``12.0`` is 12 (K6)
    and no digit of a ``bigint`` is lost; text beyond it goes through ``double``.
    """
    stripped = F.regexp_replace(_col(c).cast("string"), pattern, "")
    if to in ("int", "bigint", "smallint", "tinyint", "long", "integer", "short"):
        return F.coalesce(stripped.try_cast("decimal(38,10)").try_cast(to),
                          stripped.try_cast("double").try_cast(to))
    return stripped.try_cast(to)


def to_number(c: ColumnOrName, to: str = "double") -> Column:
    """Text or number → number; NaN and non-numeric text → NULL (FN-11, K4)."""
    as_double = _col(c).try_cast("double")
    as_double = F.when(F.isnan(as_double), F.lit(None).cast("double")).otherwise(as_double)
    return as_double if to == "double" else as_double.try_cast(to)


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN → NULL, other values unchanged (K4, K10, K21)."""
    x = _col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def scale_truncate(c: ColumnOrName, factor: float, to: str = "int") -> Column:
    """``(x * factor)`` truncated toward zero (FN-3, FN-4, K7).

    Used to bring the 0–10 corruption scale to 0–100. NaN gives NULL, not 0
    and not an overflow error (K4).
    """
    return nan_to_null(_col(c) * F.lit(factor)).try_cast(to)


def truncate_int(c: ColumnOrName) -> Column:
    """Numeric truncating cast to int with NaN → NULL (FN-3, FN-12)."""
    return nan_to_null(_col(c)).try_cast("int")


def round_to(c: ColumnOrName, digits: int) -> Column:
    """Half-up rounding kept as a number (FN-6); see K3 for why not a string."""
    return F.round(_col(c), digits)


def display_number(c: ColumnOrName, digits: int) -> Column:
    """Presentation string with thousands separators (FN-5, ``format_number``).

    Half-even rounding (0.125 → ``0.12``). Not for further arithmetic (K3).
    """
    return F.format_number(_col(c), digits)


def null_to_zero(c: ColumnOrName) -> Column:
    """NULL → 0 (FN-7)."""
    return F.coalesce(_col(c), F.lit(0))


# -- row predicates -----------------------------------------------------------

def year_range(df: DataFrame, column: str, low: int | None = None,
               high: int | None = None, low_inclusive: bool = True,
               high_inclusive: bool = True) -> DataFrame:
    """Keep rows whose ``column`` lies within the bounds (FLT-1, FLT-6, K12)."""
    cond = F.lit(True)
    y = F.col(column)
    if low is not None:
        cond = cond & ((y >= low) if low_inclusive else (y > low))
    if high is not None:
        cond = cond & ((y <= high) if high_inclusive else (y < high))
    return df.where(cond)


def not_contains(c: ColumnOrName, text: str) -> Column:
    """``NOT contains`` (FLT-5, FN-8). NULL input stays NULL, so a filter drops it (K15)."""
    return ~_col(c).contains(text)
