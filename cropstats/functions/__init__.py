"""Column-level expressions (cleaning, casting, rounding)."""

from cropstats.functions.clean import (
    clean_name,
    clean_names,
    display_number,
    map_columns,
    map_other_columns,
    nan_to_null,
    not_contains,
    null_to_zero,
    rename,
    round_to,
    scale_truncate,
    strip_and_cast,
    to_number,
    truncate_int,
    year_range,
)

__all__ = [
    "clean_name", "clean_names", "display_number", "map_columns",
    "map_other_columns", "nan_to_null", "not_contains", "null_to_zero",
    "rename", "round_to", "scale_truncate", "strip_and_cast", "to_number",
    "truncate_int", "year_range",
]
