"""Correlations (STA-1, STA-2, STA-3).

``corr_pairs`` computes every pair of a column list, overall or per group, in
one hash aggregate: partial aggregation on the map side, one shuffle of
(group count × pair count) small buffers, so a group holding a third of all
rows costs nothing extra. The reference instead collected the table to the
driver and ran one query per group (``N + 1`` jobs).

``safe_corr`` is Pearson's r over pairwise-complete rows, NULL where r is
undefined (n < 2 or a constant column). Spark's own ``corr`` raises
DIVIDE_BY_ZERO under ANSI for a constant column, which is exactly the case of a
per-country attribute inside a per-country group (K21).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropstats.functions.clean import nan_to_null


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r of x and y over rows where both are present (not NULL, not NaN)."""
    cx = nan_to_null(F.col(x) if isinstance(x, str) else x).cast("double")
    cy = nan_to_null(F.col(y) if isinstance(y, str) else y).cast("double")
    both = cx.isNotNull() & cy.isNotNull()
    mx = F.when(both, cx)
    my = F.when(both, cy)
    r = F.try_divide(F.covar_pop(mx, my), F.stddev_pop(mx) * F.stddev_pop(my))
    # float error can push |r| a hair over 1 (least/greatest skip NULL: guard it)
    return F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def corr_pairs(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
               digits: int | None = None, x_col: str = "var_x",
               y_col: str = "var_y", r_col: str = "r",
               include_diagonal: bool = True) -> DataFrame:
    """Long correlation table ``(by…, var_x, var_y, r)`` (STA-2; STA-3 with ``by``).

    With ``by``, every group is computed in the same aggregate; this replaces
    collecting the table and looping over its first rows (LIM-2).

    Only pairs i ≤ j are aggregated; the mirror (j, i) reuses the same value.
    The diagonal is 1.0 wherever the column has spread, NULL otherwise.
    """
    cols = list(columns)
    aggs = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            if i == j and not include_diagonal:
                continue
            aggs.append(safe_corr(a, cols[j]).alias(f"__r_{i}_{j}"))
    grouped = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)

    def rval(i: int, j: int) -> Column:
        lo, hi = min(i, j), max(i, j)
        r = F.col(f"__r_{lo}_{hi}")
        return F.round(r, digits) if digits is not None else r

    entries = [F.struct(F.lit(a).alias(x_col), F.lit(b).alias(y_col), rval(i, j).alias(r_col))
               for i, a in enumerate(cols) for j, b in enumerate(cols)
               if include_diagonal or i != j]
    return grouped.select(*[F.col(f"`{c}`") for c in by], F.inline(F.array(*entries)))


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson"):
    """Dense correlation matrix via ``pyspark.ml.stat.Correlation`` (STA-1).

    Rows with a NULL in any column are skipped (the assembler would fail on
    them, K18). Returns a ``DenseMatrix`` of size k × k: a bounded result.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vec = VectorAssembler(inputCols=list(columns), outputCol="__features",
                          handleInvalid="skip").transform(df.select(*columns))
    return Correlation.corr(vec, "__features", method).head()[0]


def matrix_to_long(spark: SparkSession, matrix, names: Sequence[str],
                   digits: int | None = None, x_col: str = "var_x",
                   y_col: str = "var_y", r_col: str = "r") -> DataFrame:
    """k × k matrix → long DataFrame (k² rows)."""
    arr = matrix.toArray()
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            v = float(arr[i][j])
            rows.append((a, b, None if v != v else v))  # NaN → NULL
    out = spark.createDataFrame(rows, f"{x_col} string, {y_col} string, {r_col} double")
    return out.withColumn(r_col, F.round(r_col, digits)) if digits is not None else out
