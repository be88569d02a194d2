"""Least squares and principal components from one Gram aggregate (ML-6..ML-10, ML-13).

A design of an intercept, full dummy sets and numeric columns never has to be
written out: rows are aggregated once, by the categorical columns, into cells
(count, means, co-moments: fixed-width buffers with a map-side combine, so a cell
that holds a third of all rows costs nothing extra). Every entry of X'X and X'y
is a sum over cells, which Spark computes too; the driver gets one matrix whose
width is the number of levels and columns, bounded by ``MAX_LEVELS``.

All of regression with dummies, regression on components, and components
themselves are affine in the inputs: an intercept, a slope per numeric column, an
effect per level. ``LinearMap`` holds these and scores a table with one broadcast
join per categorical column (at most ``MAX_LEVELS`` rows each).

Rank. Columns are taken in order: intercept, levels (by frequency, then label),
numeric columns. One that depends on those before it, so that less than
``TOLERANCE`` of its sum of squares is left, gets the coefficient 0. Fitted values
do not depend on that choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cropstats.functions.clean import nan_to_null
from cropstats.session import checkpoint_dir

MAX_LEVELS = 4_000
TOLERANCE = 1e-9


class NoRows(ValueError):
    """There is no complete row to fit on."""


def number(name: str) -> Column:
    return nan_to_null(F.col(f"`{name}`").cast("double"))


@dataclass
class Gram:
    """X'X and X'y of the design, numeric columns less their means."""

    numeric: list[str]
    levels: dict[str, list[str]]
    matrix: np.ndarray
    target: np.ndarray
    rows: int
    means: dict[str, float]

    @property
    def columns(self) -> list[tuple[str, str | None]]:
        return [("", None), *[(c, v) for c, vs in self.levels.items() for v in vs], *[(c, None) for c in self.numeric]]


def gram(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), label: str | None = None) -> Gram:
    """The Gram matrix of the rows of ``df`` without NULL or NaN in any of the columns."""
    measures = [*numeric, *([label] if label else [])]
    given = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(categorical)],
                      *[number(m).alias(f"x{i}") for i, m in enumerate(measures)]).dropna()
    cats, xs = [f"c{i}" for i in range(len(categorical))], [f"x{i}" for i in range(len(measures))]
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    checkpoint_dir(df.sparkSession)
    cells = given.groupBy(*cats).agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in xs],
                                     *[(F.covar_pop(a, b) * F.count("*")).alias(f"{a}_{b}") for a, b in pairs]).where("n > 0").checkpoint()
    top = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[(F.sum(F.col("n") * F.col(x)) / F.sum("n")).alias(x) for x in xs],
                    *[F.count_distinct(c).alias(f"levels_{c}") for c in cats]).first()
    width = sum(top[f"levels_{c}"] for c in cats)
    if width > MAX_LEVELS:
        raise ValueError(f"{width} levels of {list(categorical)}; a dense solve takes at most {MAX_LEVELS}")
    centre = {x: top[x] or 0.0 for x in xs}
    off = {x: F.col("n") * (F.col(x) - F.lit(centre[x])) for x in xs}
    moments = cells.agg(*[F.sum(F.col(f"{a}_{b}") + off[a] * (F.col(b) - F.lit(centre[b]))).alias(f"{a}_{b}") for a, b in pairs]).first() if pairs else {}
    by_level = {c: cells.groupBy(c).agg(F.sum("n").alias("n"), *[F.sum(off[x]).alias(x) for x in xs]).orderBy(F.col("n").desc(), c).collect() for c in cats}
    size = 1 + width + len(numeric)
    full = np.zeros((size + bool(label), size + bool(label)))
    place = {c: {r[c]: i for i, r in enumerate(by_level[c], 1 + sum(top[f"levels_{d}"] for d in cats[:k]))} for k, c in enumerate(cats)}
    at = {x: 1 + width + i for i, x in enumerate(xs)}
    full[0, 0] = top["n"]
    for c in cats:
        for r in by_level[c]:
            i = place[c][r[c]]
            full[0, i] = full[i, i] = r["n"]
            for x in xs:
                full[i, at[x]] = r[x]
    for c, d in combinations(cats, 2):
        for r in cells.groupBy(c, d).agg(F.sum("n").alias("n")).collect():
            full[place[c][r[c]], place[d][r[d]]] = r["n"]
    for a, b in pairs:
        full[at[a], at[b]] = moments[f"{a}_{b}"] or 0.0
    full = np.triu(full) + np.triu(full, 1).T
    if label:  # the label's own mean is not in the design
        full[:size, size] += centre[xs[-1]] * full[:size, 0]
    levels = {name: [r[c] for r in by_level[c]] for name, c in zip(categorical, cats, strict=True)}
    return Gram(list(numeric), levels, full[:size, :size], full[:size, size] if label else np.zeros(size), int(top["n"]),
                {m: centre[x] for m, x in zip(measures, xs, strict=True)})


def solve(matrix: np.ndarray, target: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[int]]:
    """Coefficients by elimination in column order, and the columns that depend on earlier ones (coefficient 0)."""
    a = np.column_stack([matrix, target]).astype(float)
    whole, dependent = np.diag(matrix).copy(), []
    for i in range(len(matrix)):
        if a[i, i] <= tolerance * whole[i]:
            a[i] = 0.0
            a[:, i] = 0.0
            dependent.append(i)
            continue
        a[i] /= a[i, i]
        rest = a[:, i].copy()
        rest[i] = 0.0
        a -= np.outer(rest, a[i])
    return a[:, -1], dependent


@dataclass
class LinearMap:
    """Outputs that are affine in numeric columns and levels."""

    outputs: list[str]
    constant: list[float]
    slopes: dict[str, list[float]]
    effects: dict[str, dict[str, list[float]]]

    def score(self, df: DataFrame, counts: Observation | None = None, keep: bool = False) -> DataFrame:
        """``df`` with the outputs. Rows with a NULL input or an unseen level are left out, or kept with NULL.

        ``counts`` observes the rows ``given``, ``skipped_null`` and ``skipped_unseen``.
        """
        spark, out = df.sparkSession, df
        missing = F.lit(False)
        for c in self.slopes:
            missing = missing | number(c).isNull()
        for c in self.effects:
            missing = missing | F.col(f"`{c}`").isNull()
        for i, (c, levels) in enumerate(self.effects.items()):
            side = spark.createDataFrame([(v, e) for v, e in levels.items()], f"__level{i} string, __effect{i} array<double>")
            out = out.join(F.broadcast(side), F.col(f"`{c}`").cast("string") == F.col(f"__level{i}"), "left")
        unseen = F.lit(False)
        for i in range(len(self.effects)):
            unseen = unseen | F.col(f"__effect{i}").isNull()
        out = out.withColumn("__status", F.when(missing, "null").when(unseen, "unseen").otherwise("scored"))
        if counts is not None:
            one = lambda s: F.count(F.when(F.col("__status") == s, 1))
            out = out.observe(counts, F.count(F.lit(1)).alias("given"), one("null").alias("skipped_null"), one("unseen").alias("skipped_unseen"))
        if not keep:
            out = out.where(F.col("__status") == "scored")
        values = []
        for j in range(len(self.outputs)):
            value = F.lit(self.constant[j])
            for c, slope in self.slopes.items():
                value = value + F.lit(slope[j]) * number(c)
            for i in range(len(self.effects)):
                value = value + F.col(f"__effect{i}")[j]
            values.append(F.when(F.col("__status") == "scored", value).alias(self.outputs[j]))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], *values)


def _map(g: Gram, outputs: Sequence[str], coefficients: np.ndarray) -> LinearMap:
    """From coefficients over ``g.columns`` (one column per output) to the raw inputs."""
    constant, slopes, effects = coefficients[0].copy(), {}, {c: {} for c in g.levels}
    for (c, v), b in zip(g.columns[1:], coefficients[1:], strict=True):
        if v is not None:
            effects[c][v] = b.tolist()
        else:
            slopes[c] = b.tolist()
            constant = constant - b * g.means[c]
    return LinearMap(list(outputs), constant.tolist(), slopes, effects)


def regression(g: Gram, output: str = "prediction") -> LinearMap:
    """The least-squares fit of the label on the whole design."""
    if not g.rows:
        raise NoRows("no complete row to fit on")
    return _map(g, [output], solve(g.matrix, g.target)[0][:, None])


def spectrum(matrix: np.ndarray, k: int, doublings: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues and their vectors of a symmetric non-negative matrix.

    Power iteration by squaring: after t squarings the matrix holds 2^t steps,
    so the column of greatest norm is the first vector; it is taken out
    (deflation) and the rest treated alike. A vector's entry of greatest
    magnitude (the first of several) is positive.
    """
    rest, values, vectors = matrix.astype(float).copy(), [], []
    for _ in range(k):
        power = rest.copy()
        for _ in range(doublings):
            size = np.abs(power).max()
            if size == 0:
                break
            power = power / size
            power = power @ power
        norms = np.sqrt((power ** 2).sum(axis=0))
        v = power[:, norms.argmax()]
        v = v / norms.max() if norms.max() > 0 else np.zeros(len(matrix))
        if len(v) and v[np.abs(v).argmax()] < 0:
            v = -v
        value = float(v @ rest @ v)
        values.append(value)
        vectors.append(v)
        rest = rest - value * np.outer(v, v)
    return np.array(values), np.array(vectors).T


def components(g: Gram, k: int, outputs: Sequence[str] | None = None) -> tuple[LinearMap, np.ndarray, float]:
    """Coordinates on the first ``k`` principal components of the standardised design, their variances, and the sum of all.

    The intercept is no input; a constant column counts as 0.
    """
    loadings, values, total = _loadings(g, k)
    return _map(g, outputs or [f"PC{j + 1}" for j in range(k)], loadings), values, total


def _loadings(g: Gram, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients of the components over ``g.columns``."""
    mean = g.matrix[0, 1:] / max(g.rows, 1)
    cov = (g.matrix[1:, 1:] - g.rows * np.outer(mean, mean)) / max(g.rows - 1, 1)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    sd[sd <= 1e-12 * np.sqrt(np.maximum(np.diag(g.matrix)[1:], 1e-300) / max(g.rows, 1))] = 0.0
    scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    values, vectors = spectrum(cov * np.outer(scale, scale), k)
    slopes = scale[:, None] * vectors
    return np.vstack([-(mean @ slopes), slopes]), values, float((sd > 0).sum())


def component_regression(g: Gram, k: int = 2, output: str = "prediction") -> LinearMap:
    """The fit of the label on the first ``k`` components of the whole design and all dummies (recipe m3)."""
    if not g.rows:
        raise NoRows("no complete row to fit on")
    dummies = 1 + sum(len(v) for v in g.levels.values())
    change = np.zeros((len(g.columns), dummies + k))
    change[:dummies, :dummies] = np.eye(dummies)
    change[:, dummies:] = _loadings(g, k)[0]
    order = [0, *range(dummies, dummies + k), *range(1, dummies)]  # components come before the dummies
    change = change[:, order]
    return _map(g, [output], (change @ solve(change.T @ g.matrix @ change, change.T @ g.target)[0])[:, None])


def recipe(df: DataFrame, name: str, label: str = "Yield", country: str = "Country", item: str = "Item", temperature: str = "Temperature",
           gdp: str = "GDP", cpi: str = "CorruptionIndex", urban: str = "UrbanPopulation", rural: str = "RuralPopulation") -> LinearMap:
    """Recipes m1, m2 and m3 (``ml.recipe``) by a closed solve: same designs, same fitted values."""
    numeric = {"m1": [temperature], "m2": [temperature, gdp, cpi, urban, rural], "m3": [temperature, gdp, cpi, urban, rural]}
    if name not in numeric:
        raise ValueError(f"unknown recipe {name!r}")
    g = gram(df, numeric[name], [country, item], label)
    return component_regression(g) if name == "m3" else regression(g)
