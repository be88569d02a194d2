"""Model stages, recipes, splits and evaluation (ML-1..ML-13).

Built on ``pyspark.ml``: fits are distributed tree aggregates and only model
parameters (k × k matrices, coefficient vectors, label lists) reach the
driver. Evaluation returns a one-row DataFrame computed by one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA,
    MinMaxScaler,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def assemble(inputs: Sequence[str], output: str = "features",
             handle_invalid: str = "error") -> VectorAssembler:
    """ML-1. ``handle_invalid="skip"`` drops rows with NULL inputs (K18)."""
    return VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid=handle_invalid)


def categorical(columns: Sequence[str], drop_last: bool = True, handle_invalid: str = "skip",
                index_suffix: str = "_rank", encoded_suffix: str = "_dummies") -> list:
    """StringIndexer + OneHotEncoder stages for ``columns`` (ML-2, ML-3, ML-4, FN-13).

    Index order: frequency descending, ties by label ascending. Labels unseen
    at fit time fail the reference's scoring job (K18); here
    ``handle_invalid="skip"`` (default) drops such rows at scoring, and
    ``"keep"`` gives them an extra index. With ``"keep"`` the encoder also
    reserves a slot for that index, so ``drop_last`` then drops the unseen
    slot and all real categories stay: together with an intercept that design
    is singular and the regression falls back to an iterative solver. The
    default keeps the reference's n − 1 dummies and an exact solve.
    """
    cols = list(columns)
    idx = [c + index_suffix for c in cols]
    enc = [c + encoded_suffix for c in cols]
    return [
        StringIndexer(inputCols=cols, outputCols=idx, handleInvalid=handle_invalid,
                      stringOrderType="frequencyDesc"),
        OneHotEncoder(inputCols=idx, outputCols=enc, dropLast=drop_last,
                      handleInvalid="keep" if handle_invalid == "keep" else "error"),
    ]


def minmax(column: str, output: str | None = None) -> list:
    """Scale one numeric column to [0, 1] (ML-5): assembler + MinMaxScaler."""
    out = output or column + "_unit"
    return [assemble([column], column + "_vector"),
            MinMaxScaler(inputCol=column + "_vector", outputCol=out)]


def standardize(input_col: str, output_col: str, with_mean: bool = True,
                with_std: bool = True) -> StandardScaler:
    """ML-6: (x − mean) / sample standard deviation."""
    return StandardScaler(inputCol=input_col, outputCol=output_col,
                          withMean=with_mean, withStd=with_std)


def linear_regression(features: str = "features", label: str = "Yield",
                      **params) -> LinearRegression:
    """ML-9. Without regularisation the default solver is the normal equation."""
    return LinearRegression(featuresCol=features, labelCol=label, **params)


def recipe(name: str, label: str = "Yield", country: str = "Country", item: str = "Item",
           temperature: str = "Temperature", gdp: str = "GDP", cpi: str = "CorruptionIndex",
           urban: str = "UrbanPopulation", rural: str = "RuralPopulation") -> Pipeline:
    """The three model recipes (ML-10, ML-13).

    - ``m1``: one-hot country and item (last level dropped) + temperature.
    - ``m2``: one-hot without dropping + temperature, GDP, CPI and min-max
      scaled urban and rural population.
    - ``m3``: PCA(2) of the standardised numeric + one-hot features, then
      regression on the two components plus the one-hot features.
    """
    if name == "m1":
        stages = categorical([country, item], drop_last=True)
        stages += [assemble([country + "_dummies", item + "_dummies", temperature], "features",
                            "skip"),
                   linear_regression("features", label)]
    elif name == "m2":
        stages = categorical([country, item], drop_last=False)
        stages += minmax(urban) + minmax(rural)
        stages += [assemble([country + "_dummies", item + "_dummies", temperature, gdp, cpi,
                             urban + "_unit", rural + "_unit"], "features", "skip"),
                   linear_regression("features", label)]
    elif name == "m3":
        stages = categorical([country, item], drop_last=False)
        stages += [assemble([country + "_dummies", item + "_dummies", temperature, gdp, cpi,
                             urban, rural], "m3_inputs", "skip"),
                   standardize("m3_inputs", "m3_standard"),
                   PCA(k=2, inputCol="m3_standard", outputCol="m3_components"),
                   assemble(["m3_components", country + "_dummies", item + "_dummies"],
                            "m3_design"),
                   linear_regression("m3_design", label)]
    else:
        raise ValueError(f"unknown recipe {name!r}")
    return Pipeline(stages=stages)


def split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2),
          seed: int | None = 42) -> list[DataFrame]:
    """``randomSplit`` (ML-11). Depends on the partitioning of ``df`` (K17)."""
    return df.randomSplit(list(weights), seed=seed)


def bucket_split(df: DataFrame, bucket: Column, train_percent: int = 80
                 ) -> tuple[DataFrame, DataFrame]:
    """Layout-independent split on a key-derived bucket in [0, 100) (ML-11, K17).

    Every row's side depends only on its key, never on partitioning or
    retries, so a lost executor recomputes the same split.
    """
    return df.where(bucket < train_percent), df.where(bucket >= train_percent)


def key_bucket(*keys: str) -> Column:
    """Bucket in [0, 100) from a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys), F.lit(100))


def digest_bucket(*keys: str) -> Column:
    """Bucket in [0, 100) from the MD5 digits of ``keys``, the same in Spark and in SQL (ML-11).

    Each key is written as its byte count, ``:`` and itself, or ``-`` if NULL, so
    no two key tuples share a text. The first eight digits are taken modulo 100.
    """
    texts = [F.col(f"`{k}`").cast("string") for k in keys]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint") % 100


def evaluate(predictions: DataFrame, label: str, prediction: str = "prediction",
             digits: int | None = None) -> DataFrame:
    """RMSE and R² in one aggregate, as a one-row DataFrame (ML-12).

    Same definitions as ``RegressionEvaluator``: RMSE = sqrt(mean((y − ŷ)²)),
    R² = 1 − Σ(y − ŷ)² / Σ(y − ȳ)². Rows without a prediction or label do not
    count; ``linear.LinearMap.score`` and ``scored_rows`` observe how many those are.
    """
    y = F.col(label).cast("double")
    err = (y - F.col(prediction)) * (y - F.col(prediction))
    rmse = F.sqrt(F.avg(err))
    r2 = F.lit(1.0) - F.try_divide(F.sum(err), F.count(y) * F.var_pop(y))
    if digits is not None:
        rmse, r2 = F.round(rmse, digits), F.round(r2, digits)
    known = y.isNotNull() & F.col(prediction).isNotNull()
    return predictions.where(known).agg(rmse.alias("rmse"), r2.alias("r2"))


def scored_rows(model: PipelineModel, df: DataFrame, counts: Observation | None = None) -> DataFrame:
    """``model.transform(df)``, with the rows that its stages skip observed by reason (ML-10, K18).

    ``counts`` gets ``given``, ``skipped_null`` (a NULL or NaN input) and
    ``skipped_unseen`` (a label that the indexers did not see).
    """
    if counts is not None:
        null, unseen = F.lit(False), F.lit(False)
        made = {c for s in model.stages for c in _names(s, "outputCol")}
        for stage in model.stages:
            for i, c in enumerate(_names(stage, "inputCol")):
                if c in made:
                    continue
                null = null | F.col(f"`{c}`").isNull()
                if isinstance(stage, StringIndexerModel):
                    unseen = unseen | ~F.col(f"`{c}`").cast("string").isin(list(stage.labelsArray[i]))
                elif dict(df.dtypes)[c] in ("double", "float"):
                    null = null | F.isnan(f"`{c}`")
        df = df.observe(counts, F.count(F.lit(1)).alias("given"), F.count(F.when(null, 1)).alias("skipped_null"),
                        F.count(F.when(~null & unseen, 1)).alias("skipped_unseen"))
    return model.transform(df)


def _names(stage, param: str) -> list[str]:
    """A stage's input or output columns, by its single or plural parameter."""
    for p in (param + "s", param):
        if stage.hasParam(p) and stage.isDefined(p):
            return list(stage.getOrDefault(p)) if p.endswith("s") else [stage.getOrDefault(p)]
    return []


def pca_pipeline(inputs: Sequence[str], k: int = 2, categorical_cols: Sequence[str] = (),
                 output: str = "__components") -> Pipeline:
    """Standardise then PCA(k) (ML-6, ML-7), optionally with one-hot categories first."""
    stages = categorical(categorical_cols, drop_last=False) if categorical_cols else []
    feature_cols = [c + "_dummies" for c in categorical_cols] + list(inputs)
    stages += [assemble(feature_cols, "__pca_input", "skip"),
               standardize("__pca_input", "__pca_scaled"),
               PCA(k=k, inputCol="__pca_scaled", outputCol=output)]
    return Pipeline(stages=stages)


def pca_signs(model: PipelineModel) -> list[float]:
    """Sign per component so its largest-magnitude loading is positive (K19)."""
    pc = model.stages[-1].pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        i = int(abs(col).argmax())
        signs.append(-1.0 if col[i] < 0 else 1.0)
    return signs


def pca_coordinates(model: PipelineModel, df: DataFrame, keep: Sequence[str] = (),
                    prefix: str = "PC", output: str = "__components") -> DataFrame:
    """Project ``df``: ``keep`` columns + PC1..PCk as doubles, sign-normalised (ML-8)."""
    signs = pca_signs(model)
    arr = vector_to_array(F.col(output))
    out = model.transform(df).select(*keep, arr.alias("__pc"))
    return out.select(*keep, *[(F.col("__pc")[j] * F.lit(s)).alias(f"{prefix}{j + 1}")
                               for j, s in enumerate(signs)])


def pca_by_group(df: DataFrame, inputs: Sequence[str], by: Sequence[str], k: int = 2,
                 categorical_cols: Sequence[str] = ()) -> DataFrame:
    """Mean principal-component coordinates per group (AGG-8, JOB-15)."""
    model = pca_pipeline(inputs, k, categorical_cols).fit(df)
    coords = pca_coordinates(model, df, keep=list(by))
    return coords.groupBy(*by).agg(*[F.avg(f"PC{j + 1}").alias(f"PC{j + 1}") for j in range(k)])
