"""ML stages: ML-1..ML-13, AGG-8, K17, K18, K19."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cropstats.operators import ml


def test_ml2_index_order_frequency_then_label(spark):
    """ML-2, FN-13."""
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c", "b", "d"]], "t string")
    model = ml.categorical(["t"])[0].fit(df)
    assert model.labelsArray[0] == ["b", "c", "a", "d"]


def test_k18_unseen_label_kept_not_failing(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 1.5)], "t string, y double")
    test = spark.createDataFrame([("z", 3.0)], "t string, y double")
    model = Pipeline(stages=ml.categorical(["t"], handle_invalid="keep")).fit(train)
    row = model.transform(test).collect()[0]
    assert row.t_rank == 2.0  # the extra "unseen" index
    skip = Pipeline(stages=ml.categorical(["t"])).fit(train)
    assert skip.transform(test).count() == 0  # default: unseen rows are skipped at scoring


def test_k18_default_encoding_is_full_rank_and_solved_exactly(spark):
    rows = [(t, float(s), 10.0 * i + s) for i, t in enumerate("abc") for s in range(1, 6)]
    df = spark.createDataFrame(rows, "t string, s double, y double")
    model = Pipeline(stages=ml.categorical(["t"]) + [ml.assemble(["t_dummies", "s"]),
                                                       ml.linear_regression(label="y")]).fit(df)
    assert model.stages[-1].summary.totalIterations == 0  # direct normal-equation solve
    out = model.transform(df).select("y", "prediction").collect()
    assert max(abs(r.y - r.prediction) for r in out) < 1e-9


def test_ml5_minmax_in_unit_interval(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 7, 11, 5]], "u double")
    out = Pipeline(stages=ml.minmax("u")).fit(df).transform(df)
    vals = [r[0] for r in out.select(vector_to_array("u_unit")[0]).collect()]
    assert min(vals) == 0.0 and max(vals) == 1.0 and all(0 <= v <= 1 for v in vals)


def test_k17_bucket_split_disjoint_complete_layout_independent(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a_train, a_test = ml.bucket_split(df, ml.key_bucket("k"), 80)
    b = df.repartition(7)
    b_train, b_test = ml.bucket_split(b, ml.key_bucket("k"), 80)
    assert a_train.count() + a_test.count() == 2000
    assert a_train.join(a_test, "k").count() == 0
    assert a_train.exceptAll(b_train).count() == 0 and b_train.exceptAll(a_train).count() == 0
    assert 1500 < a_train.count() < 1700


def test_ml12_evaluate_matches_numpy(spark):
    rows = [(1.0, 1.1), (2.0, 1.9), (3.0, 3.3), (4.0, 3.8)]
    df = spark.createDataFrame(rows, "y double, prediction double")
    r = ml.evaluate(df, "y").collect()[0]
    y = np.array([a for a, _ in rows])
    p = np.array([b for _, b in rows])
    assert r.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert r.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    from pyspark.ml.evaluation import RegressionEvaluator
    ev = RegressionEvaluator(labelCol="y", predictionCol="prediction")
    assert r.rmse == pytest.approx(ev.evaluate(df))
    assert r.r2 == pytest.approx(ev.evaluate(df, {ev.metricName: "r2"}))


def test_ml9_linear_regression_recovers_line(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x + 2.0) for x in range(20)], "x double, y double")
    model = Pipeline(stages=[ml.assemble(["x"]), ml.linear_regression(label="y")]).fit(df)
    lr = model.stages[-1]
    assert lr.coefficients[0] == pytest.approx(3.0) and lr.intercept == pytest.approx(2.0)


def _pca_frame(spark):
    rng = np.random.default_rng(11)
    a = rng.normal(size=120)
    rows = [(["g1", "g2", "g3"][i % 3], float(a[i]), float(2 * a[i] + rng.normal() * 0.3),
             float(rng.normal())) for i in range(120)]
    return spark.createDataFrame(rows, "g string, p double, q double, r double")


def test_k19_pca_sign_normalised_and_deterministic(spark):
    df = _pca_frame(spark)
    model = ml.pca_pipeline(["p", "q", "r"], k=2).fit(df)
    pc = model.stages[-1].pc.toArray()
    signs = ml.pca_signs(model)
    for j, s in enumerate(signs):
        col = pc[:, j] * s
        assert col[np.abs(col).argmax()] > 0
    a = ml.pca_by_group(df, ["p", "q", "r"], ["g"])
    b = ml.pca_by_group(df.repartition(5), ["p", "q", "r"], ["g"])
    ra = {r.g: (r.PC1, r.PC2) for r in a.collect()}
    rb = {r.g: (r.PC1, r.PC2) for r in b.collect()}
    for g in ra:
        assert ra[g][0] == pytest.approx(rb[g][0], abs=1e-9)
        assert ra[g][1] == pytest.approx(rb[g][1], abs=1e-9)


def test_pca_matches_numpy_variance(spark):
    df = _pca_frame(spark)
    model = ml.pca_pipeline(["p", "q", "r"], k=2).fit(df)
    x = np.array([[r.p, r.q, r.r] for r in df.collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    got = list(model.stages[-1].explainedVariance)
    assert got[0] == pytest.approx(ev[0] / ev.sum(), abs=1e-9)
    assert got[1] == pytest.approx(ev[1] / ev.sum(), abs=1e-9)


def test_recipes_build_and_fit(spark):
    rows = []
    for i in range(60):
        c, it = ["DE", "AF", "NA"][i % 3], ["Wheat", "Rice"][i % 2]
        rows.append((c, it, 10.0 + i % 7, 1.0 + i % 5, 40 + i % 9, 1e6 + i, 2e6 - i,
                     int(100 + 3 * (i % 7) + (10 if c == "DE" else 0))))
    df = spark.createDataFrame(rows, "Country string, Item string, Temperature double, "
                               "GDP double, CorruptionIndex int, UrbanPopulation double, "
                               "RuralPopulation double, Yield int")
    for name in ("m1", "m2", "m3"):
        model = ml.recipe(name).fit(df)
        out = ml.evaluate(model.transform(df), "Yield").collect()[0]
        assert out.rmse >= 0 and out.r2 <= 1.0
    with pytest.raises(ValueError):
        ml.recipe("m9")


def test_ml8_pca_coordinates_columns(spark):
    """ML-8, UDF-2 (vector_to_array instead of rdd.map)."""
    df = _pca_frame(spark)
    model = ml.pca_pipeline(["p", "q"], k=2).fit(df)
    out = ml.pca_coordinates(model, df, keep=["g"])
    assert out.columns == ["g", "PC1", "PC2"]
    assert out.where(F.col("PC1").isNull()).count() == 0
