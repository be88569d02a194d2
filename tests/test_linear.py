"""Gram-based least squares, components, counts, split and model store (ML-6..ML-13, JOB-13, JOB-15)."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cropstats.operators import linear, ml
from cropstats.plans import jobs
from cropstats.sources import models

SCHEMA = ("Year int, Country string, Item string, Temperature double, GDP double, CorruptionIndex int, "
          "UrbanPopulation double, RuralPopulation double, Yield long")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    out = []
    for i in range(500):
        c = "hot" if i % 3 == 0 else f"c{rng.integers(12)}"
        it = f"i{rng.integers(4)}"
        x = rng.normal(size=5)
        y = 1000 + 40 * x[0] - 7 * x[1] + (300 if c == "hot" else 5 * len(c)) + 11 * int(it[1]) + rng.normal()
        out.append((1990 + i % 20, c, it, 1e6 + float(x[0]), float(x[1]), int(50 + 10 * x[2]), float(x[3]), float(2 * x[3]), int(y * 100)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    odd = [(1, None, "i1", 1.0, 1.0, 1, 1.0, 1.0, 5), (2, "hot", "i1", float("nan"), 1.0, 1, 1.0, 1.0, 5), (3, "hot", "i1", None, None, 1, 1.0, 1.0, 5)]
    return spark.createDataFrame([*rows, *odd], SCHEMA).repartition(6)


def design(rows, reference, numeric, k=None):
    cols = [np.ones(len(rows))]
    for at in (1, 2):
        cols += [np.array([r[at] == v for r in rows], dtype=float) for v in sorted({r[at] for r in reference})]
    return np.column_stack([*cols, *[np.array([r[j] for r in rows], dtype=float) for j in numeric]])


@pytest.mark.parametrize("name,numeric", [("m1", [3]), ("m2", [3, 4, 5, 6, 7])])
def test_recipes_equal_least_squares(frame, rows, name, numeric):
    x = design(rows, rows, numeric)
    centred = np.column_stack([x[:, :-len(numeric)], x[:, -len(numeric):] - x[:, -len(numeric):].mean(0)])
    coef, *_ = np.linalg.lstsq(centred, np.array([r[8] for r in rows], dtype=float), rcond=None)
    counts = Observation("c")
    scored = linear.recipe(frame, name).score(frame, counts)
    got = {(r.Year, r.Country, r.Item, r.Temperature): r.prediction for r in scored.collect()}
    for r, p in zip(rows, centred @ coef, strict=True):
        assert got[r[:4]] == pytest.approx(p, rel=1e-7)
    assert counts.get == {"given": 503, "skipped_null": 3, "skipped_unseen": 0}


def test_components_equal_numpy(frame, rows):
    numeric = ["Temperature", "GDP", "CorruptionIndex", "UrbanPopulation", "RuralPopulation"]
    z = design(rows, rows, [3, 4, 5, 6, 7])[:, 1:]
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    made, variances, total = linear.components(linear.gram(frame, numeric, ["Country", "Item"]), 2)
    assert variances == pytest.approx(values[::-1][:2], rel=1e-9) and total == z.shape[1]
    got = {(r.Year, r.Country, r.Item, r.Temperature): (r.PC1, r.PC2) for r in made.score(frame).collect()}
    for r, p in zip(rows, z @ vectors[:, ::-1][:, :2], strict=True):
        assert np.abs(got[r[:4]]) == pytest.approx(np.abs(p), abs=1e-6)


def test_spectrum_of_close_values_and_rank_one():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    m = q @ np.diag([5, 4.999, 3, 1, 1, 0.5, 0, 0, 0]) @ q.T
    values, vectors = linear.spectrum(m, 3)
    assert values == pytest.approx([5, 4.999, 3], rel=1e-9) and np.abs(vectors.T @ q[:, :3]) == pytest.approx(np.eye(3), abs=1e-6)
    values, vectors = linear.spectrum(np.ones((3, 3)), 2)
    assert values == pytest.approx([3, 0], abs=1e-12) and vectors[:, 0] == pytest.approx([3 ** -0.5] * 3)
    assert linear.spectrum(np.zeros((2, 2)), 1)[0].tolist() == [0]


def test_dependent_columns_get_zero(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0, float(3 * i + 1)) for i in range(9)], "x double, twice double, same double, y double")
    g = linear.gram(df, ["x", "twice", "same"], label="y")
    coef, dependent = linear.solve(g.matrix, g.target)
    assert dependent == [2, 3] and coef == pytest.approx([13, 3, 0, 0])
    assert [r.prediction for r in linear.regression(g).score(df).orderBy("x").collect()] == pytest.approx([3 * i + 1 for i in range(9)])
    with pytest.raises(linear.NoRows):
        linear.regression(linear.gram(df.limit(0), ["x"], label="y"))


def test_too_many_levels_fail_loudly(spark, monkeypatch):
    monkeypatch.setattr(linear, "MAX_LEVELS", 3)
    with pytest.raises(ValueError, match="levels"):
        linear.gram(spark.createDataFrame([(str(i), 1.0) for i in range(4)], "c string, x double"), ["x"], ["c"])


def test_gram_is_one_hash_aggregate_before_the_shuffle(spark, frame):
    cells = frame.groupBy("Country", "Item").agg(F.covar_pop("Temperature", "GDP"))
    text = cells._jdf.queryExecution().executedPlan().toString()
    assert "partial_covar_pop" in text and "Window" not in text


def test_unseen_labels_are_counted_not_lost(spark, frame):
    other = spark.createDataFrame([(1, "hot", "i1", 1e6), (2, "nowhere", "i1", 1e6), (3, "hot", None, 1e6)], "Year int, Country string, Item string, Temperature double")
    counts = Observation("u")
    kept = linear.recipe(frame, "m1").score(other, counts, keep=True)
    assert sorted((r.Year, r.prediction is None) for r in kept.collect()) == [(1, False), (2, True), (3, True)]
    assert counts.get == {"given": 3, "skipped_null": 1, "skipped_unseen": 1}


def test_job13_scored_table_and_metrics(frame):
    table, counts = jobs.scored_table(frame, "m2")
    assert table.columns == ["Year", "Country", "Item", "Temperature", "Yield", "prediction"] and table.count() == 500
    assert counts.get["skipped_null"] == 3
    row = jobs.regression(frame, "m3", key_cols=["Year", "Country", "Item", "Temperature"]).first()
    test = frame.where(ml.digest_bucket("Year", "Country", "Item", "Temperature") >= 80)
    assert row.given == test.count() and 0.5 < row.r2 <= 1 and row.skipped_null + row.skipped_unseen <= 3
    empty = jobs.regression(frame.limit(0), "m2", key_cols=["Year"]).first()
    assert empty.rmse is None and empty.given == 0


def test_ml11_digest_bucket_is_md5_of_the_keys(spark):
    df = spark.createDataFrame([(1, "é"), (None, "x"), (12, None), (1, "")], "a int, b string")
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    for r in df.withColumn("bucket", ml.digest_bucket("a", "b")).collect():
        assert r.bucket == int(hashlib.md5((text(r.a) + text(r.b)).encode()).hexdigest()[:8], 16) % 100


def test_ml10_stored_models_score_other_tables(spark, frame, rows):
    train = frame.where("Year < 2005").dropna()
    pipeline = ml.recipe("m1").fit(train)
    exact = linear.recipe(train, "m1")
    first = models.save(train, pipeline, "test-model", ["Country", "Item", "Temperature"], {"rows": train.count()})
    models.save(train, exact, "test-model", ["Country", "Item", "Temperature"])
    assert len(models.versions(spark, "test-model")) == 2
    other = spark.createDataFrame([(r[1], r[2], int(r[3])) for r in rows[:50]] + [("nowhere", "i1", 3), (None, "i1", 3)], "Country string, Item string, Temperature int")
    stored = models.load(spark, "test-model", first)
    assert stored.counts == {"rows": train.count()} and [f.name for f in stored.inputs.fields] == ["Country", "Item", "Temperature"]
    seen = Observation("s")
    a = sorted((r.Country, r.Item, r.Temperature, round(r.prediction, 2)) for r in stored.score(other, seen).collect())
    direct = sorted((r.Country, r.Item, r.Temperature, round(r.prediction, 2)) for r in pipeline.transform(other).collect())
    newest = sorted((r.Country, r.Item, r.Temperature, round(r.prediction, 2)) for r in models.load(spark, "test-model").score(other).collect())
    assert a == direct and [x[:3] for x in newest] == [x[:3] for x in a] and [x[3] for x in newest] == pytest.approx([x[3] for x in a], rel=1e-4)
    assert seen.get == {"given": 52, "skipped_null": 1, "skipped_unseen": 1}
    with pytest.raises(ValueError, match="Item"):
        stored.score(other.drop("Item"))
    with pytest.raises(ValueError, match="Temperature"):
        stored.score(other.withColumn("Temperature", F.lit("warm")))
    with pytest.raises(ValueError, match="no model"):
        models.load(spark, "never saved")
