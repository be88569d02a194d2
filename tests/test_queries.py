"""Every registered query against its DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cropstats.plans.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "embeddings"]


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_marked():
    q, o = QUERIES, ORACLE
    assert set(q) <= set(entry.queries()) and set(o) <= set(entry.oracle_sql())
    assert set(o) <= set(q)
    assert set(q) - set(o) == {"q22e_recipe_m3"}


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables missing")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(ORACLE[name])
    cols = [d[0] for d in rel.description]
    want = _rows(cols, rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["Country", "var_x", "var_y", "r"]
    assert out.count() > 0


def test_q19b_pca_matches_numpy(spark):
    """Beside the SQL oracle: standardise, eigen-decompose, sign-normalise in numpy."""
    import numpy as np

    from cropstats.plans.queries import PCA_V2_INPUTS
    from cropstats.plans.tables import star_features

    got = {r.Country: (r.PC1, r.PC2)
           for r in entry.queries()["q19b_pca_features_v2"](spark, SF_SMALL).collect()}
    pdf = star_features(spark, SF_SMALL, version=2).toPandas()
    x = pdf[PCA_V2_INPUTS].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    vals, vecs = np.linalg.eigh(np.cov(z.T))
    top = vecs[:, np.argsort(vals)[::-1][:2]]
    for j in range(2):
        if top[np.abs(top[:, j]).argmax(), j] < 0:
            top[:, j] *= -1
    coords = z @ top
    pdf["PC1"], pdf["PC2"] = coords[:, 0], coords[:, 1]
    want = pdf.groupby("Country")[["PC1", "PC2"]].mean()
    assert set(got) == set(want.index)
    for country, (p1, p2) in got.items():
        assert p1 == pytest.approx(want.loc[country, "PC1"], abs=1e-6)
        assert p2 == pytest.approx(want.loc[country, "PC2"], abs=1e-6)


def _v2_split(spark):
    from cropstats.operators.ml import digest_bucket
    from cropstats.plans.queries import SPLIT_KEYS
    from cropstats.plans.tables import star_features

    pdf = star_features(spark, SF_SMALL, version=2).withColumn("b", digest_bucket(*SPLIT_KEYS)).toPandas()
    train, test = pdf[pdf.b < 80], pdf[pdf.b >= 80]
    test = test[test.Country.isin(train.Country) & test.Item.isin(train.Item)]
    return train, test


def _dummies(df, ref):
    import numpy as np
    cols = []
    for c in ("Country", "Item"):
        for level in sorted(ref[c].unique()):
            cols.append((df[c] == level).to_numpy(float))
    return np.column_stack(cols)


def _metrics(y, p):
    import numpy as np
    return (np.sqrt(np.mean((y - p) ** 2)),
            1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_q22d_recipe_m2_matches_least_squares(spark):
    import numpy as np

    got = entry.queries()["q22d_recipe_m2"](spark, SF_SMALL).collect()[0]
    train, test = _v2_split(spark)

    def design(df):
        scaled = []
        for c in ("UrbanPopulation", "RuralPopulation"):
            lo, hi = train[c].min(), train[c].max()
            scaled.append(((df[c] - lo) / (hi - lo) if hi > lo else df[c] * 0 + 0.5)
                          .to_numpy(float))
        num = df[["Temperature", "GDP", "CorruptionIndex"]].to_numpy(float)
        return np.column_stack([np.ones(len(df)), _dummies(df, train), num] + scaled)

    coef, *_ = np.linalg.lstsq(design(train), train.Yield.to_numpy(float), rcond=None)
    rmse, r2 = _metrics(test.Yield.to_numpy(float), design(test) @ coef)
    assert got.rmse == pytest.approx(rmse, rel=1e-4)
    assert got.r2 == pytest.approx(r2, rel=1e-4, abs=1e-4)


def test_q22e_recipe_m3_matches_least_squares(spark):
    import numpy as np

    got = entry.queries()["q22e_recipe_m3"](spark, SF_SMALL).collect()[0]
    train, test = _v2_split(spark)
    num = ["Temperature", "GDP", "CorruptionIndex", "UrbanPopulation", "RuralPopulation"]

    def raw(df):
        return np.column_stack([_dummies(df, train), df[num].to_numpy(float)])

    xt = raw(train)
    mean, std = xt.mean(0), xt.std(0, ddof=1)
    safe = np.where(std > 0, std, 1.0)

    def scaled(df):
        return np.where(std > 0, (raw(df) - mean) / safe, 0.0)

    vals, vecs = np.linalg.eigh(np.cov(scaled(train).T))
    top = vecs[:, np.argsort(vals)[::-1][:2]]

    def design(df):
        return np.column_stack([np.ones(len(df)), scaled(df) @ top, _dummies(df, train)])

    coef, *_ = np.linalg.lstsq(design(train), train.Yield.to_numpy(float), rcond=None)
    rmse, r2 = _metrics(test.Yield.to_numpy(float), design(test) @ coef)
    assert got.rmse == pytest.approx(rmse, rel=1e-4)
    assert got.r2 == pytest.approx(r2, rel=1e-4, abs=1e-4)
