"""Cross products as matrices: equal to sums of expressions, with plans that don't grow with the square of the columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapwise
from gapwise.operators import models
from gapwise.plans import products


def frame(spark, n, p, gaps, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 0] = x[:, 1:].sum(axis=1) + 0.1 * rng.normal(size=n)
    rows = [(i, *[None if j < gaps and (i + j) % 7 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id int, " + ", ".join(f"c{j} double" for j in range(p)))


def test_products_by_group_with_weights_and_nulls(spark, monkeypatch):
    rows = [(("a", None, "b")[i % 3], float(i), None if i % 5 == 0 else i / 7, 1 + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w int").repartition(7)
    monkeypatch.setattr(products, "HELD_BYTES", 100)
    got = products.cross_products(df, [F.lit(1.0), F.col("x"), F.col("y")], F.col("w"), F.col("g"))
    assert set(got) == {"a", "b", None}
    for g, (n, m) in got.items():
        mine = [r for r in rows if r[0] == g]
        z = np.array([[1.0, r[1], r[2] or 0.0] for r in mine])
        assert n == len(mine) and np.allclose(m, (z * np.array([r[3] for r in mine])[:, None]).T @ z)
    assert products.cross_products(df.limit(0), [F.col("x")]) == {}
    assert products.cross_products(df, [F.lit(2.0)])[None][1][0, 0] == pytest.approx(1200)


def test_wide_imputation_gives_the_values_of_the_narrow_one(spark, monkeypatch):
    _, df = frame(spark, 200, 5, 2)
    for posterior in (True, False):
        narrow = gapwise.impute_mice(df, "id", 2, 3, n_imputations=2, sample_posterior=posterior).orderBy("chain", "id").collect()
        with monkeypatch.context() as m:
            m.setattr(models, "WIDE", 0)
            m.setattr(models, "WIDE_STEPS", 1)
            wide = gapwise.impute_mice(df, "id", 2, 3, n_imputations=2, sample_posterior=posterior).orderBy("chain", "id").collect()
        assert np.allclose(np.array(narrow, dtype=float), np.array(wide, dtype=float), atol=1e-8)


def test_five_hundred_columns(spark):
    x, df = frame(spark, 1200, 500, 2)
    got = np.array(gapwise.impute_mice(df, "id", 1, sample_posterior=False).orderBy("id").select("c0").collect(), dtype=float)[:, 0]
    gone = np.arange(1200) % 7 == 0
    assert np.allclose(got[~gone], x[~gone, 0]) and np.corrcoef(got[gone], x[gone, 0])[0, 1] > 0.9


def test_pooled_regressions_are_those_of_numpy(spark):
    rng = np.random.default_rng(5)
    n = 240
    a, b, chain = rng.normal(50, 3, n), rng.normal(size=n), np.arange(n) % 4
    y = 2 * a - b + rng.normal(size=n) + chain * 0.1
    rows = [(int(c), float(u), float(v), float(t)) for c, u, v, t in zip(chain, a, b, y, strict=True)] + [(0, None, 1.0, 2.0), (1, 1.0, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "chain int, a double, b double, y double")
    got = {r.term: r for r in gapwise.pool_regressions(df, ["a", "b"], "y").collect()}
    coefs, covs = [], []
    for c in range(4):
        x = np.column_stack([np.ones(n), a, b])[chain == c]
        w, rss, *_ = np.linalg.lstsq(x, y[chain == c], rcond=None)
        coefs.append(w)
        covs.append(rss[0] / (len(x) - 3) * np.linalg.inv(x.T @ x))
    want = gapwise.pool_linear_regression_results(np.array(coefs), np.array(covs))
    for i, term in enumerate(("intercept", "a", "b")):
        assert got[term].coef == pytest.approx(want["coef_"][i], rel=1e-8) and got[term].se == pytest.approx(want["se_"][i], rel=1e-8)
        assert got[term].df == pytest.approx(want["df_"][i], rel=1e-6)
    with pytest.raises(gapwise.InsufficientDataError):
        gapwise.pool_regressions(df.limit(3), ["a", "b"], "y")
