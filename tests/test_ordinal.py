"""Ordinal regression: the maximum of the likelihood, the levels it fills, and what happens where it has none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.errors import ImputationError
from gapwise.operators import models

LEVELS = ["high", "low", "mid"]
ORDER = ["low", "mid", "high"]


def drawn(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n) * 3 + 10, rng.normal(size=n), np.full(n, 4.0)])
    u = x @ [0.4, -1.0, 0.0] + rng.logistic(size=n)
    return x, np.digitize(u, [3.0, 5.0])


def log_likelihood(t, x, y):
    theta, beta = np.r_[-np.inf, t[:2], np.inf], t[2:]
    f = lambda v: 1 / (1 + np.exp(-np.clip(v, -700, 700)))
    eta = x @ beta
    return np.log(f(theta[y + 1] - eta) - f(theta[y] - eta)).sum()


def independent_optimum(x, y):
    """Newton's method on numerical derivatives, steps halved until the likelihood rises."""
    t = np.r_[-1.0, 1.0, 0.0, 0.0]
    ok = lambda v, old: v[0] < v[1] and log_likelihood(v, x, y) >= log_likelihood(old, x, y)
    eye = np.eye(4) * 1e-4
    for _ in range(60):
        g = np.array([(log_likelihood(t + e, x, y) - log_likelihood(t - e, x, y)) / 2e-4 for e in eye])
        h = np.array([[(log_likelihood(t + a + b, x, y) - log_likelihood(t + a - b, x, y) - log_likelihood(t - a + b, x, y) + log_likelihood(t - a - b, x, y)) / 4e-8 for a in eye] for b in eye])
        step = -np.linalg.solve(h, g)
        t = next((t + step / 2**k for k in range(30) if ok(t + step / 2**k, t)), t)
    return t


def frame(spark, x, y, gone=lambda i: i % 5 == 0):
    return spark.createDataFrame([(f"k{i:04d}", *map(float, r), None if gone(i) else ORDER[k]) for i, (r, k) in enumerate(zip(x, y, strict=True))], "id string, a double, chain double, c double, grade string").repartition(3)


def test_coefficients_are_the_optimum(spark):
    x, y = drawn()
    rows = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)], "a double, b double, c double, y int").repartition(4)
    thresholds, slopes = models.fit_ordinal(rows, F.col("y"), [F.col("a"), F.col("b"), F.col("c")], 3)
    want = independent_optimum(x[:, :2], y)
    assert np.allclose([*thresholds, *slopes[:2]], want, atol=2e-5) and slopes[2] == 0.0
    assert log_likelihood(np.r_[thresholds, slopes[:2]], x[:, :2], y) >= log_likelihood(want, x[:, :2], y) - 1e-9


def test_filled_levels_row_by_row(spark):
    x, y = drawn()
    seen = np.array([i % 5 > 0 for i in range(len(y))])
    t = independent_optimum(x[seen][:, :2], y[seen])
    upto = 1 / (1 + np.exp(-(t[:2][None, :] - (x[:, :2] @ t[2:])[:, None])))
    best = np.argmax(np.diff(np.column_stack([np.zeros(len(y)), upto, np.ones(len(y))]), axis=1), axis=1)
    out = models.impute_polr(frame(spark, x, y), "id", orders={"grade": ORDER}).orderBy("id").collect()
    assert [r.grade for r in out] == [ORDER[y[i] if seen[i] else best[i]] for i in range(len(y))]


def test_no_maximum_falls_back_or_raises(spark):
    x = np.column_stack([np.arange(60.0), np.zeros(60), np.zeros(60)])
    y = np.repeat([0, 1, 2], 20)
    d = frame(spark, x, y, lambda i: i % 7 == 3)
    with pytest.raises(ImputationError):
        models.impute_polr(d, "id", strict_mode=True, orders={"grade": [*ORDER, "never"]})
    with pytest.warns(UserWarning, match="ordinal model failed"):
        out = models.impute_polr(d, "id", strict_mode=False, orders={"grade": [*ORDER, "never"]})
    assert out.where("grade is null").isEmpty() and out.count() == 60
