"""Little's test: known values, and the same ones whether the patterns are on the driver or on the executors."""

import csv
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.operators import mcar

#: R's table of daily air quality in New York as CSV, where there is one.
AIR = os.environ.get("AIRQUALITY_CSV", "")


def patterned(spark, rows=400, p=5, gone=0.35, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, p)) @ rng.normal(size=(p, p)) + rng.normal(size=p) * 5
    hidden = rng.random(x.shape) < gone
    hidden[0], hidden[1] = False, True
    data = [tuple(None if h else float(v) for v, h in zip(r, g, strict=True)) for r, g in zip(x, hidden, strict=True)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` double" for n in ("id", "x", "chain", "n", "mask")[:p])), x, hidden


def naive_em(x, hidden, steps=500, tol=1e-9):
    """Row by row, from the definition."""
    n, p = x.shape
    seen = ~hidden
    mu = np.array([x[seen[:, j], j].mean() for j in range(p)])
    z = np.where(seen, x - mu, 0.0)
    sigma = z.T @ z / n
    for _ in range(steps):
        first, second = np.zeros(p), np.zeros((p, p))
        for row, o in zip(x, seen, strict=True):
            y, extra = mu.copy(), np.zeros((p, p))
            if o.any():
                b = sigma[np.ix_(~o, o)] @ np.linalg.inv(sigma[np.ix_(o, o)] + 1e-8 * np.eye(o.sum()))
                y[o], y[~o] = row[o], mu[~o] + b @ (row[o] - mu[o])
                extra[np.ix_(~o, ~o)] = sigma[np.ix_(~o, ~o)] - b @ sigma[np.ix_(o, ~o)]
            else:
                extra = sigma.copy()
            first += y
            second += np.outer(y, y) + extra
        new = first / n, second / n - np.outer(first / n, first / n)
        moved = max(np.abs(new[0] - mu).max(), np.abs(new[1] - sigma).max())
        mu, sigma = new
        if moved < tol:
            break
    return mu, sigma


@pytest.mark.parametrize("where", ["driver", "executors"])
def test_moments_and_statistic_against_rows(spark, monkeypatch, where):
    df, x, hidden = patterned(spark)
    if where == "executors":
        monkeypatch.setattr(mcar, "DRIVER_BYTES", 1000)
        monkeypatch.setattr(mcar, "HELD_BYTES", 2000)
        monkeypatch.setattr(mcar, "TASKS", 3)
    held = []
    spread = mcar._Spread.__init__
    monkeypatch.setattr(mcar._Spread, "__init__", lambda self, *a: (held.append(1), spread(self, *a))[1])
    got = mcar.mcar_test(df.repartition(5), tol=1e-9).first()
    assert bool(held) == (where == "executors")
    mu, sigma = naive_em(x, hidden)
    patterns = np.unique(~hidden, axis=0)
    chi = 0.0
    for o in patterns:
        mine = x[((~hidden) == o).all(axis=1)][:, o]
        if o.any():
            d = mine.mean(axis=0) - mu[o]
            chi += len(mine) * d @ np.linalg.inv(sigma[np.ix_(o, o)] + 1e-8 * np.eye(o.sum())) @ d
    assert got.chi_square == pytest.approx(chi, rel=1e-5)
    assert (got.df, got.missing_patterns, got.amount_missing) == (patterns.sum() - 5, len(patterns), hidden.sum())


@pytest.mark.skipif(not os.path.exists(AIR), reason="AIRQUALITY_CSV names no table")
@pytest.mark.parametrize("limit", [32 << 20, 1])
def test_published_values(spark, monkeypatch, limit):
    monkeypatch.setattr(mcar, "DRIVER_BYTES", limit)
    monkeypatch.setattr(mcar, "TASKS", 2)
    with open(AIR, encoding="utf-8") as file:
        names, *rows = list(csv.reader(file))
    data = [tuple(None if v == "NA" or not v else float(v) for v in r[1:]) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"`{n}` double" for n in names[1:]))
    got = mcar.mcar_test(df).first()
    # Fixed values of the published test on this table.
    assert got.chi_square == pytest.approx(35.1061288689702, abs=1e-4) and got.p_value == pytest.approx(0.00141778113856683, abs=1e-7)
    assert (got.df, got.missing_patterns) == (14, 4)
    empty = df.unionAll(spark.createDataFrame([(None,) * 6], df.schema))
    more = mcar.mcar_test(empty).first()
    assert more.chi_square == pytest.approx(35.1061229683641, abs=1e-4) and more.missing_patterns == 5


def test_many_columns_don_t_grow_the_plan(spark):
    df = spark.range(300).select(*[F.when(F.xxhash64("id", F.lit(k)) % 9 > 0, F.xxhash64("id", F.lit(-k - 1)) % 1000 / 100).alias(f"c{k}") for k in range(60)])
    got = mcar.pattern_moments(df, df.columns, [0.0] * 60)
    assert sum(t[1] for t in got) == 300 and got[0][3].shape == (60, 60)
