"""Splines of orders 1 to 5: exact on polynomials, equal to a dense solution, in blocks of bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapwise
from gapwise.operators import splines
from gapwise.plans.ordered import with_position


def dense(x, y, order, at):
    """The interpolating spline by another basis, truncated powers, and a dense system."""
    inner = x[(order + 1) // 2 : len(x) - (order + 1) // 2] if order % 2 else ((x[1:] + x[:-1]) / 2)[order // 2 : len(x) - 1 - order // 2]
    scale = x[-1] - x[0]
    rows = lambda z: np.concatenate([((z[:, None] - x[0]) / scale) ** np.arange(order + 1), np.maximum((z[:, None] - inner) / scale, 0) ** order], axis=1)
    return rows(at) @ np.linalg.solve(rows(x), y)


def evaluate(x, y, order, at):
    low, cut, high = splines.pieces(x, y, order)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 1)
    u = at - x[k]
    first = sum(low[k, d] * u**d for d in range(low.shape[1]))
    if high is None:
        return first
    return np.where(u < cut[k], first, sum(high[k, d] * (u - cut[k]) ** d for d in range(high.shape[1])))


@pytest.mark.parametrize("order", splines.ORDERS)
def test_pieces_are_the_interpolating_spline(order):
    rng = np.random.default_rng(order)
    x = np.sort(rng.choice(40, 14, replace=False)).astype(float)
    y, at = rng.normal(size=14), np.arange(x[0], x[-1] + 3, 0.5)
    assert np.allclose(evaluate(x, y, order, at), dense(x, y, order, at), atol=1e-6)
    assert np.allclose(evaluate(x, y, order, x), y, atol=1e-9)


@pytest.mark.parametrize("order", splines.ORDERS)
def test_exact_on_polynomials_of_its_order(spark, order):
    seen = {2, 3, 7, 8, 11, 15, 16, 20, 23}
    rows = [(s, i, float(f * i**order - i) if i in seen else None, None if i % 2 else 1) for s, f in (("a", 1), (None, -2)) for i in range(28)]
    rows += [("few", i, float(i) if i in (1, 4) else None, None) for i in range(6)] + [("one", 0, None, 5), ("one", 1, 3.0, None)]
    df = spark.createDataFrame(rows, "s string, i int, v double, `__w` int")
    got = {(r.s, r.i): r for r in gapwise.impute_ts(df, ["i"], "spline", partition_by=["s"], spline_order=order, columns=["v"]).collect()}
    for s, f in (("a", 1), (None, -2)):
        for i in range(28):
            want = None if i < 2 else f * i**order - i
            assert got[s, i].v == (want if want is None else pytest.approx(want, rel=1e-9, abs=1e-6))
    assert [got["few", i].v for i in range(6)] == [None, *[pytest.approx(i, abs=1e-9) for i in range(1, 6)]]
    assert got["one", 0].v is None and got["one", 1].v == 3.0 and len(got) == len(rows)


def test_several_columns_limit_and_sentinels(spark):
    rows = [(i, float(i * i) if i % 4 else None, i if i % 3 == 0 else -9, "x" if i == 0 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, a double, b bigint, t string")
    got = gapwise.impute_ts(df, ["i"], "spline", spline_order=2, limit=1, missing_values=[-9]).orderBy("i").collect()
    assert [r.a for r in got] == [None if i == 0 else pytest.approx(i * i, abs=1e-8) for i in range(40)]
    assert [r.b for r in got] == [pytest.approx(i, abs=1e-8) if i % 3 < 2 else None for i in range(40)]
    assert {r.t for r in got[:2]} == {"x"} and got[2].t is None
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.impute_ts(df, ["i"], "spline", spline_order=6)


@pytest.mark.parametrize("order", splines.ORDERS)
def test_blocks_give_what_the_whole_gives(spark, monkeypatch, order):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=900))
    y[rng.random(900) < 0.3] = np.nan
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)], "i bigint, v double")
    x, ok = np.arange(900.0), ~np.isnan(y)
    want = np.where(ok, y, np.where(x > x[ok][0], evaluate(x[ok], y[ok], order, x), np.nan))
    monkeypatch.setattr(splines, "BLOCK", 150)
    got = [r.v for r in gapwise.impute_ts(df, ["i"], "spline", spline_order=order).orderBy("i").collect()]
    assert np.allclose(np.array(got, dtype=float), want, rtol=0, atol=1e-7, equal_nan=True)


def test_blocks_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(splines, "BLOCK", 300)
    df = spark.range(200_000).select(F.col("id").alias("i"), F.when(F.col("id") % 100 == 0, F.col("id").cast("double")).alias("v"))
    placed = with_position(df, ["i"], (), {"__seen_0": F.col("v").isNotNull().cast("bigint")})
    sizes = [r["count"] for r in splines.blocks(placed, ["v"], ()).groupBy("__block").count().collect()]
    assert max(sizes) <= 300 + 2 * splines.HALO and len(sizes) >= 7
    assert gapwise.impute_ts(df, ["i"], "spline").where("abs(v - i) > 1e-6 or v is null").isEmpty()


def test_empty_and_all_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "i int, v double")
    assert [r.v for r in gapwise.impute_ts(df, ["i"], "spline").collect()] == [None, None]
    assert gapwise.impute_ts(df.limit(0), ["i"], "spline").count() == 0
