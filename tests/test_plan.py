"""Chained equations by plan: mixed methods, seeds, bounds, passive terms and kernels of users."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapwise


def frame(spark, n=240):
    rng = np.random.default_rng(3)
    a = rng.normal(10, 2, n)
    b = 3 * a + rng.normal(size=n)
    side = np.where(a + rng.normal(size=n) > 10, "up", "down")
    kind = np.where(b > 33, "3", np.where(b > 27, "2", "1"))
    level = rng.permutation(np.where(a > 11, "3", np.where(a > 9, "2", "1")))
    rows = []
    for i in range(n):
        gone = [i % 5 == 0, i % 7 == 1, i % 6 == 2, i % 8 == 3, i % 8 == 4]
        values = [float(a[i]), float(b[i]), str(side[i]), str(kind[i]), str(level[i])]
        rows.append((f"k{i:04d}", *[None if g else v for g, v in zip(gone, values, strict=True)], 1.0))
    return spark.createDataFrame(rows, "id string, a double, b double, side string, kind string, rank string, v0 double")


METHODS = {"a": "norm", "b": "pmm", "side": "logreg", "kind": "polyreg", "rank": "polr"}


def test_mixed_plan_fills_all_chains_and_repeats(spark):
    d = frame(spark)
    plan = gapwise.ImputationPlan(METHODS, 2, 1, (7, 8), {"a": (9.0, 11.0)})
    result = gapwise.impute_plan(d, "id", plan)
    done = result.data.completed
    rows = done.orderBy("chain", "id").collect()
    assert result.validated and len(rows) == 480 and done.columns == ["chain", *d.columns]
    gone = {r.id for r in d.where("a is null").collect()}
    assert all(9 <= r.a <= 11 for r in rows if r.id in gone) and len({r.a for r in rows if r.id in gone}) > 10
    assert {r.side for r in rows} == {"up", "down"} and {r.kind for r in rows} == {"1", "2", "3"}
    assert {r.b for r in rows} <= {r.b for r in d.collect()}
    traces = result.histories.collect()
    assert {(r.chain, r.iter, r.variable) for r in traces} == {(c, i, v) for c in (0, 1) for i in (0,) for v in METHODS}
    assert [r for r in rows if r.chain == 0] != [r for r in rows if r.chain == 1]
    # One chain alone with the seed of the second one, on other partitions: the seed decides, not the chain's place.
    alone = gapwise.impute_plan(d.repartition(5), "id", gapwise.ImputationPlan({"a": "norm", "b": "norm", "side": "mode", "kind": "mode", "rank": "mode"}, 1, 1, (8,)))
    other = gapwise.impute_plan(d, "id", gapwise.ImputationPlan({"a": "norm", "b": "norm", "side": "mode", "kind": "mode", "rank": "mode"}, 2, 1, (7, 8)))
    second = [(r.a, r.b) for r in other.data.completed.where("chain = 1").orderBy("id").collect()]
    assert np.allclose([(r.a, r.b) for r in alone.data.completed.orderBy("id").collect()], second)


def test_drawn_values_follow_the_model(spark):
    d = frame(spark, 400)
    plan = gapwise.ImputationPlan({**METHODS, "rank": "mode"}, 1, 2, (1,))
    full = {r.id: r for r in gapwise.impute_plan(d, "id", plan).data.completed.collect()}
    gone = [r.id for r in d.where("a is null").collect()]
    a, b = np.array([full[i].a for i in gone]), np.array([full[i].b for i in gone])
    assert np.corrcoef(a, b)[0, 1] > 0.8
    kinds = [(full[r.id].kind, full[r.id].b) for r in d.where("kind is null and b is not null").collect()]
    assert np.mean([k == ("3" if v > 33 else "2" if v > 27 else "1") for k, v in kinds]) > 0.8


class Constant:
    """A kernel that reads the frame and the seed."""

    def impute(self, state, target, mask, seed):
        assert {"id", "a", "b", "kind"} <= set(state.columns)
        return F.when(F.col("kind") == "1", F.lit(float(seed))).otherwise(F.col("a") * 2)


class Level:
    def impute(self, state, target, mask, seed):
        return F.lit("up")


def test_kernels_and_passive_terms(spark):
    d = frame(spark).drop("rank")
    plan = gapwise.ImputationPlan({"a": "mean", "kind": "mode", "side": "level", "b": "own"}, 2, 1, (40, 50))
    got = gapwise.impute_plan(d, "id", plan, {"own": Constant(), "level": Level()}).data.completed
    given = {r.id: r for r in d.collect()}
    mean = np.mean([r.a for r in given.values() if r.a is not None])
    for r in got.collect():
        if given[r.id].side is None:
            assert r.side == "up"
        if given[r.id].b is None:
            assert r.b == pytest.approx((40, 50)[r.chain] if r.kind == "1" else 2 * r.a)
        if given[r.id].a is None:
            assert r.a == pytest.approx(mean)
    plan = gapwise.ImputationPlan({"a": "median", "b": "passive", "kind": "mode", "side": "mode"}, 1, 2, (), {"b": "a * 3 + length(side)"})
    for r in gapwise.impute_plan(d, "id", plan).data.completed.collect():
        assert given[r.id].b is not None or r.b == pytest.approx(3 * r.a + len(r.side))


def test_plans_that_cannot_be_carried_out(spark):
    d = frame(spark, 30)
    run = lambda methods, **more: gapwise.impute_plan(d, "id", gapwise.ImputationPlan({**METHODS, **methods}, 1, 1, (), **more))
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.impute_plan(d, "id", gapwise.ImputationPlan({"a": "norm"}, 1, 1))
    with pytest.raises(gapwise.InvalidStrategyError):
        run({"a": "nothing"})
    for bad in ({"a": "polyreg"}, {"kind": "pmm"}, {"a": "passive"}):
        with pytest.raises(gapwise.ConfigurationError):
            run(bad)
    for limits in ({"a": (2, 1)}, {"kind": (1, 2)}, {"a": "a + 1"}):
        with pytest.raises(gapwise.ConfigurationError):
            run({}, constraints=limits)
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.impute_plan(d.withColumn("chain", F.lit(1)), "id", gapwise.ImputationPlan(METHODS, 1, 1))
    with pytest.warns(UserWarning, match="doesn't fit 2 levels"):
        assert gapwise.impute_plan(d, "id", gapwise.ImputationPlan({**METHODS, "side": "polyreg"}, 1, 1)).warnings
    assert gapwise.impute_plan(d.limit(0), "id", gapwise.ImputationPlan(METHODS, 2, 1)).data.completed.count() == 0
    whole = d.dropna()
    assert gapwise.impute_plan(whole, "id", gapwise.ImputationPlan({"a": "norm"}, 2, 1)).data.completed.count() == 2 * whole.count()
