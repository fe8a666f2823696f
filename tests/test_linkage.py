"""Ward clustering in rounds against a dense matrix, on the driver and on the executors, and the order of columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapwise
from gapwise.operators import patterns
from gapwise.plans import linkage


def dense(x, w):
    """Heights and the sets that each merge unites, by the matrix of all distances."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)) * np.sqrt(2 * w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    sets, out = {i: frozenset([i]) for i in range(len(x))}, {}
    for k, (a, b, h, _) in enumerate(patterns.linkage(d, w, "ward")):
        sets[len(x) + k] = sets.pop(a) | sets.pop(b)
        out[sets[len(x) + k]] = h
    return out


def rounds(spark, x, w):
    sets, out = {i: frozenset([i]) for i in range(len(x))}, {}
    for a, b, h in linkage.ward(spark, x, w):
        assert a < b
        sets[a] = sets[a] | sets.pop(b)
        out[sets[a]] = h
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 150])
@pytest.mark.parametrize("far", [False, True])
def test_merges_are_those_of_the_dense_matrix(spark, monkeypatch, n, far):
    if far and n not in (3, 40):
        pytest.skip("a job per round")
    monkeypatch.setattr(linkage, "LOCAL_PAIRS", 0 if far else 1 << 22)
    monkeypatch.setattr(linkage, "BLOCK_BYTES", 8 * 6 * 17 if far else 32 << 20)
    rng = np.random.default_rng(n)
    x, w = (rng.normal(size=(n, 6)) > 0.3) + rng.normal(size=(n, 6)) * 0.01, rng.integers(1, 50, n).astype(float)
    got, want = rounds(spark, x, w), dense(x, w)
    assert set(got) == set(want)
    assert all(got[s] == pytest.approx(h, rel=1e-6, abs=1e-9) for s, h in want.items())


def test_ties_of_indicators_end_in_one_tree(spark):
    x = np.array([[i >> k & 1 for k in range(6)] for i in range(64)], dtype=float)
    merges = linkage.ward(spark, x, np.ones(64))
    assert len(merges) == 63 and sorted(linkage.leaf_order(64, merges)) == list(range(64))
    assert merges[0] == (0, 1, 1.0)
    # Squared Ward heights add up to twice the scatter around the mean.
    assert sum(h * h for *_, h in merges) == pytest.approx(2 * ((x - x.mean(axis=0)) ** 2).sum())


def test_rows_and_columns_stand_in_the_order_of_their_trees(spark):
    rows = [(None, 1, None, 1)] * 30 + [(1, None, 1, None)] * 20 + [(None, 1, None, None)] * 3 + [(1, 1, 1, 1)] * 9
    d = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = patterns.miss_cluster(d)
    order = got.columns[:4]
    assert got.columns[4:] == ["n", "place"] and {frozenset(order[:2]), frozenset(order[2:])} == {frozenset("ac"), frozenset("bd")}
    placed = got.orderBy("place").collect()
    assert [r.place for r in placed] == [0, 1, 2, 3] and sum(r.n for r in placed) == 62
    # The rows that miss a and c stand together.
    at = [r.place for r in placed if r.a]
    assert abs(at[0] - at[1]) == 1
    assert gapwise.vis_miss(d, cluster=True).columns == ["a", "b", "c", "d", "n", "place"]
    same = patterns.miss_cluster(d.repartition(5)).orderBy("place").collect()
    assert same == placed
    assert patterns.miss_cluster(d.limit(0)).count() == 0
    with pytest.raises(gapwise.InvalidStrategyError):
        patterns.miss_cluster(d, method="average")


def test_thousands_of_patterns_in_jobs(spark):
    """Each of 4,096 patterns has a place; more pairs than the driver takes."""
    d = spark.range(20_000).select(*[F.when(F.shiftright(F.xxhash64("id"), k) % 2 == 0, F.col("id")).alias(f"c{k}") for k in range(12)])
    got = patterns.miss_cluster(d)
    n = d.select([F.col(c).isNull() for c in d.columns]).distinct().count()
    assert n * n > linkage.LOCAL_PAIRS and got.agg(F.countDistinct("place"), F.min("place"), F.max("place"), F.sum("n")).first()[:] == (n, 0, n - 1, 20_000)
