"""Donors of nearest score: against all pairs, by chain, and with scores that many rows share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapwise
from gapwise.operators import models


def brute(asked, donors, k):
    return {i: [d for *_, d in sorted((abs(s - t), t, d) for d, t in donors)[:k]] for i, s in asked}


@pytest.mark.parametrize("k", [1, 3, 9])
def test_nearest_are_those_of_all_pairs(spark, k):
    rng = np.random.default_rng(k)
    asked = [(i, float(s)) for i, s in enumerate(np.r_[rng.normal(size=40), np.zeros(60), rng.integers(-2, 3, 50)])]
    donors = [(1000 + i, float(s)) for i, s in enumerate(np.r_[rng.normal(size=30), np.zeros(20), rng.integers(-2, 3, 30)])]
    a, d = spark.createDataFrame(asked, "id int, score double"), spark.createDataFrame([(*r, r[1] * 2) for r in donors], "donor int, score double, value double")
    got = {}
    for r in models.nearest_scores(a, d, k).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.donor)
        assert r.value == dict(donors)[r.donor] * 2
    assert got == brute(asked, donors, k)


def test_fewer_donors_than_asked_for_and_none(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "id string, score double")
    d = spark.createDataFrame([("p", 0.0, 5.0), ("q", 4.0, 6.0)], "donor string, score double, value double")
    assert sorted((r.id, r.donor, r["rank"]) for r in models.nearest_scores(a, d, 5).collect()) == [("x", "p", 1), ("x", "q", 2), ("y", "p", 1), ("y", "q", 2)]
    assert {r.value for r in models.donor_values(a, d, 5, F.lit(0.99), F.lit(0.0)).collect()} == {6.0}
    assert models.nearest_scores(a, d.limit(0), 2).count() == 0 and models.nearest_scores(a.limit(0), d, 2).count() == 0


def test_chains_keep_to_their_own_donors(spark):
    a = spark.createDataFrame([(c, i, 0.1 * i) for c in range(3) for i in range(10)], "chain int, id int, score double")
    d = spark.createDataFrame([(c, 100 + i, float(i % 4), float(c)) for c in range(3) for i in range(12)], "chain int, donor int, score double, value double")
    got = models.nearest_scores(a, d, 2, ["chain"]).collect()
    assert len(got) == 60 and all(r.value == r.chain for r in got)
    for c in range(3):
        want = brute([(i, 0.1 * i) for i in range(10)], [(100 + i, float(i % 4)) for i in range(12)], 2)
        assert all(r.donor == want[r.id][r["rank"] - 1] for r in got if r.chain == c)


def test_draws_take_the_nearest_and_spread_over_ties(spark):
    rng = np.random.default_rng(7)
    asked = [(i, float(s)) for i, s in enumerate(rng.integers(-3, 4, 400) / 2)]
    donors = [(1000 + i, float(s)) for i, s in enumerate(rng.integers(-2, 3, 60))]
    a = spark.createDataFrame([(*r, (i % 20) / 20, (i % 7) / 7) for i, r in enumerate(asked)], "id int, score double, u double, v double")
    d = spark.createDataFrame([(*r, float(r[0])) for r in donors], "donor int, score double, value double")
    for k in (1, 5, 30):
        got = {r.id: int(r.value) for r in models.donor_values(a, d, k, F.col("u"), F.col("v")).collect()}
        for n, (i, s) in enumerate(asked):
            line = sorted((abs(s - t), t, m) for m, t in donors)
            rank = int((n % 20) / 20 * min(k, 60))
            tied = [m for dist, t, m in line if (dist, t) == line[rank][:2]]
            whole = sum((dist, t) <= line[rank][:2] for dist, t, _ in line) <= k
            assert got[i] == (line[rank][2] if whole else tied[int((n % 7) / 7 * len(tied))])
    assert len({m for i, m in got.items() if asked[i][1] == 0}) > 5


def test_one_score_for_all_rows_keeps_tasks_even(spark):
    """300,000 recipients of one score: looked up once, and neither its list nor a donor gathers them in one task."""
    n = 300_000
    a = spark.range(n).select("id", F.lit(2.5).alias("score"))
    d = spark.range(n).select(F.col("id").alias("donor"), F.lit(2.0).alias("score"), F.col("id").cast("double").alias("value"))
    out = models.donor_values(a, d, 4, F.lit(0.5), F.rand(1))
    # Partitions of this size would be merged, and tables of this size be broadcast.
    asked_for = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in asked_for.items():
        spark.conf.set(key, value)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    for key in asked_for:
        spark.conf.unset(key)
    assert sum(sizes) == n and max(sizes) < n / 2
    assert out.select("value").distinct().count() > n / 2
    df = spark.range(4000).select("id", F.lit(1.0).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("y"))
    assert gapwise.impute_pmm(df, "id", 1).where("y is null").count() == 0


def test_donors_are_read_a_few_times(spark):
    """However often the search comes back to the donors: their cuts, their ranges and their rows."""
    seen, n = spark.sparkContext.accumulator(0), 200

    def counted(v):
        seen.add(1)
        return float(v % 50)

    donors = spark.range(n).select(F.col("id").alias("donor"), F.udf(counted, "double")("id").alias("score"), F.col("id").cast("double").alias("value"))
    asked = spark.range(60).select("id", (F.col("id") + 0.3).cast("double").alias("score"))
    got = {r.id: r.value for r in models.donor_values(asked, donors, 3, F.lit(0.0), F.lit(0.0)).collect()}
    assert got == {i: float(min(i, 49)) for i in range(60)}
    assert seen.value <= 4 * n
