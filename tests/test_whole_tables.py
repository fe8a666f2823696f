"""Queries read their whole tables, and operators keep all they are given."""

import os

import pytest
from pyspark.sql import functions as F

from gapwise.operators import mi, models, patterns
from gapwise.queries import statistics
from support import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture()
def many(spark, tmp_path):
    """A customer table of more rows than any former cut."""
    rows = [(i, i % 25, float(i % 900), ("BUILDING", "MACHINERY", "FURNITURE")[i % 3]) for i in range(1, 1301)]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_estimators_and_comparison_take_all_customers(spark, many, monkeypatch):
    seen = []
    monkeypatch.setattr(statistics, "invariants", lambda done, given, row_id: seen.append(given.count()) or given)
    assert statistics.QUERIES["estimator_mean"](spark, many).count() == 650
    statistics.QUERIES["estimator_hotdeck"](spark, many)
    assert seen == [650]
    whole = statistics.compare.compare_imputations
    monkeypatch.setattr(statistics.compare, "compare_imputations", lambda d, *a: seen.append(d.count()) or whole(d, *a))
    statistics.QUERIES["compare_imputations"](spark, many)
    assert seen[-1] == 1300


def test_clustering_keeps_the_rare_patterns(spark):
    d = spark.range(400).select(*[F.when(F.col("id") % k > 0, F.col("id")).alias(f"c{k}") for k in (2, 3, 5, 7)])
    whole = {tuple(r)[:5] for r in patterns.miss_cluster(d).collect()}
    rows = sorted(patterns.miss_cluster(d, max_patterns=5).collect(), key=lambda r: r.place)
    assert len(whole) == 16 and {tuple(r)[:5] for r in rows} == whole
    assert [r.place for r in rows] == list(range(16)) and [r.n for r in rows[5:]] == sorted((r.n for r in rows[5:]), reverse=True)
    assert min(r.n for r in rows[:5]) >= rows[5].n
    assert patterns.miss_cluster(d, max_patterns=16).count() == 16


def test_chain_models_are_partial_aggregates(spark):
    plan = statistics.QUERIES["mi_with"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "partial_count" in plan
    d = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "chain bigint, x double")
    assert sorted(map(tuple, mi.mi_with(d, lambda chains: chains.agg(F.avg("x"))).collect())) == [(0, 2.0), (1, 5.0)]


def test_log_likelihood_comes_from_its_operator(spark, monkeypatch):
    monkeypatch.setattr(models, "logistic_log_likelihood", lambda *_: 4.25)
    assert statistics.QUERIES["logistic_log_likelihood"](spark, SF).first().ll == 4.25
