"""Order statistics and modes against plain Python, with bins of every awkward kind of value."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import gapwise
from gapwise.operators import fill, simulate
from gapwise.plans import selection

INF = float("inf")
COLUMNS = {
    "same": [2.5] * 90,
    "two": [1.0, 3.0] * 45,
    "wide": [random.Random(1).uniform(-1, 1) * 10 ** random.Random(k).randrange(-300, 300) for k in range(90)],
    "infinite": [INF, -INF, 0.0, 1.7976931348623157e308, -1.7976931348623157e308] * 18,
    "tiny": [5e-324 * k for k in range(90)],
    "whole": [float(2**53 + k) for k in range(90)],
    "gone": [None] * 30 + [math.nan] * 30 + [float(k) for k in range(30)],
    "one": [None] * 89 + [7.0],
    "none": [None] * 90,
}


@pytest.mark.parametrize(("bins", "few"), [(4096, 4096), (512, 1), (16, 5)])
def test_order_statistics(spark, monkeypatch, bins, few):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FEW", few)
    # Values over hundreds of orders of magnitude take a scan for each factor of ``bins``.
    columns = COLUMNS if bins > 16 else {c: v for c, v in COLUMNS.items() if c not in ("wide", "infinite")}
    columns = columns if bins > 512 else {c: v for c, v in columns.items() if c != "wide"}
    rows = list(zip(*columns.values(), strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    ranks = [0, 1, 17, 44, 45, 88, 89, 90]
    found = selection.order_statistics(df, {c: (F.col(c), ranks) for c in columns})
    for c, values in columns.items():
        order = sorted(v for v in values if v is not None and not math.isnan(v))
        want = {k: (order[k], sum(v < order[k] for v in order), order.count(order[k])) for k in ranks if k < len(order)}
        assert found[c] == want, c


def test_medians_are_those_of_spark(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 600):
        df = spark.createDataFrame([(rng.randrange(40), rng.random() if rng.random() < 0.9 else None) for _ in range(n)] + [(None, 0.5)], "a int, b double")
        want = df.agg(F.median("a"), F.median("b")).first()
        got = fill.fill_values(df, "median", ["a", "b"])
        assert (got["a"], got["b"]) == (want[0], want[1])


def test_modes_of_any_type(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["b", "a", "c", None]), rng.randrange(4), rng.random() < 0.5, float(rng.randrange(3)), f"text {k}") for k in range(301)]
    df = spark.createDataFrame(rows, "t string, n int, f boolean, d double, u string").withColumn("day", F.expr("date_add(DATE'2024-01-01', n)")).withColumn("m", F.col("n").cast("decimal(9,2)"))
    got = fill.fill_values(df, "mode", df.columns)
    for i, c in enumerate(df.columns[:5]):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        assert got[c] == min(v for v, n in counts.items() if n == max(counts.values()))
    assert got["u"] == "text 0" and str(got["m"]) == f"{got['n']}.00" and got["day"].day == 1 + got["n"]
    plan = str(gapwise.impute_mode(df)._jdf.queryExecution().executedPlan())
    assert "mode(" not in plan and "percentile" not in plan


def test_exact_simulation_with_repeated_keys(spark):
    df = spark.range(200).select((F.col("id") % 40).alias("id"), F.col("id").cast("double").alias("v"), (F.col("id") + 1).alias("w"), F.lit(None).cast("double").alias("x"))
    out = simulate.simulate_mcar(df, "id", 0.23, columns=["v", "w", "x"], require_complete=False)
    assert out.where("v is null").count() == 46 and out.where("w is null").count() == 46 and out.count() == 200
    assert df.exceptAll(out.withColumn("w", F.lit(0))).count() >= 46
