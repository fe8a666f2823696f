"""Comparison of imputers: which cells are masked, and what the figures say."""

import math

import pytest
from pyspark.sql import functions as F

from gapwise.functions.draws import uniform
from gapwise.operators import simulate
from gapwise.operators.compare import compare_imputations


@pytest.mark.parametrize("twice", [False, True])
def test_masks_are_the_least_draws_and_need_no_order(spark, monkeypatch, twice):
    df = spark.range(300).select("id", (F.col("id") * 37 % 101).cast("double").alias("v"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("kind"))
    if not twice:  # keys that differ have draws that differ, so that a threshold tells who goes
        monkeypatch.setattr(simulate, "with_position", None)
    drawn = df.select("*", *[uniform(42, f"compare/{c}", F.col("id")).alias(f"u_{c}") for c in ("v", "kind")]).collect()
    gone = {c: {r.id for r in sorted(drawn, key=lambda r, c=c: r[f"u_{c}"])[:60]} for c in ("v", "kind")}
    mean = sum(r.v for r in drawn if r.id not in gone["v"]) / 240
    if twice:  # masks of rows with a shared key; the mean fill and its error then hang on the place of ties alone
        df = df.unionByName(df)
    rows = {r.method: r for r in compare_imputations(df, "id", ["mean", "mode"]).collect()}
    assert all(r.error is None for r in rows.values())
    if not twice:
        assert rows["mean"].rmse == pytest.approx(math.sqrt(sum((r.v - mean) ** 2 for r in drawn if r.id in gone["v"]) / 60))
        assert rows["mean"].accuracy == pytest.approx(sum(r.kind == "a" for r in drawn if r.id in gone["kind"]) / 60)
