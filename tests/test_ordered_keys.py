"""Ordered operators and model imputers: text, decimal and composite keys, ties in the first key, names that the plans use."""

import pytest
from pyspark.sql import functions as F

import gapwise
from gapwise.operators import donors, models, timeseries
from gapwise.plans import ordered

KINDS = {
    "string": "format_string('k%06d', id)",
    "decimal(12,3)": "cast(id / 8 as decimal(12,3))",
    "date": "date_add(DATE'2001-01-01', cast(id as int))",
    "timestamp": "timestamp_seconds(id * 61)",
    "timestamp_ntz": "cast(timestamp_seconds(id * 61) as timestamp_ntz)",
    "double": "id * 0.5",
}


def series(spark, key, n=500):
    gone = F.xxhash64("id", F.lit(5)) % 3 == 0
    return spark.range(n).select(F.expr(key).alias("key"), F.lit(7).alias("same"), "id", F.when(~gone, F.col("id").cast("double")).alias("v"), F.when(~gone, F.concat(F.lit("t"), "id")).alias("x")).repartition(7)


@pytest.mark.parametrize("kind", KINDS)
def test_any_type_of_key(spark, kind):
    d = series(spark, KINDS[kind])
    ranges = ordered.with_range(d, ["key"])
    bounds = sorted((r["__range"], r.low, r.high, r.n) for r in ranges.groupBy("__range").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).collect())
    assert len(bounds) == 4 and all(a[2] < b[1] for a, b in zip(bounds, bounds[1:])) and max(b[3] for b in bounds) < 250
    wanted = {tuple(r)[1:] for r in timeseries.gap_table(d, ["id"], columns=["v"]).select("column", "gap_id", "length").collect()}
    assert {tuple(r)[1:] for r in timeseries.gap_table(d, ["key"], columns=["v"]).select("column", "gap_id", "length").collect()} == wanted
    filled = lambda by: {(r.id, r.v, r.x) for r in timeseries.impute_ts(d, by, "linear", columns=["v", "x"]).collect()}
    assert filled(["key"]) == filled(["id"]) == filled(["same", "key"])


def test_a_tied_first_key_is_cut_up(spark):
    sizes = [r["count"] for r in ordered.with_range(series(spark, "id"), ["same", "key"]).groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 250
    everywhere = ordered.with_position(series(spark, "id").select("same"), ["same"])
    assert sorted(r["__pos"] for r in everywhere.collect()) == list(range(1, 501))


def test_nulls_come_first(spark):
    d = series(spark, "if(id % 5 = 0, null, id)")
    placed = ordered.with_position(d, ["key", "id"]).collect()
    order = sorted(placed, key=lambda r: r["__pos"])
    assert [r.id for r in order] == [*range(0, 500, 5), *[i for i in range(500) if i % 5]]


def test_the_plan_does_not_grow_with_the_ranges(spark):
    d, sizes = series(spark, "id"), []
    for n in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sizes.append(ordered.with_range(d, ["key"])._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[0] == sizes[1]


def test_text_keys_of_random_hotdeck_and_sorting(spark):
    d = series(spark, KINDS["string"]).select("key", "id", "v", "x")
    out = donors.impute_hotdeck_random(d, "key")
    assert out.where("v is null or x is null").isEmpty() and out.count() == 500
    assert timeseries.is_sorted(d, "id", "key") and not timeseries.is_sorted(d, "key", "v") is None
    assert not timeseries.is_sorted(d.withColumn("key", F.reverse("key")), "id", "key")


def test_imputers_on_names_that_plans_use(spark):
    names = ["chain", "x", "rid", "pos"]
    d = spark.range(90).select(F.format_string("k%03d", "id").alias("id"), *[F.when((F.col("id") + k) % 7 > 0, (F.col("id") * (k + 2)) % 11 + 0.5).alias(n) for k, n in enumerate(names)])
    for made in (models.impute_mice(d, "id", max_iter=1), models.impute_pmm(d, "id", max_iter=1), gapwise.impute_rf(d, "id", numTrees=2)):
        rows = made.collect()
        assert made.columns == d.columns and len(rows) == 90 and all(v is not None for r in rows for v in r)
