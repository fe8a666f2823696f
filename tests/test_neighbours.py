"""The neighbour search: all neighbours of the plain search, few of its pairs, any key and any column name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.operators import donors
from gapwise.plans import neighbours
from gapwise.plans.neighbours import Euclidean, Gower, nearest

SCHEMA = "__id bigint, __x array<double>"


def frame(spark, x, ids=None, schema=SCHEMA):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, list(map(float, row))) for i, row in zip(ids, x, strict=True)], schema).repartition(4)


def plainly(a, ids_a, b, ids_b, k, metric, exclude_self):
    d = metric.between(a, b)
    out = set()
    for i, row in zip(ids_a, d, strict=True):
        own = sorted((v, j) for v, j in zip(row, ids_b, strict=True) if not np.isnan(v) and not (exclude_self and i == j))
        out |= {(i, j, round(v, 9), r) for r, (v, j) in enumerate(own[:k], 1)}
    return out


def found(df):
    return {(r["__rid"], r["__did"], round(r["__dist"], 9), r["__rank"]) for r in df.collect()}


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "CELLS", 1 << 12)


METRICS = [Euclidean(), Gower((3.0, 0.0, 5.0, 1.0))]


@pytest.mark.parametrize("metric", METRICS, ids=["euclidean", "gower"])
@pytest.mark.parametrize(("gone", "exclude_self"), [(0.0, True), (0.3, True), (0.8, False)])
def test_same_neighbours_as_all_pairs(spark, small, metric, gone, exclude_self):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[:, 1] = rng.integers(0, 3, 300)
    x[rng.random(x.shape) < gone] = np.nan
    x[40:90] = x[40]
    asked = np.arange(0, 300, 2)
    got = nearest(frame(spark, x[asked], asked.tolist()), frame(spark, x), 3, metric, exclude_self=exclude_self)
    assert found(got) == plainly(x[asked], asked.tolist(), x, range(300), 3, metric, exclude_self)


def test_bounds_are_below_every_distance():
    rng = np.random.default_rng(3)
    for metric in METRICS:
        a, b = rng.normal(size=(50, 4)), rng.normal(size=(80, 4))
        for x in (a, b):
            x[:, 1] = rng.integers(0, 3, len(x))
            x[rng.random(x.shape) < 0.4] = np.nan
        groups = np.array_split(np.arange(80), 9)
        with np.errstate(all="ignore"):
            low, high = (np.nan_to_num(np.array([f(b[g], axis=0) for g in groups])) for f in (np.nanmin, np.nanmax))
        seen = np.array([(~np.isnan(b[g])).sum(axis=0) for g in groups])
        boxes = neighbours.Boxes(low, high, seen == np.array([[len(g)] for g in groups]), seen > 0, np.array([len(g) for g in groups]))
        bound, d = boxes.bounds(a, metric), metric.between(a, b)
        for j, g in enumerate(groups):
            least = np.min(np.where(np.isnan(d[:, g]), np.inf, d[:, g]), axis=1)
            assert (bound[:, j] <= least + 1e-12).all()


def test_clustered_rows_meet_few_others(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(1)
    centres = rng.uniform(-100, 100, size=(80, 3))
    x = centres[rng.integers(0, 80, 4000)] + rng.normal(size=(4000, 3))
    x[rng.random(4000) < 0.1, 2] = np.nan
    asked = np.arange(0, 4000, 4)
    compared = spark.sparkContext.accumulator(0)
    got = nearest(frame(spark, x[asked], asked.tolist()), frame(spark, x), 5, Euclidean(), compared=compared, keep=lambda df: df.cache())
    assert found(got) == plainly(x[asked], asked.tolist(), x, range(4000), 5, Euclidean(), True)
    assert 0 < compared.value < len(asked) * 4000 / 10


def test_a_feature_that_recipients_miss_and_copies_cost_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.uniform(-1e4, 1e4, 3000), rng.integers(0, 25, 3000), rng.integers(0, 5, 3000)]).astype(float)
    x[::7, 2] = np.nan
    x[::11, 1] = np.nan
    asked = np.arange(0, 3000, 6)
    x[asked, 0] = np.nan
    rest = np.setdiff1d(np.arange(3000), asked)
    for metric in (Euclidean(), Gower((2e4, 24.0, 0.0))):
        compared = spark.sparkContext.accumulator(0)
        got = nearest(frame(spark, x[asked], asked.tolist()), frame(spark, x[rest], rest.tolist()), 5, metric, compared=compared, keep=lambda df: df.cache())
        assert found(got) == plainly(x[asked], asked.tolist(), x[rest], rest.tolist(), 5, metric, True)
        assert 0 < compared.value < len(asked) * len(rest) / 10


def test_more_sets_of_missing_features_than_groups(spark, small, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUPS", 2)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 4)), 1)
    x[rng.random(x.shape) < 0.5] = np.nan
    for metric in METRICS:
        assert found(nearest(frame(spark, x), frame(spark, x), 3, metric)) == plainly(x, range(200), x, range(200), 3, metric, True)


def test_many_recipients_of_one_box_are_dealt_out(spark, small):
    x = np.zeros((200, 2))
    assert found(nearest(frame(spark, x), frame(spark, x[:5]), 2, Euclidean())) == plainly(x, range(200), x[:5], range(5), 2, Euclidean(), True)


def test_few_or_no_donors(spark):
    x = np.array([[1.0, np.nan], [np.nan, 2.0], [3.0, 4.0]])
    for metric in (Euclidean(), Gower((1.0, 1.0))):
        assert found(nearest(frame(spark, x), frame(spark, x), 5, metric)) == plainly(x, range(3), x, range(3), 5, metric, True)
    assert nearest(frame(spark, x), frame(spark, x).limit(0), 2, Euclidean()).count() == 0


NAMES = ["x", "chain", "rid", "did", "pos", "rank", "dist", "a.b", "r"]


def clashing(spark, kind):
    """A frame whose columns are called like what the operators use themselves, with a key ``id`` of the given type."""
    rng = np.random.default_rng(5)
    base = spark.range(60).select(
        F.col("id").alias("i"),
        *[F.when((F.col("id") * 7 + k) % 6 > (0 if k % 4 == 0 else -1), F.round(F.col("id") * (k + 1) % 11 + F.lit(float(rng.random())), 3)).alias(n) for k, n in enumerate(NAMES[:-1])],
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("r"),
    )
    key = F.expr("date_add(DATE'2024-01-01', cast(i as int))") if kind == "date" else F.format_string("k%03d", "i") if kind == "string" else (F.col("i") / 4).cast(kind) if kind != "int" else F.col("i").cast("int")
    return base.select(key.alias("id"), *[f"`{n}`" for n in NAMES]).repartition(3)


DONOR_OPERATORS = {
    "knn": lambda d: donors.impute_knn(d, "id", 3),
    "knn mixed": lambda d: donors.impute_knn(d, "id", 3, "mixed"),
    "hotdeck weighted": lambda d: donors.impute_hotdeck_weighted(d, "id", 3),
}


@pytest.mark.parametrize(("name", "kind"), [("knn", "string"), ("knn", "decimal(12,2)"), ("knn mixed", "date"), ("hotdeck weighted", "string")])
def test_any_key_and_any_name(spark, name, kind):
    d = clashing(spark, kind)
    out = DONOR_OPERATORS[name](d)
    assert out.columns == d.columns and out.schema["id"].dataType == d.schema["id"].dataType
    rows, given = {r.id: r for r in out.collect()}, {r.id: r for r in d.collect()}
    assert rows.keys() == given.keys()
    numbered = {r.i: r for r in DONOR_OPERATORS[name](clashing(spark, "int")).withColumnRenamed("id", "i").collect()}
    for i, (key, row) in enumerate(sorted(rows.items())):
        assert all(v is not None for v in row) and all(g is None or g == v for g, v in zip(given[key], row, strict=True))
        if name != "hotdeck weighted":
            assert tuple(row)[1:] == pytest.approx(tuple(numbered[i])[1:]) if not isinstance(row[-1], str) else tuple(row)[1:-1] == pytest.approx(tuple(numbered[i])[1:-1]) and row[-1] == numbered[i][-1]


def test_gower_pairs_of_text_keys(spark):
    d = clashing(spark, "string")
    pairs = donors.gower_distance(d, "id", queries=d.where("id < 'k003'"))
    assert pairs.count() == 180 and pairs.where("id_a = id_b and distance > 0").isEmpty() and pairs.schema["id_a"].dataType.simpleString() == "string"


@pytest.mark.parametrize("shared", [1 << 25, 0])
def test_gower_pairs_shuffle_no_copies(spark, monkeypatch, shared):
    monkeypatch.setattr(donors, "SHARED_BYTES", shared)
    monkeypatch.setattr(donors, "ROWS", 20)
    d = clashing(spark, "int")
    pairs = donors.gower_distance(d, "id")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan
    columns = [c for c in d.columns if c != "id"]
    levels = donors.categories(d, ["r"])
    ids, x = zip(*[(r[0], r[1:]) for r in d.select("id", *donors.encoded(d, columns, levels)).collect()], strict=True)
    x = np.array(x, dtype=float)
    want = donors.gower(x, x, donors.gower_ranges(d, columns, levels))
    got = {(r.id_a, r.id_b): r.distance for r in pairs.collect()}
    assert len(got) == 3600 and all(got[a, b] == pytest.approx(want[i, j]) for i, a in enumerate(ids) for j, b in enumerate(ids))


def test_gower_pairs_take_little_disk(spark, tmp_path):
    d = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.hash(F.col("id") % 50) % 1000).cast("double").alias("x"), F.concat(F.lit("c"), F.hash(F.col("id") % 50, F.lit(1)) % 4).alias("c"))
    pairs = donors.gower_distance(d, "id")
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 2000 * 2000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2000 * 2000 * 0.3


def test_gower_pairs_of_more_queries_than_rows(spark, monkeypatch):
    d = clashing(spark, "int")
    few = d.where("id % 20 = 0")
    want = {(r.id_b, r.id_a): r.distance for r in donors.gower_distance(d, "id", queries=few).collect()}
    monkeypatch.setattr(donors, "ROWS", 2)
    monkeypatch.setattr(donors, "gower_ranges", lambda _, columns, levels, of=donors.gower_ranges: of(d, columns, levels))
    for shared in (1 << 13, 0):
        monkeypatch.setattr(donors, "SHARED_BYTES", shared)
        got = {(r.id_a, r.id_b): r.distance for r in donors.gower_distance(few, "id", queries=d).collect()}
        assert len(got) == 180 and all(got[k] == pytest.approx(v) for k, v in want.items())
