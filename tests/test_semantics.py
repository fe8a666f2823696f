"""Rules that the tables can't show: sentinels, NaN, empty frames, errors, closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import gapwise
from gapwise.functions.distributions import chi2_sf, t_sf2
from gapwise.operators import cleaning, fill, mi, models, patterns, provenance, report, shadow, summary, timeseries, validate
from gapwise.operators.donors import euclidean, gower
from gapwise.plans.ordered import with_neighbours, with_position


@pytest.fixture()
def simple(spark):
    return spark.createDataFrame([(0, 1.0, None), (1, None, 2.0), (2, 3.0, None), (3, 4.0, 4.0)], "row_id int, a double, b double")


@pytest.fixture()
def series(spark):
    t = [1.0, None, None, 4.0, 5.0, None, 7.0, 8.0, 9.0, 10.0]
    h = [1.0, 2.0, None, 4.0, None, None, None, 8.0, 9.0, 10.0]
    return spark.createDataFrame([(i, t[i], h[i], None if i in (4, 5) else "s%d" % i) for i in range(10)], "i int, temp double, humid double, status string")


def test_summary(simple):
    d = simple.drop("row_id")
    assert (gapwise.n_miss(d), gapwise.n_complete(d), gapwise.pct_miss(d), gapwise.pct_complete(d)) == (3, 5, 37.5, 62.5)
    assert [tuple(r) for r in gapwise.miss_var_summary(d).collect()] == [("a", 1, 25.0), ("b", 2, 50.0)]
    assert simple.miss.n_miss() == 3


def test_nan_and_sentinels_meet_their_types_only(spark):
    d = spark.createDataFrame([("x", 1.0, "ok"), ("x", float("nan"), "N/A"), ("y", -99.0, "ok"), (None, 4.0, None)], "g string, score double, label string")
    assert gapwise.n_miss(d) == 3
    assert gapwise.n_miss(d, [-99, "N/A", None]) == 5
    assert summary.null_only_summary(d).where("variable = 'score'").first()["n_missing"] == 0
    found = {(r.variable, r.value): r.n for r in gapwise.miss_scan_count(d, [-99, "N/A"]).collect()}
    assert found == {("score", "-99"): 1, ("label", "N/A"): 1}


def test_empty_frames(spark):
    d = spark.createDataFrame([], "a double, b string")
    assert gapwise.summarise(d).first()["pct_miss"] == 0.0
    assert [r.pct_miss for r in gapwise.miss_var_summary(d).collect()] == [0.0, 0.0]
    assert gapwise.miss_patterns(d).count() == 0
    assert gapwise.pattern_monotone_test(d).first()["is_monotone"]


def test_positions_across_ranges(spark):
    d = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("v")).repartition(5)
    out = with_neighbours(d, {"v": F.col("v")}, ["k"]).orderBy("k").collect()
    for r in out:
        assert r["__pos"] == r.k + 1
        assert r["__prev_v"]["value"] == r.k // 7 * 7
        assert (r["__next_v"] and r["__next_v"]["value"]) == (-(-r.k // 7) * 7 if r.k <= 994 else None)
    sums = with_position(d, ["k"], (), {"s": F.lit(1)}).agg(F.max("s")).first()[0]
    assert sums == 1000


def test_gaps(series):
    rows = {(r["column"], r.gap_id): (r.start, r.end, r.length) for r in gapwise.gap_table(series.drop("status"), ["i"]).collect()}
    assert rows[("temp", 1)] == (1, 3, 2) and rows[("temp", 2)] == (5, 6, 1)
    assert rows[("humid", 1)] == (2, 3, 1) and rows[("humid", 2)] == (4, 7, 3)
    s = {r.variable: r for r in gapwise.miss_ts_summary(series.drop("status"), ["i"]).collect()}
    assert (s["temp"].n_miss, s["temp"].n_gaps, s["temp"].max_gap) == (3, 2, 2)
    assert (s["humid"].n_miss, s["humid"].n_gaps, s["humid"].max_gap) == (4, 2, 3)


def test_fill_along_order(spark, series):
    out = gapwise.impute_ts(series, ["i"]).orderBy("i").collect()
    assert [round(r.temp, 6) for r in out] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r.status for r in out][4:7] == ["s3", "s3", "s6"]
    edge = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, None), (4, None), (5, 5.0), (6, None)], "i int, v double")
    assert [r.v for r in gapwise.impute_ts(edge, ["i"], limit=2).orderBy("i").collect()] == [None, 1.0, 2.0, 3.0, None, 5.0, 5.0]
    spline = gapwise.impute_ts(series.drop("status"), ["i"], "spline").orderBy("i").collect()
    assert all(abs(r.temp - (r.i + 1)) < 0.2 for r in spline)
    with pytest.raises(gapwise.InvalidStrategyError):
        gapwise.impute_ts(series, ["i"], "cubic")


def test_series_with_null_and_hot_keys(spark):
    rows = [("hot", i, float(i) if i % 3 else None) for i in range(300)] + [(None, i, None if i % 2 else 1.0) for i in range(9)] + [("b", 7, None)]
    df = spark.createDataFrame(rows, "s string, i bigint, v double")
    got = {(r.s, r.i): r.v for r in gapwise.impute_ts(df, ["i"], "ffill", partition_by=["s"]).collect()}
    assert len(got) == len(rows) and got["b", 7] is None and got[None, 5] == 1.0 and got["hot", 150] == 149.0 and got["hot", 0] is None
    gaps = gapwise.gap_table(df, ["i"], partition_by=["s"]).collect()
    assert sorted(r.gap_id for r in gaps if r.s == "hot") == list(range(1, 101)) and sum(r.s is None for r in gaps) == 4


def test_rubin_closed_form(spark):
    want = {"q_bar": 2, "u_bar": 0.5, "b": 1, "t": 11 / 6, "r": 8 / 3, "df": 121 / 32, "lambda_": 8 / 11, "fmi": (8 / 3 + 64 / 217) / (11 / 3)}
    got = gapwise.pool_scalar_estimates([1, 2, 3], [0.25, 0.5, 0.75])
    row = gapwise.pool_estimates(spark.createDataFrame([(1.0, 0.25), (2.0, 0.5), (3.0, 0.75)], "estimate double, variance double")).first()
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-12 and abs(row[k] - v) < 1e-12
    assert math.isinf(gapwise.pool_scalar_estimates([1, 1], [0.5, 0.5])["df"])
    assert gapwise.pool_scalar_estimates([1, 2], [0, 0])["fmi"] == 1.0


def test_distributions():
    assert abs(chi2_sf(35.1061288689702, 14) - 0.00141778113856683) < 1e-12
    assert abs(t_sf2(2.0, 10) - 0.07338803477074) < 1e-10
    assert chi2_sf(0, 3) == 1.0


def test_mcar_rejects_and_accepts(spark):
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([0, 0, 0], np.eye(3) + 0.5, 800)
    random = [[None if rng.random() < 0.2 and j else float(v) for j, v in enumerate(r)] for r in x]
    biased = [[float(r[0]), None if r[0] > 0.5 else float(r[1]), float(r[2])] for r in x]
    assert gapwise.mcar_test(spark.createDataFrame(random, "a double, b double, c double")).first()["p_value"] > 0.01
    assert gapwise.mcar_test(spark.createDataFrame(biased, "a double, b double, c double")).first()["p_value"] < 1e-6
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.mcar_test(spark.createDataFrame([(1.0, 2.0)] * 9, "a double, b double"))
    verdict = gapwise.diagnose_missing(spark.createDataFrame(biased, "a double, b double, c double"))
    assert verdict["evidence"] == "MCAR_rejected"


def test_em_recovers_complete_moments(spark):
    from gapwise.operators.mcar import em_moments, pattern_moments

    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([1, 2], [[2, 1], [1, 3]], 500)
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    mu, sigma, _ = em_moments(pattern_moments(df, ["a", "b"], [0.0, 0.0]))
    assert np.allclose(mu, x.mean(0)) and np.allclose(sigma, np.cov(x.T, ddof=0))


def test_mode_ties_and_all_missing(spark):
    d = spark.createDataFrame([("b", 1), ("a", 1), (None, 2), ("a", None), ("b", None)], "s string, n int")
    assert fill.fill_values(d, "mode", ["s", "n"]) == {"s": "a", "n": 1}
    with pytest.raises(gapwise.InsufficientDataError):
        gapwise.impute_mode(spark.createDataFrame([(None,), (None,)], "a double"))
    whole = fill.make_imputer("mean").fit(spark.createDataFrame([(1,), (3,)], "n int")).transform(spark.createDataFrame([(None,), (5,)], "n int"))
    assert whole.dtypes == [("n", "int")] and [r.n for r in whole.collect()] == [2, 5]


def test_distances():
    a, b = np.array([[0.0, np.nan, 1.0]]), np.array([[3.0, 2.0, 1.0], [np.nan, 1.0, np.nan]])
    d = euclidean(a, b)
    assert abs(d[0, 0] - math.sqrt(3 / 2 * 9)) < 1e-12 and math.isnan(d[0, 1])
    g = gower(a, b, np.array([6.0, 1.0, 0.0]))
    assert g.tolist() == [[0.25, 1.0]]


def test_nearest_scores_match_brute_force(spark):
    rng = np.random.default_rng(5)
    donors = [(i, float(v), float(v)) for i, v in enumerate(rng.integers(0, 40, 300))]
    asked = [(1000 + i, float(v)) for i, v in enumerate(rng.normal(20, 15, 80))]
    got = models.nearest_scores(spark.createDataFrame(asked, "id bigint, score double"), spark.createDataFrame(donors, "donor bigint, score double, value double"), 4).collect()
    for i, s in asked:
        want = sorted(abs(v - s) for _, v, _ in donors)[:4]
        assert sorted(abs(r.value - s) for r in got if r.id == i) == pytest.approx(want)


def test_strict_mode_is_checked_before_any_job(spark):
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.impute_logreg(spark.createDataFrame([(1, "a")], "i int, s string"), "i", strict_mode="yes")


def test_contracts(spark, simple):
    d = simple.withColumn("row_id", F.col("row_id").cast("int"))
    schema = gapwise.MissingnessSchema.from_dataframe(d, "row_id")
    plan = gapwise.ImputationPlan({"a": "mean"}, n_imputations=1)
    plan.validate_schema(schema)
    done = d.fillna(0.0)
    gapwise.MIData(d, schema, plan, done).validate()
    schema.validate_frame(done)
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.MIData(d, schema, plan, d).validate()
    with pytest.raises(gapwise.ConfigurationError):
        schema.validate_frame(done.where("row_id < 2"))
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.ImputationPlan({}, n_imputations=2, seeds=(1, 1))


def test_rhat_edges(spark):
    same = spark.createDataFrame([(c, i, "x", float(i)) for c in range(2) for i in range(5)], "chain int, iter int, variable string, value double")
    assert mi.gelman_rubin_rhat(same).first()["rhat"] is None
    with pytest.raises(gapwise.ConfigurationError):
        gapwise.mice_convergence(same.where("chain = 0"))


def test_mice_history_and_bounds(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, float(v), None if i % 5 == 0 else float(2 * v + rng.normal() * 0.1)) for i, v in enumerate(rng.normal(size=200))], "i int, a double, b double")
    out, history = gapwise.impute_mice(d, "i", max_iter=3, n_imputations=2, bounds={"b": (-1.0, 1.0)}, return_history=True)
    assert history.count() == 6 and out.count() == 400
    assert out.where("i % 5 = 0").agg(F.max(F.abs("b"))).first()[0] <= 1.0
    one = gapwise.impute_mice(d, "i", max_iter=2).where("i % 5 = 0")
    assert one.agg(F.max(F.abs(F.col("b") - 2 * F.col("a")))).first()[0] < 0.6
    again = gapwise.impute_mice(d.repartition(7), "i", max_iter=2).where("i % 5 = 0").orderBy("i").collect()
    assert [r.b for r in again] == pytest.approx([r.b for r in one.orderBy("i").collect()])


def test_patterns(spark):
    d = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, 1.0, "x"), (4, None, "x")], "k int, a double, s string")
    assert patterns.upset(d).count() == 4 and patterns.upset(d, include_complete=False).count() == 3
    assert d.miss.miss_patterns(top_n=1).first()["pattern"] == "(complete)"
    order = patterns.leaves(3, patterns.linkage(np.array([[0, 5, 1], [5, 0, 5], [1, 5, 0]], float), np.ones(3)))
    assert set(order[:2]) == {0, 2} or set(order[1:]) == {0, 2}
    assert patterns.miss_cluster(d).agg(F.sum("n")).first()[0] == 4


def test_shadow_rules(simple):
    with pytest.raises(gapwise.ConfigurationError):
        shadow.add_any_miss_var(shadow.add_any_miss_var(simple))
    assert shadow.miss_as_feature(simple).columns == ["row_id", "a", "a_NA", "b", "b_NA"]
    assert shadow.miss_as_feature(simple, ["row_id"], keep_original=False).columns == ["row_id_NA", "a", "b"]
    with pytest.raises(gapwise.MissingColumnError):
        shadow.replace_with_na(simple, {"zzz": 1})


def test_cleaning(spark):
    assert cleaning.clean_name("Müller  No.", strip_accents=True) == "muller_no"
    assert cleaning.clean_names(spark.createDataFrame([(1, 2)], ["A b", "a_B"])).columns == ["a_b", "a_b_2"]
    assert cleaning.memory_usage_mb(spark.range(10)) > 0


def test_validation(spark):
    with pytest.raises(TypeError):
        validate.validate_dataframe([1])
    with pytest.raises(gapwise.InsufficientDataError):
        validate.validate_dataframe(spark.range(1), min_rows=2)
    with pytest.raises(gapwise.ConfigurationError):
        validate.validate_positive_int(0, param="k")
    with pytest.raises(gapwise.ConfigurationError):
        validate.validate_columns(spark.createDataFrame([("a",)], "s string"), ["s"], require_numeric=True)


def test_report(spark, simple, tmp_path):
    path = report.create_report(simple, "row_id", str(tmp_path / "r.html"), language="fa")
    page = open(path, encoding="utf-8").read()
    assert 'dir="rtl"' in page and "<svg" in page
    assert report.interpretation(float("nan"), 1)[0].startswith("Unknown")


def test_provenance(spark, simple):
    a = provenance.dataframe_fingerprint(simple)
    assert a == provenance.dataframe_fingerprint(simple.repartition(3))
    assert a != provenance.dataframe_fingerprint(simple.union(simple.limit(1)))
    m = provenance.analysis_provenance(simple, "mean", {"x": 1})
    assert m["input_sha256"] == a and m["analysis_sha256"] != a
    assert provenance.stable_json({"a": 1}) != provenance.stable_json({"a": 1.0}) != provenance.stable_json({"a": "1"})
    kwargs = dict(name="n", operation="o", dataset="d", dataset_sha256="0" * 64, rows=1, columns=1, seed=0, engine="e", engine_version="1", python_version="3", platform="p", cores=1, created="now", parameters={}, metrics={"s": 1.0}, tolerances={})
    made = provenance.BenchmarkManifest(**kwargs)
    assert provenance.BenchmarkManifest.from_dict(made.to_dict()).sha256() == made.sha256()
    with pytest.raises(gapwise.ConfigurationError):
        provenance.BenchmarkManifest(**(kwargs | {"metrics": {"s": float("nan")}}))


def test_estimator_guards(spark):
    d = spark.createDataFrame([(1, 1.0), (2, None)], "i int, a double")
    with pytest.raises(NotImplementedError):
        gapwise.MissingImputer(strategy="logreg", rowId="i").fit(d)
    with pytest.raises(gapwise.InvalidStrategyError):
        gapwise.MissingImputer(strategy="magic")
    model = gapwise.MissingImputer(strategy="mean").fit(d)
    assert model.get_feature_names_out() == ["i", "a"]
    with pytest.raises(gapwise.MissingColumnError):
        model.transform(d.drop("a"))


def test_stream(spark, tmp_path):
    from gapwise.streaming.summary import windowed_missing, write_parquet

    source = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:20:00", None), ("2024-01-01 05:00:00", 2.0)], "t string, v double").select(F.col("t").cast("timestamp").alias("t"), "v")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = write_parquet(windowed_missing(stream, "t"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.n_rows, r.n_miss) for r in got] == [(2, 1)]
    assert {(r.n_rows, r.n_miss) for r in windowed_missing(source, "t").collect()} == {(2, 1), (1, 0)}


def test_public_names():
    for name in gapwise.__all__:
        assert getattr(gapwise, name) is not None
