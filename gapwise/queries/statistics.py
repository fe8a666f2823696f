"""Tests, pooling, model-based imputation, comparisons."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gapwise.functions.draws import uniform
from gapwise.operators import chained, compare, mcar, mi, models
from gapwise.operators.estimator import MissingImputer
from gapwise.queries.registry import ORACLES, QUERIES, query
from gapwise.queries.series import MODE, drawn, invariant_query, invariants
from gapwise.sources.tables import table, view

PART, CUST = ["p_size", "p_retailprice", "p_brand"], ["c_nationkey", "c_acctbal", "c_mktsegment"]


def _mcar_facts(d):
    """What SQL can tell of the test: patterns, missing cells, degrees of freedom; and that p is a probability."""
    r = mcar.mcar_test(d)
    return r.select("missing_patterns", "amount_missing", "df", ((F.col("p_value") >= 0) & (F.col("p_value") <= 1)).alias("p_is_probability"))


query("mcar_test", "part_m", lambda d: mcar.mcar_test(d.drop("p_partkey", "p_brand")))
query(
    "mcar_test_facts",
    "part_m",
    lambda d: _mcar_facts(d.drop("p_brand")),
    """WITH t AS (SELECT p_size IS NULL AS a, p_retailprice IS NULL AS b, count(*) AS n FROM part_m GROUP BY 1, 2)
    SELECT count(*) AS missing_patterns, sum(n * (a::INT + b::INT))::BIGINT AS amount_missing, (sum(3 - a::INT - b::INT) - 3)::BIGINT AS df, true AS p_is_probability FROM t""",
)
query("diagnose_missing", "part_m", lambda d: d.sparkSession.createDataFrame([(lambda r: (r["evidence"], ",".join(r["high_missing_columns"]), r["max_nullity_corr"]))(mcar.diagnose_missing(d))], "evidence string, high string, max_corr double"))
query("association_lrt", "part_m", lambda d: mcar.missingness_association_test(d.drop("p_brand"), "p_partkey"))
query(
    "logistic_log_likelihood",
    "part_m",
    lambda d: d.sparkSession.createDataFrame([(round(models.logistic_log_likelihood(d, F.lit(0.25), F.col("p_size").isNull().cast("int")), 6),)], "ll double"),
    "SELECT round(sum(CASE WHEN p_size IS NULL THEN ln(0.25) ELSE ln(0.75) END), 6) AS ll FROM part_m",
)


def _chains(spark, sf_dir):
    """Mean and variance of the mean of the order prices for five groups of customers, by order status."""
    d = view(spark, sf_dir, "orders_m").where("o_totalprice is not null and o_orderstatus is not null")
    return d.groupBy("o_orderstatus", (F.col("o_custkey") % 5).alias("chain")).agg(F.avg("o_totalprice").alias("estimate"), (F.var_samp("o_totalprice") / F.count(F.lit(1))).alias("variance"))


CHAINS = """WITH c AS (SELECT o_orderstatus, o_custkey % 5 AS chain, avg(o_totalprice) AS q, var_samp(o_totalprice) / count(*) AS u FROM orders
    WHERE o_orderkey % 5 <> 0 AND NOT (o_orderkey % 13 = 0 AND o_orderpriority = '1-URGENT') GROUP BY 1, 2)"""
POOL = CHAINS + """, p AS (SELECT o_orderstatus, count(*) AS m, avg(q) AS q_bar, avg(u) AS u_bar, var_samp(q) AS b FROM c GROUP BY 1),
    r AS (SELECT *, (1 + 1.0::DOUBLE / m) * b / u_bar AS r FROM p), d AS (SELECT *, (m - 1) * (1 + 1 / r) * (1 + 1 / r) AS df FROM r)
    SELECT o_orderstatus, m, round(q_bar, 4) AS q_bar, round(u_bar, 2) AS u_bar, round(b, 2) AS b, round(u_bar + (1 + 1.0::DOUBLE / m) * b, 2) AS t, round(df, 4) AS df, round(r, 6) AS r,
    round((1 + 1.0::DOUBLE / m) * b / (u_bar + (1 + 1.0::DOUBLE / m) * b), 6) AS lambda_, round((r + 2 / (df + 3)) / (r + 1), 6) AS fmi FROM d"""
DIGITS = {"q_bar": 4, "u_bar": 2, "b": 2, "t": 2, "df": 4, "r": 6, "lambda_": 6, "fmi": 6}
QUERIES["rubin_scalar_pool"] = lambda spark, sf_dir: mi.pool_estimates(_chains(spark, sf_dir), by=["o_orderstatus"]).withColumns({c: F.round(c, d) for c, d in DIGITS.items()})
ORACLES["rubin_scalar_pool"] = POOL


def _regressions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("chain", F.col("l_partkey") % 5)
    pooled = mi.pool_regressions(lines, ["l_quantity", "l_tax"], "l_extendedprice")
    return pooled.select("term", F.round("coef", 3).alias("coef"), F.round("se", 3).alias("se"), F.round("t", 3).alias("t"))


QUERIES["rubin_matrix_pool"] = _regressions
ORACLES["rubin_matrix_pool"] = """WITH r AS (SELECT l_partkey % 5 AS chain, l_quantity::DOUBLE AS a, l_tax::DOUBLE AS b, l_extendedprice::DOUBLE AS y FROM lineitem),
    c AS (SELECT chain, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(a, a) AS aa, regr_sxx(b, b) AS bb, regr_sxx(y, y) AS yy, regr_sxy(a, b) AS ab, regr_sxy(a, y) AS ay, regr_sxy(b, y) AS bb_y FROM r GROUP BY 1),
    s AS (SELECT *, (bb * ay - ab * bb_y) / (aa * bb - ab * ab) AS qa, (aa * bb_y - ab * ay) / (aa * bb - ab * ab) AS qb, aa * bb - ab * ab AS d FROM c),
    v AS (SELECT *, (yy - qa * ay - qb * bb_y) / (n - 3) AS s2 FROM s),
    each AS (SELECT 'intercept' AS term, my - qa * ma - qb * mb AS q, s2 * (1 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / d) AS u FROM v
        UNION ALL SELECT 'l_quantity', qa, s2 * bb / d FROM v UNION ALL SELECT 'l_tax', qb, s2 * aa / d FROM v),
    p AS (SELECT term, avg(q) AS coef, sqrt(avg(u) + (1 + 1.0::DOUBLE / count(*)) * var_samp(q)) AS se FROM each GROUP BY 1)
    SELECT term, round(coef, 3) AS coef, round(se, 3) AS se, round(coef / se, 3) AS t FROM p"""
QUERIES["pool_linear_models"] = lambda spark, sf_dir: mi.pool_linear_models(table(spark, sf_dir, "lineitem").withColumn("chain", F.col("l_partkey") % 5), "l_quantity", "l_extendedprice").select("m", F.round("q_bar", 6).alias("q_bar"), F.round("u_bar", 6).alias("u_bar"), F.round("t", 6).alias("t"))
ORACLES["pool_linear_models"] = """WITH c AS (SELECT l_partkey % 5 AS chain, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS q, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1),
    v AS (SELECT q, greatest(greatest(syy - q * sxy, 0) / (n - 2) / sxx, 1e-10) AS u FROM c)
    SELECT count(*) AS m, round(avg(q), 6) AS q_bar, round(avg(u), 6) AS u_bar, round(avg(u) + (1 + 1.0::DOUBLE / count(*)) * var_samp(q), 6) AS t FROM v"""


def _trace(spark, sf_dir):
    """Four chains, an 'iteration' per order."""
    d = table(spark, sf_dir, "orders")
    return d.select((F.col("o_orderkey") % 4).alias("chain"), F.floor(F.col("o_orderkey") / 4).alias("iter"), F.lit("price").alias("variable"), F.col("o_totalprice").alias("value"))


QUERIES["gelman_rubin_rhat"] = lambda spark, sf_dir: mi.gelman_rubin_rhat(_trace(spark, sf_dir)).withColumn("rhat", F.round("rhat", 8))
RHAT = """WITH t AS (SELECT o_orderkey % 4 AS chain, o_orderkey // 4 AS iter, o_totalprice AS v FROM orders),
    k AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM t GROUP BY chain)), c AS (SELECT chain, avg(v) AS m, var_samp(v) AS s FROM t, k WHERE iter < k.n GROUP BY 1)
    SELECT 'price' AS variable, count(*) AS n_chains, max(k.n) AS n_iter, round(sqrt(((max(k.n) - 1)::DOUBLE / max(k.n) * avg(s) + var_samp(m)) / avg(s)), 8) AS rhat FROM c, k"""
ORACLES["gelman_rubin_rhat"] = RHAT
QUERIES["mice_convergence"] = lambda spark, sf_dir: mi.mice_convergence(_trace(spark, sf_dir)).select("variable", "converged")
ORACLES["mice_convergence"] = f"SELECT variable, rhat < 1.1 AS converged FROM ({RHAT})"

invariant_query("impute_mice_invariants", "part_m", lambda d: models.impute_mice(d, "p_partkey", max_iter=2), "p_partkey", PART)
invariant_query("impute_mice_chains", "part_m", lambda d: models.impute_mice(d, "p_partkey", max_iter=1, n_imputations=3), "p_partkey", PART)
invariant_query("impute_pmm", "part_m", lambda d: models.impute_pmm(d, "p_partkey", max_iter=1), "p_partkey", PART)
invariant_query("impute_polyreg", "customer_m", lambda d: models.impute_polyreg(d, "c_custkey"), "c_custkey", CUST, still=["c_acctbal"])
invariant_query("impute_polr", "customer_m", lambda d: models.impute_polr(d, "c_custkey"), "c_custkey", CUST, still=["c_acctbal"])
invariant_query("impute_rf", "customer_m", lambda d: models.impute_rf(d, "c_custkey", numTrees=5), "c_custkey", CUST)
invariant_query("impute_gb", "customer_m", lambda d: models.impute_gb(d.drop("c_mktsegment"), "c_custkey", maxIter=3), "c_custkey", CUST[:2])
QUERIES["impute_gb"] = lambda spark, sf_dir: (lambda d: invariants(models.impute_gb(d, "c_custkey", maxIter=3), d, "c_custkey"))(view(spark, sf_dir, "customer_m").drop("c_mktsegment"))


def _binary(d):
    return d.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.when(F.col("c_nationkey") > 12, "high").otherwise("low")).alias("half"))


QUERIES["impute_logreg"] = lambda spark, sf_dir: (lambda d: invariants(models.impute_logreg(d, "c_custkey"), d, "c_custkey"))(_binary(view(spark, sf_dir, "customer_m")))
ORACLES["impute_logreg"] = "SELECT unnest(['c_nationkey', 'half']) AS variable, 0::BIGINT AS n_observed_changed, 0::BIGINT AS n_still_missing, 0::BIGINT AS n_rows_lost"


def _donor_pool(d):
    """Imputed values that no donor holds."""
    done = models.impute_pmm(d, "p_partkey", max_iter=1)
    filled = done.join(d.where("p_size is null").select("p_partkey"), "p_partkey").select("p_size")
    return filled.join(d.select("p_size").distinct(), "p_size", "left_anti").agg(F.count(F.lit(1)).alias("outside_pool"))


query("impute_pmm_donor_pool", "part_m", _donor_pool, "SELECT 0::BIGINT AS outside_pool")


class _Sizes:
    """A kernel: sizes from 1 to 50, each as likely."""

    def impute(self, state, target, mask, seed):
        return 1 + F.floor(uniform(seed, target, F.col("p_partkey")) * 50)


PLAN = mi.ImputationPlan(
    {"p_size": "sizes", "p_retailprice": "passive", "p_brand": "mode"}, 3, 1, (11, 12, 13), {"p_size": (5, 40), "p_retailprice": "900 + p_size * 10 + length(p_brand)"}
)
query(
    "impute_plan",
    "part_m",
    lambda d: chained.impute_plan(d, "p_partkey", PLAN, {"sizes": _Sizes()}).data.completed,
    f"""WITH c AS (SELECT unnest([0, 1, 2])::INT AS chain), d AS (SELECT p_partkey, chain, p_size, p_retailprice, coalesce(p_brand, {MODE.format("p_brand", "part_m")}) AS p_brand,
        CASE chain WHEN 0 THEN {drawn("p_size", "p_partkey", 11)} WHEN 1 THEN {drawn("p_size", "p_partkey", 12)} ELSE {drawn("p_size", "p_partkey", 13)} END AS u FROM part_m, c),
    s AS (SELECT * REPLACE (coalesce(p_size, greatest(5, least(40, 1 + floor(u * 50)))) AS p_size) FROM d)
    SELECT chain, p_partkey, p_size, coalesce(p_retailprice, 900 + p_size * 10 + length(p_brand)) AS p_retailprice, p_brand FROM s""",
)
MIXED = mi.ImputationPlan({"p_size": "norm", "p_retailprice": "pmm", "cheap": "logreg", "p_brand": "polyreg"}, 2, 1, (5, 6), {"p_size": (1, 50)})


def _mixed(d):
    """What a plan of four methods changes, and how many of its values lie outside the bounds or among no donor's."""
    d = d.withColumn("cheap", F.when(F.col("p_partkey") % 9 > 0, F.when(F.col("p_partkey") % 4 > 1, "yes").otherwise("no")))
    done = chained.impute_plan(d, "p_partkey", MIXED).data.completed
    found = done.join(d.select("p_retailprice").distinct().withColumn("held", F.lit(1)), "p_retailprice", "left")
    return found.groupBy("chain").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("p_size").between(1, 50)).alias("outside"), F.count_if(F.col("held").isNull()).alias("no_donor"), F.count_if(F.col("p_brand").isNull() | F.col("cheap").isNull()).alias("open")
    )


query("impute_plan_mixed", "part_m", _mixed, "SELECT unnest([0, 1])::INT AS chain, (SELECT count(*) FROM part_m) AS n, 0::BIGINT AS outside, 0::BIGINT AS no_donor, 0::BIGINT AS open")


def _model_invariants(strategy, row_id, columns):
    def build(d):
        train, test = d.where(f"{row_id} % 2 = 0"), d.where(f"{row_id} % 2 = 1")
        done = MissingImputer(strategy=strategy, rowId=row_id, neighbors=3, maxIter=1).fit(train).transform(test)
        return invariants(done, test, row_id)

    return build, " UNION ALL ".join(f"SELECT '{c}' AS variable, 0::BIGINT AS n_observed_changed, 0::BIGINT AS n_still_missing, 0::BIGINT AS n_rows_lost" for c in columns)


def _fitted_fill(strategy):
    """What the training half says, in the gaps of the other half; numbers as doubles."""

    def build(d):
        train, test = d.where("c_custkey % 2 = 0"), d.where("c_custkey % 2 = 1")
        done = MissingImputer(strategy=strategy, rowId="c_custkey").fit(train).transform(test)
        return done.select("c_custkey", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in CUST[:2]], "c_mktsegment")

    value = {"mean": "avg({0})", "median": "quantile_cont({0}, 0.5)"}.get(strategy)
    fills = [f"(SELECT {value.format(c)} FROM t)" if value and c != "c_mktsegment" else MODE.format(c, "t") for c in CUST]
    columns = [f"coalesce({c}, {fill})" for c, fill in zip(CUST, fills, strict=True)]
    columns[:2] = [f"round({x}::DOUBLE, 4)" for x in columns[:2]]
    return build, "WITH t AS (SELECT * FROM customer_m WHERE c_custkey % 2 = 0) SELECT c_custkey, " + ", ".join(f"{x} AS {c}" for x, c in zip(columns, CUST, strict=True)) + " FROM customer_m WHERE c_custkey % 2 = 1"


for _strategy in ("mean", "median", "mode"):
    _build, _sql = _fitted_fill(_strategy)
    query(f"estimator_{_strategy}", "customer_m", _build, _sql)
for _strategy in ("knn", "mice", "pmm", "rf", "hotdeck"):
    _build, _sql = _model_invariants(_strategy, "c_custkey", CUST)
    query(f"estimator_{_strategy}", "customer_m", _build, _sql)

QUERIES["compare_imputations"] = lambda spark, sf_dir: compare.compare_imputations(
    table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey", ["mean", "median", "mode", "hotdeck"]
).select("method", F.col("error").isNull().alias("ran"), (F.col("rmse") > 0).alias("has_rmse"), ((F.col("accuracy") >= 0) & (F.col("accuracy") <= 1)).alias("has_accuracy"))
ORACLES["compare_imputations"] = "SELECT unnest(['mean', 'median', 'mode', 'hotdeck']) AS method, true AS ran, true AS has_rmse, true AS has_accuracy"


def _linear(train):
    from pyspark.ml import Pipeline

    return Pipeline(stages=[VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y")])


def _cv(spark, sf_dir):
    d = view(spark, sf_dir, "part_m").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 100).cast("double").alias("y"))
    return compare.cv_compare_imputations(d, "p_partkey", "y", _linear, RegressionEvaluator(labelCol="y", metricName="r2"), ["mean", "median"], n_splits=3)


QUERIES["cv_compare"] = lambda spark, sf_dir: _cv(spark, sf_dir).select("strategy", F.col("mean_score").isNotNull().alias("scored"), (F.col("std_score") >= 0).alias("spread"))
ORACLES["cv_compare"] = "SELECT unnest(['mean', 'median']) AS strategy, true AS scored, true AS spread"
QUERIES["mi_fit"] = lambda spark, sf_dir: mi.mi_fit(
    view(spark, sf_dir, "part_m").drop("p_brand"), "p_partkey", 3, lambda long: mi.pool_linear_models(long, "p_size", "p_retailprice"), max_iter=1
).select("m", (F.col("t") > 0).alias("has_variance"))
ORACLES["mi_fit"] = "SELECT 3::BIGINT AS m, true AS has_variance"
QUERIES["mi_with"] = lambda spark, sf_dir: mi.mi_with(
    table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("chain"), "c_acctbal"), lambda chains: chains.agg(F.count(F.lit(1)).alias("n"))
)
ORACLES["mi_with"] = "SELECT c_custkey % 3 AS chain, count(*) AS n FROM customer GROUP BY 1"
query("impute_histograms", "part_m", lambda d: _histograms(d), """WITH v AS (SELECT 'original' AS frame, p_retailprice AS v FROM part_m WHERE p_retailprice IS NOT NULL UNION ALL SELECT 'mean', coalesce(p_retailprice, (SELECT avg(p_retailprice) FROM part_m)) FROM part_m),
    e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM v) SELECT frame, least(floor((v - lo) / w), 29)::INT AS bin, count(*) AS n FROM v, e GROUP BY 1, 2""")


def _histograms(d):
    from gapwise.operators.fill import impute_mean
    from gapwise.operators.views import impute_histograms

    return impute_histograms(d, {"mean": impute_mean(d)}, "p_retailprice").select("frame", "bin", "n")


