"""Time series, simple fills, donors, simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapwise.operators import donors, fill, simulate, timeseries
from gapwise.operators.mi import completed_violations
from gapwise.plans.ordered import with_position
from gapwise.queries.registry import ORACLES, QUERIES, query
from gapwise.sources.tables import VIEWS, table
from gapwise.streaming.summary import windowed_missing

ORDER = ["event_id"]
#: Per column: the places of the observed rows before and after, by window functions.
SPOT = """WITH e AS (SELECT event_id, ts, event_type, value, row_number() OVER (ORDER BY event_id) AS i FROM events_m),
n AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (ORDER BY i) AS p, min(CASE WHEN value IS NOT NULL THEN i END) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM e)"""
GAPS = (
    SPOT
    + """, g AS (SELECT coalesce(p, 0) AS after, min(event_id) AS s, count(*) AS length, max(event_id) AS last, max(q) AS q FROM n WHERE value IS NULL GROUP BY 1),
gaps AS (SELECT 'value' AS "column", row_number() OVER (ORDER BY after) AS gap_id, s AS start, coalesce(e.event_id, g.last) AS "end", length FROM g LEFT JOIN e ON e.i = g.q)"""
)
value_only = lambda d: d.select("event_id", "value")
query("gap_table", "events_m", lambda d: timeseries.gap_table(value_only(d), ORDER), GAPS + " SELECT * FROM gaps")
query(
    "miss_ts_summary",
    "events_m",
    lambda d: timeseries.miss_ts_summary(value_only(d), ORDER),
    GAPS + """ SELECT 'value' AS variable, sum(length)::BIGINT AS n_miss, round(sum(length)::DOUBLE / (SELECT count(*) FROM e) * 100, 2) AS pct_miss, count(*) AS n_gaps,
    round(avg(length), 2) AS mean_gap, max(length) AS max_gap, max(length) AS max_gap_len, median(length)::DOUBLE AS median_gap FROM gaps""",
)
query("gap_length_hist", "events_m", lambda d: timeseries.gap_lengths(value_only(d), ORDER), GAPS + ' SELECT "column", length, count(*) AS n_gaps FROM gaps GROUP BY ALL')
query(
    "gap_length_box",
    "events_m",
    lambda d: timeseries.gap_length_box(value_only(d), ORDER),
    GAPS + """ SELECT "column", min(length) AS low, quantile_cont(length, 0.25) AS q1, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS q3, max(length) AS high FROM gaps GROUP BY 1""",
)
ROLL = "SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos, sum((value IS NULL)::INT) OVER w::DOUBLE / count(*) OVER w * 100 AS {} FROM events_m WINDOW w AS (ORDER BY event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
query("miss_over_time", "events_m", lambda d: timeseries.miss_over_time(value_only(d), ORDER), ROLL.format("value", 9))
query("miss_span_rolling", "events_m", lambda d: timeseries.miss_span(value_only(d), "value", ORDER, 20), ROLL.format("pct_miss", 19))
query(
    "ts_presence",
    "events_m",
    lambda d: timeseries.ts_presence(value_only(d), "event_id", buckets=50),
    """SELECT least(floor((event_id - (SELECT min(event_id) FROM events_m))::DOUBLE / (SELECT max(event_id) - min(event_id) FROM events_m) * 50), 49)::INT AS bucket, 'value' AS variable, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_miss FROM events_m GROUP BY 1""",
)
FILLED = SPOT + " SELECT n.event_id, {} AS value FROM n LEFT JOIN e a ON a.i = n.p LEFT JOIN e b ON b.i = n.q"
query("impute_ts_ffill", "events_m", lambda d: timeseries.impute_ts(value_only(d), ORDER, "ffill"), FILLED.format("a.value"))
query("impute_ts_bfill", "events_m", lambda d: timeseries.impute_ts(value_only(d), ORDER, "bfill"), FILLED.format("b.value"))
LINE = "CASE WHEN n.value IS NOT NULL THEN n.value WHEN b.value IS NULL THEN a.value ELSE a.value + (b.value - a.value) * ({})  END"
SHARE = "(n.i - n.p)::DOUBLE / (n.q - n.p)"
TIME = "epoch_us(n.ts) - epoch_us(a.ts))::DOUBLE / (epoch_us(b.ts) - epoch_us(a.ts)"
rounded = lambda d: d.withColumn("value", F.round("value", 6))
query("impute_ts_linear", "events_m", lambda d: rounded(timeseries.impute_ts(value_only(d), ORDER)), FILLED.format(f"round({LINE.format(SHARE)}, 6)"))
query("impute_ts_limit", "events_m", lambda d: rounded(timeseries.impute_ts(value_only(d), ORDER, "linear", limit=2)), FILLED.format(f"round(CASE WHEN n.value IS NOT NULL OR n.i - n.p <= 2 THEN {LINE.format(SHARE)} END, 6)"))
TS = SPOT.replace("ORDER BY event_id) AS i", "ORDER BY ts, event_id) AS i")
query(
    "impute_ts_time",
    "events_m",
    lambda d: rounded(timeseries.impute_ts(d.select("ts", "event_id", "value"), ["ts", "event_id"], "time", columns=["value"])).select("event_id", "value"),
    TS + f" SELECT n.event_id, round({LINE.format('(' + TIME + ')')}, 6) AS value FROM n LEFT JOIN e a ON a.i = n.p LEFT JOIN e b ON b.i = n.q",
)
query("impute_ts_spline", "events_m", lambda d: timeseries.impute_ts(d.select("user_id", "event_id", "value"), ORDER, "spline", partition_by=["user_id"]))
query(
    "impute_ts_spline_line",
    "events_m",
    lambda d: rounded(timeseries.impute_ts(value_only(d), ORDER, "spline", spline_order=1)),
    """WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS i FROM events_m), k AS (SELECT i, value, lead(i) OVER (ORDER BY i) AS j, lead(value) OVER (ORDER BY i) AS w FROM e WHERE value IS NOT NULL),
    line AS (SELECT i, value, coalesce((w - value) / (j - i), lag((w - value) / (j - i)) OVER (ORDER BY i)) AS slope FROM k)
    SELECT e.event_id, round(coalesce(e.value, line.value + (e.i - line.i) * slope), 6) AS value FROM e ASOF LEFT JOIN line ON e.i >= line.i""",
)


def _roots(df):
    """Cubes of the place where a value is observed, filled by a cubic spline: the cube root tells the place everywhere."""
    cubes = with_position(value_only(df), ORDER).select("event_id", F.col("__pos").alias("place"), F.when(F.col("value").isNotNull(), F.pow(F.col("__pos").cast("double"), 3)).alias("cube"))
    return timeseries.impute_ts(cubes, ORDER, "spline", columns=["cube"]).select("event_id", F.round(F.cbrt("cube"), 3).alias("root"))


query("impute_ts_spline_cubes", "events_m", _roots, SPOT + " SELECT event_id, CASE WHEN p IS NOT NULL THEN i::DOUBLE END AS root FROM n")
query("impute_ts_text", "events_m", lambda d: timeseries.impute_ts(d.select("event_id", "event_type"), ORDER), """WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS i FROM events_m) SELECT event_id, last_value(event_type IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event_type FROM e""")
query(
    "windowed_missing",
    "events_m",
    lambda d: windowed_missing(d, "ts", window="1 day", columns=["value", "event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "variable", "n_rows", "n_miss"),
    "SELECT strftime(ts, '%Y-%m-%d') AS day, v AS variable, count(*) AS n_rows, count(*) FILTER (WHERE CASE v WHEN 'value' THEN value IS NULL ELSE event_type IS NULL END) AS n_miss FROM events_m, (SELECT unnest(['value', 'event_type']) AS v) GROUP BY 1, 2",
)

# Simple fills
MODE = "(SELECT {0} FROM {1} WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"
TEXT = ", ".join(f"coalesce({c}, {MODE.format(c, 'orders_m')}) AS {c}" for c in ("o_orderstatus", "o_orderpriority"))
price = lambda d: d.withColumns({c: F.round(c, 4) for c in ("o_orderkey", "o_custkey", "o_totalprice")})
NUMERIC = "round(o_orderkey::DOUBLE, 4) AS o_orderkey, round(o_custkey::DOUBLE, 4) AS o_custkey"
query("impute_mean", "orders_m", lambda d: price(fill.impute_mean(d)), f"SELECT {NUMERIC}, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_m)), 4) AS o_totalprice, {TEXT} FROM orders_m")
query("impute_median", "orders_m", lambda d: price(fill.impute_median(d)), f"SELECT {NUMERIC}, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_m)), 4) AS o_totalprice, {TEXT} FROM orders_m")
query("impute_mode", "part_m", lambda d: fill.impute_mode(d.drop("p_retailprice", "p_partkey")), "SELECT " + ", ".join(f"coalesce({c}, {MODE.format(c, 'part_m')}) AS {c}" for c in ("p_size", "p_brand")) + " FROM part_m")
query("impute_mean_numeric_only", "orders_m", lambda d: price(fill.impute_mean(d, numeric_only=True)).select("o_totalprice", "o_orderstatus"), "SELECT round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_m)), 4) AS o_totalprice, o_orderstatus FROM orders_m")
query(
    "fitted_imputer_transform",
    "part_m",
    lambda d: fill.make_imputer("median").fit(d.where("p_partkey % 2 = 0").drop("p_partkey")).transform(d.where("p_partkey % 2 = 1").drop("p_partkey")),
    "WITH t AS (SELECT * FROM part_m WHERE p_partkey % 2 = 0) SELECT coalesce(p_size, (SELECT quantile_cont(p_size, 0.5) FROM t)) AS p_size, coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM t)) AS p_retailprice, coalesce(p_brand, "
    + MODE.format("p_brand", "t") + ") AS p_brand FROM part_m WHERE p_partkey % 2 = 1",
)

# Donors
WHOLE = "WITH s AS (SELECT * FROM customer_m), lv AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS code FROM (SELECT DISTINCT c_mktsegment FROM s WHERE c_mktsegment IS NOT NULL)), x AS (SELECT s.c_custkey AS id, s.c_nationkey::DOUBLE AS n, s.c_acctbal AS a, s.c_mktsegment AS g, lv.code AS c FROM s LEFT JOIN lv USING (c_mktsegment))"
EUCLID = """, d AS (SELECT r.id AS rid, o.id AS did, o.a, o.c, sqrt(3 * (coalesce(pow(r.n - o.n, 2), 0) + coalesce(pow(r.a - o.a, 2), 0) + coalesce(pow(r.c - o.c, 2), 0))
    / ((r.n IS NOT NULL AND o.n IS NOT NULL)::INT + (r.a IS NOT NULL AND o.a IS NOT NULL)::INT + (r.c IS NOT NULL AND o.c IS NOT NULL)::INT)) AS dist FROM x r, x o WHERE r.id <> o.id),
ka AS (SELECT rid, avg(a) AS a FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS k FROM d WHERE a IS NOT NULL) WHERE k <= 5 GROUP BY 1),
kc AS (SELECT rid, round_even(avg(c), 0) AS c FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS k FROM d WHERE c IS NOT NULL) WHERE k <= 5 GROUP BY 1)
SELECT x.id AS c_custkey, round(coalesce(x.a, ka.a), 4) AS c_acctbal, coalesce(x.g, lv.c_mktsegment) AS c_mktsegment FROM x JOIN ka ON ka.rid = x.id JOIN kc ON kc.rid = x.id LEFT JOIN lv ON lv.code = kc.c"""
balance = lambda d: d.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")
query("impute_knn_euclidean", "customer_m", lambda d: balance(donors.impute_knn(d, "c_custkey")), WHOLE + EUCLID)
GOWER = """, rg AS (SELECT max(n) - min(n) AS rn, max(a) - min(a) AS ra FROM x), d AS (SELECT r.id AS rid, o.id AS did, o.a, o.g, coalesce((coalesce(abs(r.n - o.n) / rn, 0) + coalesce(abs(r.a - o.a) / ra, 0) + coalesce((r.g <> o.g)::INT::DOUBLE, 0))
    / nullif(1 + (r.a IS NOT NULL AND o.a IS NOT NULL)::INT + (r.g IS NOT NULL AND o.g IS NOT NULL)::INT, 0), 1) AS dist FROM x r, x o, rg{})"""
MIXED = GOWER.format(" WHERE r.id <> o.id") + """,
ka AS (SELECT rid, avg(a) AS a FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS k FROM d WHERE a IS NOT NULL) WHERE k <= 5 GROUP BY 1),
kg AS (SELECT rid, g FROM (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, g) AS o FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS k FROM d WHERE g IS NOT NULL) WHERE k <= 5 GROUP BY rid, g) WHERE o = 1)
SELECT x.id AS c_custkey, round(coalesce(x.a, ka.a), 4) AS c_acctbal, coalesce(x.g, kg.g) AS c_mktsegment FROM x JOIN ka ON ka.rid = x.id JOIN kg ON kg.rid = x.id"""
query("impute_knn_gower", "customer_m", lambda d: balance(donors.impute_knn(d, "c_custkey", metric="mixed")), WHOLE + MIXED)
query(
    "gower_pairs",
    "customer_m",
    lambda d: donors.gower_distance(d, "c_custkey", queries=d.where("c_custkey % 100 = 0")).withColumn("distance", F.floor(F.col("distance") * 1e9 + 0.5) / 1e9),
    WHOLE + GOWER.format("") + " SELECT rid AS id_a, did AS id_b, round(dist, 9) AS distance FROM d WHERE rid % 100 = 0",
)
HOT = "SELECT event_id, {} AS event_type, {} AS value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events_m)"
BACK = "last_value({0} IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "first_value({0} IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
three = lambda d: d.select("event_id", "event_type", "value")
for direction, sql in (("forward", BACK), ("backward", AHEAD), ("nearest", f"coalesce({BACK}, {AHEAD})")):
    query(f"hotdeck_{direction}", "events_m", lambda d, direction=direction: donors.impute_hotdeck_sequential(three(d), ORDER, direction), HOT.format(sql.format("event_type"), sql.format("value")))
query(
    "hotdeck_weighted_k1",
    "customer_m",
    lambda d: donors.impute_hotdeck_weighted(d.drop("c_mktsegment"), "c_custkey", n_donors=1),
    """WITH s AS (SELECT * FROM customer_m), d AS (SELECT r.c_custkey AS rid, o.c_acctbal AS a, row_number() OVER (PARTITION BY r.c_custkey ORDER BY abs(r.c_nationkey - o.c_nationkey), o.c_custkey) AS k
    FROM s r, s o WHERE r.c_acctbal IS NULL AND o.c_acctbal IS NOT NULL) SELECT c_custkey, c_nationkey, coalesce(c_acctbal, d.a) AS c_acctbal FROM s LEFT JOIN d ON d.rid = s.c_custkey AND d.k = 1""",
)


def invariants(done, given, row_id):
    return completed_violations(given, done, row_id)


def invariant_query(name, source, impute, row_id, columns, still=()):
    """Register the frame of violations of an imputer; its SQL is all zeros (or ``still`` columns left as they were)."""
    query(name, source, lambda d: invariants(impute(d), d, row_id))
    ORACLES[name] = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, 0::BIGINT AS n_observed_changed, {f'(SELECT count(*) FROM ({VIEWS[source]}) WHERE {c} IS NULL)' if c in still else '0'}::BIGINT AS n_still_missing, 0::BIGINT AS n_rows_lost" for c in columns
    )


CUSTOMER = ("c_nationkey", "c_acctbal", "c_mktsegment")


def drawn(label, key, seed=0):
    """The uniform draw of a row, as gapwise.functions.draws says."""
    return f"('0x' || substr(md5('{seed}/{label}/' || {key}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


def _hotdeck_sql():
    """The donor of each recipient by its number among the observed rows."""
    parts = [f"d_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY c_custkey) AS k FROM customer_m WHERE {c} IS NOT NULL)" for c in CUSTOMER]
    joins = [f"LEFT JOIN d_{c} ON m.{c} IS NULL AND d_{c}.k = floor({drawn(f'hotdeck/{c}', 'm.c_custkey')} * (SELECT count({c}) FROM customer_m))::BIGINT + 1" for c in CUSTOMER]
    return f"WITH {', '.join(parts)} SELECT c_custkey, {', '.join(f'coalesce(m.{c}, d_{c}.v) AS {c}' for c in CUSTOMER)} FROM customer_m m {' '.join(joins)}"


query("hotdeck_random", "customer_m", lambda d: donors.impute_hotdeck_random(d, "c_custkey"), _hotdeck_sql())
invariant_query("hotdeck_weighted", "customer_m", lambda d: donors.impute_hotdeck_weighted(d, "c_custkey"), "c_custkey", ["c_nationkey", "c_acctbal", "c_mktsegment"])

# Simulation
def _line(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


QUERIES["simulate_mcar_counts"] = lambda spark, sf_dir: simulate.simulate_mcar(_line(spark, sf_dir), "o_orderkey", 0.15, columns=["o_custkey", "o_totalprice"], random_state=7).agg(
    F.count_if(F.col("o_custkey").isNull()).alias("custkey"), F.count_if(F.col("o_totalprice").isNull()).alias("totalprice")
)
ORACLES["simulate_mcar_counts"] = "SELECT round_even(count(*) * 0.15, 0)::BIGINT AS custkey, round_even(count(*) * 0.15, 0)::BIGINT AS totalprice FROM orders"


def _prices(done):
    return done.select("o_orderkey", "o_totalprice")


QUERIES["simulate_mar_bias"] = lambda spark, sf_dir: _prices(simulate.simulate_mar(_line(spark, sf_dir), "o_orderkey", 0.2, target_col="o_totalprice", predictor_col="o_custkey"))
ORACLES["simulate_mar_bias"] = f"""SELECT o_orderkey, CASE WHEN {drawn("mar/o_totalprice", "o_orderkey")} < CASE WHEN o_custkey > (SELECT median(o_custkey) FROM orders) THEN 0.4 ELSE 0.1 END THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders"""
QUERIES["simulate_mnar_bias"] = lambda spark, sf_dir: _prices(simulate.simulate_mnar(_line(spark, sf_dir), "o_orderkey", 0.2, target_col="o_totalprice"))
ORACLES["simulate_mnar_bias"] = f"""SELECT o_orderkey, CASE WHEN {drawn("mnar/o_totalprice", "o_orderkey")} < CASE WHEN o_totalprice > (SELECT median(o_totalprice) FROM orders) THEN 0.4 ELSE 0.05 END THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders"""
QUERIES["simulate_mixed"] = lambda spark, sf_dir: _prices(
    simulate.simulate_mixed(_line(spark, sf_dir), "o_orderkey", [{"mechanism": "mcar", "frac": 0.1, "columns": ["o_totalprice"]}, {"mechanism": "mnar", "frac": 0.2, "target_col": "o_totalprice"}])
)
ORACLES["simulate_mixed"] = f"""WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {drawn("mcar/o_totalprice", "o_orderkey")}, o_orderkey) AS k FROM orders),
b AS (SELECT o_orderkey, CASE WHEN k <= (SELECT round_even(count(*) * 0.1, 0) FROM orders) THEN NULL ELSE o_totalprice END AS v FROM a)
SELECT o_orderkey, CASE WHEN {drawn("mnar/o_totalprice", "o_orderkey", 1)} < CASE WHEN v > (SELECT median(v) FROM b) THEN 0.4 ELSE 0.05 END THEN NULL ELSE v END AS o_totalprice FROM b"""

