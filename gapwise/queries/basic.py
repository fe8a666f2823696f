"""Summaries, shadows, cleaning, patterns, groups, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapwise.operators import cleaning, patterns, provenance, report, shadow, summary, views
from gapwise.queries.registry import COLUMNS, QUERIES, ORACLES, per_column, query
from gapwise.sources.tables import table

EV, OR, LI, CU, PA = (COLUMNS[v] for v in ("events_m", "orders_m", "lineitem_m", "customer_m", "part_m"))


def null_count(columns, sentinel=None):
    return " + ".join(f"(CASE WHEN {c} IS NULL{f' OR {c} = {sentinel[c]}' if sentinel and c in sentinel else ''} THEN 1 ELSE 0 END)" for c in columns)


CELLS = f"(count(*) * {len(EV)})"
MISSES = f"coalesce(sum({null_count(EV)}), 0)"
query("n_miss", "events_m", lambda d: summary.summarise(d).select("n_miss"), f"SELECT {MISSES}::BIGINT AS n_miss FROM events_m")
query("n_complete", "events_m", lambda d: summary.summarise(d).select("n_complete"), f"SELECT ({CELLS} - {MISSES})::BIGINT AS n_complete FROM events_m")
query("pct_miss", "events_m", lambda d: summary.summarise(d).select("pct_miss"), f"SELECT {MISSES}::DOUBLE / {CELLS}::DOUBLE * 100 AS pct_miss FROM events_m")
query("pct_complete", "events_m", lambda d: summary.summarise(d).select("pct_complete"), f"SELECT ({CELLS} - {MISSES})::DOUBLE / {CELLS}::DOUBLE * 100 AS pct_complete FROM events_m")
query(
    "summarise",
    "orders_m",
    summary.summarise,
    f"""SELECT count(*) AS n_rows, 5::BIGINT AS n_cols, count(*) * 5 AS n_cells, sum({null_count(OR)})::BIGINT AS n_miss, (count(*) * 5 - sum({null_count(OR)}))::BIGINT AS n_complete,
    sum({null_count(OR)})::DOUBLE / (count(*) * 5)::DOUBLE * 100 AS pct_miss, (count(*) * 5 - sum({null_count(OR)}))::DOUBLE / (count(*) * 5)::DOUBLE * 100 AS pct_complete FROM orders_m""",
)
VAR = "SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_miss, count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)::DOUBLE * 100 AS pct_miss FROM "
query("miss_var_summary", "events_m", summary.miss_var_summary, per_column("events_m", VAR + "events_m"))
query("accessor_miss_var_summary", "events_m", lambda d: d.miss.miss_var_summary(), per_column("events_m", VAR + "events_m"))
query("miss_var_summary_labels", "labelled_m", summary.miss_var_summary, per_column("labelled_m", VAR + "labelled_m"))
query("n_miss_var", "orders_m", summary.n_miss_var, per_column("orders_m", "SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_miss FROM orders_m"))
query("pct_miss_var", "orders_m", summary.pct_miss_var, per_column("orders_m", "SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)::DOUBLE * 100 AS pct_miss FROM orders_m"))
CASE = f"SELECT event_id AS \"case\", ({null_count(EV[1:])})::BIGINT AS n_miss, ({null_count(EV[1:])})::DOUBLE / 4 * 100 AS pct_miss FROM events_m"
query("miss_case_summary", "events_m", lambda d: summary.miss_case_summary(d, "event_id"), CASE)
query("n_miss_case", "events_m", lambda d: summary.n_miss_case(d, "event_id"), f"SELECT \"case\", n_miss FROM ({CASE})")
query("miss_summary_by_variable", "orders_m", lambda d: summary.miss_summary(d, "o_orderkey")["by_variable"], "SELECT variable, n_miss, round(pct_miss, 2) AS pct_miss FROM (" + per_column("orders_m", VAR + "orders_m", OR[1:]) + ")")
query(
    "null_only_summary",
    "orders_m",
    summary.null_only_summary,
    per_column("orders_m", "SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count({c}) AS n_complete, count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*) AS pct_missing FROM orders_m"),
)

# Sentinels
query("n_miss_sentinel", "events_s", lambda d: summary.summarise(d, [-99.0]).select("n_miss"), f"SELECT sum({null_count(EV, {'value': -99.0, 'event_id': -99, 'user_id': -99})})::BIGINT AS n_miss FROM events_s")
query(
    "miss_var_summary_sentinel",
    "lineitem_m",
    lambda d: summary.miss_var_summary(d, [0.0, "R"]),
    per_column("lineitem_m", "SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL OR {c} = 0) AS n_miss, count(*) FILTER (WHERE {c} IS NULL OR {c} = 0)::DOUBLE / count(*)::DOUBLE * 100 AS pct_miss FROM lineitem_m", LI[:-1])
    + " UNION ALL SELECT 'l_returnflag', count(*) FILTER (WHERE l_returnflag IS NULL OR l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag IS NULL OR l_returnflag = 'R')::DOUBLE / count(*)::DOUBLE * 100 FROM lineitem_m",
)
query(
    "miss_scan_count",
    "lineitem_m",
    lambda d: summary.miss_scan_count(d, [0.0, "N", None]),
    "SELECT * FROM ("
    + per_column("lineitem_m", "SELECT '{c}' AS variable, '0.0' AS value, count(*) FILTER (WHERE {c} = 0) AS n FROM lineitem_m", LI[:-1])
    + " UNION ALL "
    + per_column("lineitem_m", "SELECT '{c}' AS variable, 'NA' AS value, count(*) FILTER (WHERE {c} IS NULL) AS n FROM lineitem_m")
    + " UNION ALL SELECT 'l_returnflag', 'N', count(*) FILTER (WHERE l_returnflag = 'N') FROM lineitem_m) WHERE n > 0",
)
query("replace_with_na_scalar", "events_s", lambda d: shadow.replace_with_na(d, {"value": -99}), "SELECT event_id, ts, user_id, event_type, nullif(value, -99.0) AS value FROM events_s")
query("replace_with_na_list", "lineitem_m", lambda d: shadow.replace_with_na(d, {"l_returnflag": ["N", "R"], "l_discount": [0.0, 0.1]}), "SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN l_discount IN (0.0, 0.1) THEN NULL ELSE l_discount END AS l_discount, l_tax, CASE WHEN l_returnflag IN ('N', 'R') THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem_m")
query("replace_with_na_predicate", "events_m", lambda d: shadow.replace_with_na(d, {"value": lambda c: c > 100}), "SELECT event_id, ts, user_id, event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS value FROM events_m")
query("replace_with_na_all", "lineitem_m", lambda d: shadow.replace_with_na_all(d, lambda c: c == 0, ["l_quantity", "l_discount", "l_tax"]), "SELECT l_orderkey, l_partkey, nullif(l_quantity, 0) AS l_quantity, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag FROM lineitem_m")
query("replace_with_na_python", "events_m", lambda d: shadow.replace_with_na_python(d, "value", lambda s: s > 100), "SELECT event_id, ts, user_id, event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS value FROM events_m")
query("special_missing", "events_s", lambda d: shadow.special_missing(d, {"value": -99.0, "nothing": 1}), "SELECT event_id, ts, user_id, event_type, nullif(value, -99.0) AS value FROM events_s")

# Shadows
FLAGS = ", ".join(f"{c} IS NULL AS \"{c}_NA\"" for c in OR)
query("bind_shadow", "orders_m", shadow.bind_shadow, f"SELECT *, {FLAGS} FROM orders_m")
query("bind_shadow_matrix", "orders_m", shadow.bind_shadow_matrix, f"SELECT {FLAGS} FROM orders_m")
query("shadow_matrix", "orders_m", shadow.shadow_matrix, "SELECT " + ", ".join(f"CASE WHEN {c} IS NULL THEN 'NA' ELSE '!' END AS {c}" for c in OR) + " FROM orders_m")
query("shadow_wide", "orders_m", shadow.shadow_wide, "SELECT " + ", ".join(f"{c} IS NULL AS {c}" for c in OR) + " FROM orders_m")
query(
    "shadow_long",
    "customer_m",
    lambda d: shadow.shadow_long(d, "c_custkey").select("variable", "row", "missing"),
    per_column("customer_m", "SELECT '{c}' AS variable, c_custkey AS row, {c} IS NULL AS missing FROM customer_m", CU[1:]),
)
query("add_any_miss_var", "orders_m", shadow.add_any_miss_var, f"SELECT *, ({null_count(OR)}) > 0 AS any_miss FROM orders_m")
query("miss_as_feature", "part_m", shadow.miss_as_feature, "SELECT *, " + ", ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS \"{c}_NA\"" for c in PA[1:]) + " FROM part_m")

# Cleaning
query("clean_names", "part_m", lambda d: cleaning.clean_names(d.toDF("Part Key", "sizeOf", "retail-price", "Brand")), "SELECT p_partkey AS part_key, p_size AS size_of, p_retailprice AS retail_price, p_brand AS brand FROM part_m")
query("remove_empty_rows", "part_m", lambda d: cleaning.remove_empty(d.drop("p_partkey"), axis="rows"), "SELECT p_size, p_retailprice, p_brand FROM part_m WHERE p_size IS NOT NULL OR p_retailprice IS NOT NULL OR p_brand IS NOT NULL")
query("remove_empty", "part_m", lambda d: cleaning.remove_empty(d, thresh_row=0.5, thresh_col=0.15), "SELECT p_partkey, p_retailprice, p_brand FROM part_m WHERE (" + null_count(PA) + ") < 2")
query("coalesce_columns", "part_m", lambda d: cleaning.coalesce_columns(d, "p_size", "p_retailprice", "p_partkey"), "SELECT p_partkey, coalesce(p_size, p_retailprice, p_partkey)::DOUBLE AS p_size, p_retailprice, p_brand FROM part_m")
query("optimize_dtypes", "customer_m", lambda d: cleaning.optimize_dtypes(d).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.typeof("c_nationkey").alias("kind")), "SELECT c_custkey, 'tinyint' AS kind FROM customer_m")
query("chunk_apply", "customer_m", lambda d: cleaning.chunk_apply(d.select("c_custkey", "c_acctbal"), lambda p: p.assign(c_acctbal=p.c_acctbal * 2), chunk_size=100), "SELECT c_custkey, c_acctbal * 2 AS c_acctbal FROM customer_m")

# Patterns
LABEL = lambda cols: "concat_ws(' + ', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in cols) + ")"
PATTERNS = f"SELECT CASE WHEN p = '' THEN '(complete)' ELSE p END AS pattern, n FROM (SELECT {{}} AS p, count(*) AS n FROM {{}} GROUP BY 1) ORDER BY n DESC, pattern LIMIT {{}}"
query("miss_patterns", "orders_m", lambda d: patterns.miss_patterns(d, top_n=5), PATTERNS.format(LABEL(OR), "orders_m", 5))
query("gg_miss_upset", "lineitem_m", patterns.gg_miss_upset, PATTERNS.format(LABEL(LI), "lineitem_m", 10))
GONE = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
UPSET = "SELECT " + ", ".join(f"{c} IS NULL AS {c}" for c in GONE) + ", count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM orders_m) * 100 AS pct FROM orders_m GROUP BY ALL"
query("upset", "orders_m", patterns.upset, UPSET)
query("upset_min_size", "orders_m", lambda d: patterns.upset(d, min_subset_size=50, include_complete=False), f"SELECT * FROM ({UPSET}) WHERE n >= 50 AND ({' OR '.join(GONE)})")
COOC = " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS n, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL)::DOUBLE / count(*) AS frac FROM orders_m" for a in OR for b in OR)
query("miss_cooccurrence", "orders_m", patterns.miss_cooccurrence, COOC)
PHI = " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr(({a} IS NULL)::INT, ({b} IS NULL)::INT) AS r, count(*) AS n FROM orders_m" for a in GONE for b in GONE
)
query("nullity_correlation", "orders_m", lambda d: patterns.nullity_correlation(d).withColumn("r", F.round("r", 9)), f"SELECT var_a, var_b, round(r, 9) AS r, n FROM ({PHI})")
query("heatmap", "orders_m", lambda d: patterns.heatmap(d).select("var_a", "var_b", F.round("r", 9).alias("r")), f"SELECT var_a, var_b, round(r, 9) AS r FROM ({PHI})")
query("missing_correlation_matrix", "orders_m", lambda d: patterns.missing_correlation_matrix(d, "spearman").select("variable", *[F.round(c, 9).alias(c) for c in GONE]), "SELECT var_a AS variable, " + ", ".join(f"round(max(r) FILTER (WHERE var_b = '{c}'), 9) AS {c}" for c in GONE) + f" FROM ({PHI}) GROUP BY 1")
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
BROKEN = " OR ".join(f"({a} IS NULL AND {b} IS NOT NULL)" for a, b in zip(ORDER, ORDER[1:], strict=False))
query(
    "pattern_monotone_test",
    "orders_m",
    lambda d: patterns.pattern_monotone_test(d).withColumn("sorted_columns", F.array_join("sorted_columns", ",")),
    f"SELECT count(*) FILTER (WHERE {BROKEN}) = 0 AS is_monotone, count(*) FILTER (WHERE {BROKEN}) AS n_violating_rows, '{','.join(ORDER)}' AS sorted_columns, (count(*) - count(*) FILTER (WHERE {BROKEN}))::DOUBLE / count(*) * 100 AS monotone_pct FROM orders_m",
)
PROFILE = f"SELECT ({null_count(OR)})::BIGINT AS n_miss, count(*) AS n_rows FROM orders_m GROUP BY 1"
query("miss_row_profile", "orders_m", patterns.miss_row_profile, f"SELECT n_miss, n_rows, (5 - n_miss)::DOUBLE / 5 * 100 AS completeness FROM ({PROFILE})")
query(
    "miss_row_histogram",
    "orders_m",
    views.miss_row_histogram,
    f"SELECT b::INT AS bin, b * 100.0::DOUBLE / 30 AS low, (b + 1) * 100.0::DOUBLE / 30 AS high, sum(n_rows)::BIGINT AS n_rows FROM (SELECT least(floor(((5 - n_miss)::DOUBLE / 5 * 100) / (100.0::DOUBLE / 30)), 29)::INT AS b, n_rows FROM ({PROFILE})) GROUP BY b",
)
query("vis_miss", "orders_m", lambda d: patterns.vis_miss(d, sort=True), "SELECT " + ", ".join(f"{c} IS NULL AS {c}" for c in OR) + ", count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM orders_m) * 100 AS pct FROM orders_m GROUP BY ALL")
query("miss_cluster", "orders_m", lambda d: patterns.miss_cluster(d).drop("place"), "SELECT " + ", ".join(f"{c} IS NULL AS {c}" for c in OR) + ", count(*) AS n FROM orders_m GROUP BY ALL")
#: Of three columns the closest two are merged first; the third is as far away as their mean.
MERGES = """WITH m AS (SELECT (o_orderstatus IS NULL)::INT AS a, (o_totalprice IS NULL)::INT AS b, (o_orderpriority IS NULL)::INT AS c FROM orders_m),
d AS (SELECT 1 - abs(corr(a, b)) AS ab, 1 - abs(corr(a, c)) AS ac, 1 - abs(corr(b, c)) AS bc FROM m),
f AS (SELECT *, CASE WHEN ab <= ac AND ab <= bc THEN 0 WHEN ac <= bc THEN 1 ELSE 2 END AS k FROM d)
SELECT 0::INT AS step, CASE WHEN k < 2 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS "left", CASE k WHEN 0 THEN 'o_totalprice' ELSE 'o_orderpriority' END AS "right", round(least(ab, ac, bc), 9) AS height, 2::INT AS size FROM f
UNION ALL SELECT 1, CASE k WHEN 2 THEN 'o_orderstatus' ELSE '#0' END, CASE k WHEN 0 THEN 'o_orderpriority' WHEN 1 THEN 'o_totalprice' ELSE '#0' END, round((ab + ac + bc - least(ab, ac, bc)) / 2, 9), 3 FROM f"""
query("dendrogram", "orders_m", lambda d: patterns.dendrogram(d).withColumn("height", F.round("height", 9)), MERGES)
query("vis_miss_cumsum_var", "orders_m", patterns.miss_var_cumsum, "WITH v AS (" + per_column("orders_m", "SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_miss, list_position(['" + "','".join(OR) + "'], '{c}') AS o FROM orders_m") + ") SELECT variable, n_miss, (sum(n_miss) OVER (ORDER BY n_miss DESC, o))::DOUBLE / (sum(n_miss) OVER ())::DOUBLE * 100 AS cum_pct FROM v")
query("vis_miss_cumsum_case", "orders_m", patterns.miss_case_cumsum, f"WITH v AS ({PROFILE}) SELECT n_miss, n_rows, (sum(n_rows) OVER (ORDER BY n_miss DESC))::BIGINT AS cum_rows, (sum(n_miss * n_rows) OVER (ORDER BY n_miss DESC))::DOUBLE / (sum(n_miss * n_rows) OVER ())::DOUBLE * 100 AS cum_pct FROM v")

# Groups and views
EG = ["event_id", "ts", "user_id", "value"]
GROUP = per_column("events_m", "SELECT event_type AS \"group\", '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_miss, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*) * 100 AS pct_miss FROM events_m WHERE event_type IS NOT NULL GROUP BY 1", EG)
query("miss_by_group", "events_m", lambda d: summary.miss_by_group(d, "event_type"), GROUP)
query("vis_miss_fct", "events_m", lambda d: views.vis_miss_fct(d, "event_type"), GROUP)
query("miss_by_lang", "labelled_m", lambda d: summary.miss_by_group(d.select("lang", "quality"), "lang"), "SELECT lang AS \"group\", 'quality' AS variable, count(*) FILTER (WHERE quality IS NULL) AS n_miss, count(*) AS n_rows, count(*) FILTER (WHERE quality IS NULL)::DOUBLE / count(*) * 100 AS pct_miss FROM labelled_m GROUP BY 1")
query("gg_miss_fct", "customer_m", lambda d: views.gg_miss_fct(d.select("c_acctbal", "c_mktsegment"), "c_mktsegment"), "SELECT 'c_acctbal' AS variable, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}' AND c_acctbal IS NULL)::DOUBLE / count(*) FILTER (WHERE c_mktsegment = '{s}') * 100 AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer_m")
query("pct_labels", "orders_m", views.pct_labels, per_column("orders_m", "SELECT '{c}' AS variable, format('{} ({:.1f}%)', '{c}', count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)::DOUBLE * 100) AS label FROM orders_m"))
query("matrix", "customer_m", lambda d: views.matrix(d, "c_custkey"), "SELECT c_custkey AS row, c_nationkey IS NOT NULL AS c_nationkey, c_acctbal IS NOT NULL AS c_acctbal, c_mktsegment IS NOT NULL AS c_mktsegment, (3 - (" + null_count(CU[1:]) + "))::DOUBLE / 3 AS completeness FROM customer_m")
query("miss_which", "customer_m", lambda d: views.miss_which(d, "c_custkey"), "SELECT c_custkey AS row, c_acctbal IS NOT NULL AS c_acctbal, c_mktsegment IS NOT NULL AS c_mktsegment, (2 - (" + null_count(CU[2:]) + "))::DOUBLE / 2 AS completeness FROM customer_m")
query("bar", "orders_m", lambda d: views.bar(d, sort=True), per_column("orders_m", "SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_miss, count({c}) AS n_complete FROM orders_m"))
query("miss_var_pct", "orders_m", views.miss_var_pct, "SELECT variable, pct_miss FROM (" + per_column("orders_m", VAR + "orders_m") + ")")
query("gg_miss_var", "orders_m", views.gg_miss_var, per_column("orders_m", VAR + "orders_m"))
query("miss_case", "events_m", lambda d: views.miss_case(d, "event_id"), CASE)
query("gg_miss_case", "events_m", lambda d: views.gg_miss_case(d, "event_id"), CASE)
ENDS = "(SELECT min({0}) FROM {1}) - 0.02 * ((SELECT max({0}) FROM {1}) - (SELECT min({0}) FROM {1}))"
query("shadow_scatter", "part_m", lambda d: views.shadow_scatter(d, "p_size", "p_retailprice", hue="p_brand").withColumns({c: F.round(c, 6) for c in "xy"}), f"SELECT round(coalesce(p_size::DOUBLE, {ENDS.format('p_size', 'part_m')}), 6) AS x, round(coalesce(p_retailprice, {ENDS.format('p_retailprice', 'part_m')}), 6) AS y, p_size IS NULL OR p_retailprice IS NULL AS missing, p_brand AS hue FROM part_m")
query("vis_parallel_coords", "part_m", lambda d: views.vis_parallel_coords(d.drop("p_partkey")).withColumns({c: F.round(c, 9) for c in ("p_size", "p_retailprice")}), "SELECT round((p_size - (SELECT min(p_size) FROM part_m))::DOUBLE / ((SELECT max(p_size) FROM part_m) - (SELECT min(p_size) FROM part_m)), 9) AS p_size, round((p_retailprice - (SELECT min(p_retailprice) FROM part_m)) / ((SELECT max(p_retailprice) FROM part_m) - (SELECT min(p_retailprice) FROM part_m)), 9) AS p_retailprice, (" + null_count(PA[1:]) + ") > 0 AS has_missing FROM part_m")

# Report and provenance
query("report_overview", "orders_m", report.report_overview, "SELECT *, CASE WHEN pct_miss = 0 THEN 'none' WHEN pct_miss < 5 THEN 'low' WHEN pct_miss < 20 THEN 'moderate' ELSE 'high' END AS severity FROM (" + per_column("orders_m", VAR + "orders_m") + ")")
query("report_totals", "orders_m", report.report_totals, f"SELECT count(*) AS n_rows, 5::BIGINT AS n_cols, sum({null_count(OR)})::BIGINT AS n_miss, sum({null_count(OR)})::DOUBLE / (count(*) * 5)::DOUBLE * 100 AS pct_miss, count(*) FILTER (WHERE ({null_count(OR)}) > 0) AS n_incomplete_rows FROM orders_m")
query("report_worst_rows", "events_m", lambda d: report.report_worst_rows(d, "event_id"), f"SELECT * FROM ({CASE}) WHERE n_miss > 0 ORDER BY n_miss DESC, \"case\" LIMIT 10")
QUERIES["row_fingerprint"] = lambda spark, sf_dir: provenance.row_fingerprints(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
ORACLES["row_fingerprint"] = "SELECT n_nationkey AS row, sha256(n_nationkey::VARCHAR || chr(31) || n_name || chr(31) || n_regionkey::VARCHAR) AS sha256 FROM nation"
QUERIES["dataframe_fingerprint"] = lambda spark, sf_dir: spark.createDataFrame(
    [(provenance.dataframe_fingerprint(t := table(spark, sf_dir, "nation")) == provenance.dataframe_fingerprint(t.orderBy(F.desc("n_name"))),)], "order_free boolean"
)
ORACLES["dataframe_fingerprint"] = "SELECT true AS order_free"
