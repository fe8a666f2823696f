"""Missing patterns and what is rolled up from them."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.errors import InvalidStrategyError
from gapwise.functions import nullity
from gapwise.functions.distributions import t_sf2
from gapwise.plans.fused import columns_with_missing, melted, missing_counts, pattern_table, scalars
from gapwise.plans.linkage import leaf_order, ward
from gapwise.plans.ordered import with_position
from gapwise.plans.products import cross_products

Values = Iterable[object] | None


def miss_patterns(df: DataFrame, *, top_n: int = 10, missing_values: Values = None) -> DataFrame:
    """pattern ("a + b", or "(complete)"), n: the most frequent, ties by label."""
    table = pattern_table(df, missing_values)
    label = F.concat_ws(" + ", *[F.when(nullity.column(c), F.lit(c)) for c in df.columns])
    named = table.select(F.when(label == "", "(complete)").otherwise(label).alias("pattern"), F.col("__n").alias("n"))
    return named.orderBy(F.desc("n"), "pattern").limit(top_n)


def upset(df: DataFrame, *, min_subset_size: int = 1, missing_values: Values = None, include_complete: bool = True, max_patterns: int | None = None) -> DataFrame:
    """Distinct patterns over the columns with anything missing: a boolean each, n, pct."""
    columns = columns_with_missing(df, missing_values)
    if not columns:
        return df.sparkSession.createDataFrame([], "n bigint, pct double")
    n_rows = df.count()
    table = pattern_table(df, missing_values, columns).withColumnRenamed("__n", "n").where(F.col("n") >= min_subset_size)
    if not include_complete:
        table = table.where(nullity.row_count(nullity.column(c) for c in columns) > 0)
    table = table.withColumn("pct", F.col("n") / F.lit(n_rows) * 100)
    if max_patterns is not None:
        table = table.orderBy(F.desc("n"), *[nullity.column(c) for c in columns]).limit(max_patterns)
    return table


def gg_miss_upset(df: DataFrame, missing_values: Values = None, n_sets: int = 10) -> DataFrame:
    """The ``n_sets`` most frequent patterns, the complete one included."""
    return miss_patterns(df, top_n=n_sets, missing_values=missing_values)


def miss_cooccurrence(df: DataFrame, *, normalize: bool = True, missing_values: Values = None) -> DataFrame:
    """var_a, var_b, n (both missing), and frac of all rows, for every pair; one aggregate over the patterns."""
    table = pattern_table(df, missing_values)
    pairs = [(a, b) for a in df.columns for b in df.columns]
    both = lambda a, b: F.sum(F.when(nullity.column(a) & nullity.column(b), F.col("__n")).otherwise(0))
    keys = list(combinations_with_replacement(df.columns, 2))
    wide = table.agg(F.sum("__n").alias("total"), *[F.coalesce(both(a, b), F.lit(0)).alias(f"p{i}") for i, (a, b) in enumerate(keys)])
    place = {frozenset(k): i for i, k in enumerate(keys)}
    rows = [(a, {"var_b": F.lit(b), "n": F.col(f"p{place[frozenset((a, b))]}"), "total": F.col("total")}) for a, b in pairs]
    out = melted(wide, rows).select(F.col("variable").alias("var_a"), "var_b", F.col("n").cast("bigint").alias("n"), "total")
    frac = F.when(F.col("total") > 0, F.col("n") / F.nullif(F.col("total"), F.lit(0))).otherwise(0.0)
    return out.select("var_a", "var_b", "n", frac.alias("frac")) if normalize else out.select("var_a", "var_b", "n")


def nullity_correlation(df: DataFrame, method: str = "pearson", missing_values: Values = None) -> DataFrame:
    """var_a, var_b, r for pairs of columns with both missing and present values.

    On indicators Pearson, Spearman, Kendall's tau-b and phi are one number, from three counts per pair:
    r = (n n11 - n1 n2) / sqrt(n1 (n - n1) n2 (n - n2)); null for a constant column.
    """
    if method not in ("pearson", "phi", "spearman", "kendall"):
        raise InvalidStrategyError("method", method, ("pearson", "phi", "spearman", "kendall"))
    columns = columns_with_missing(df, missing_values)
    table = pattern_table(df, missing_values, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "var_a string, var_b string, r double")
    keys = list(combinations_with_replacement(columns, 2))
    both = [F.sum(F.when(nullity.column(a) & nullity.column(b), F.col("__n")).otherwise(0)).alias(f"p{i}") for i, (a, b) in enumerate(keys)]
    wide = table.agg(F.sum("__n").cast("double").alias("n"), *both)
    place = {frozenset(k): F.col(f"p{i}").cast("double") for i, k in enumerate(keys)}
    rows = []
    for a in columns:
        for b in columns:
            n1, n2, n11 = place[frozenset((a,))], place[frozenset((b,))], place[frozenset((a, b))]
            scale = F.sqrt(n1 * (F.col("n") - n1)) * F.sqrt(n2 * (F.col("n") - n2))
            rows.append((a, {"var_b": F.lit(b), "r": (F.col("n") * n11 - n1 * n2) / F.nullif(scale, F.lit(0.0)), "n": F.col("n")}))
    return melted(wide, rows).select(F.col("variable").alias("var_a"), "var_b", "r", F.col("n").cast("bigint").alias("n"))


def heatmap(df: DataFrame, *, mask_insignificant: bool = True, significance: float = 0.05, method: str = "pearson", missing_values: Values = None) -> DataFrame:
    """var_a, var_b, r, p_value, masked: the diagonal, undefined and insignificant pairs are masked.

    The correlation table has columns squared rows, so the p-values of Student's t are added on the driver.
    """
    rows = []
    for a, b, r, n in nullity_correlation(df, method, missing_values).collect():
        if r is None or n < 3:
            p = None
        elif abs(r) >= 1 - 1e-15:
            p = 0.0
        else:
            p = t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((a, b, r, p, a == b or r is None or (mask_insignificant and (p is None or p >= significance))))
    return df.sparkSession.createDataFrame(rows, "var_a string, var_b string, r double, p_value double, masked boolean")


def missing_correlation_matrix(df: DataFrame, method: str = "pearson", missing_values: Values = None) -> DataFrame:
    """One row per column with missing values, a column per partner."""
    long = nullity_correlation(df, method, missing_values)
    names = [r.var_a for r in long.select("var_a").distinct().orderBy("var_a").collect()]
    return long.groupBy(F.col("var_a").alias("variable")).pivot("var_b", names).agg(F.first("r"))


def pattern_monotone_test(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """One row: is_monotone, n_violating_rows, sorted_columns, monotone_pct.

    Columns go by rising missing rate; a row violates the order if a value is observed after a missing one.
    """
    rates = missing_counts(df, missing_values).orderBy("n_miss", "ordinal").collect()
    order = [r.variable for r in rates]
    table = pattern_table(df, missing_values)
    breaks = [nullity.column(a) & ~nullity.column(b) for a, b in zip(order, order[1:], strict=False)]
    broken = nullity.row_count(breaks) > 0
    totals = table.agg(F.coalesce(F.sum(F.when(broken, F.col("__n")).otherwise(0)), F.lit(0)).alias("bad"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))
    return totals.select(
        (F.col("bad") == 0).alias("is_monotone"),
        F.col("bad").alias("n_violating_rows"),
        F.array(*[F.lit(c) for c in order]).alias("sorted_columns"),
        F.when(F.col("n") > 0, (F.col("n") - F.col("bad")) / F.nullif(F.col("n"), F.lit(0)) * 100).otherwise(100.0).alias("monotone_pct"),
    )


def miss_row_profile(df: DataFrame, *, bins: int = 30, missing_values: Values = None) -> DataFrame:
    """n_miss, n_rows, completeness: how many rows miss how many values."""
    n = nullity.row_count(nullity.flags(df, missing_values).values())
    width = max(1, len(df.columns))
    return df.groupBy(n.alias("n_miss")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("completeness", (F.lit(width) - F.col("n_miss")) / width * 100)


def linkage(distance: np.ndarray, weights: np.ndarray, method: str = "average") -> list[tuple[int, int, float, float]]:
    """Agglomerative clustering of a small matrix by Lance-Williams updates: (a, b, height, weight) per merge."""
    d, size = distance.astype(float).copy(), {i: float(w) for i, w in enumerate(weights)}
    active, where, merges = list(range(len(d))), {i: i for i in range(len(d))}, []
    np.fill_diagonal(d, np.inf)
    while len(active) > 1:
        sub = d[np.ix_(active, active)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = active[min(i, j)], active[max(i, j)]
        h, na, nb = d[a, b], size[a], size[b]
        for c in active:
            if c in (a, b):
                continue
            if method == "ward":
                nc = size[c]
                new = math.sqrt(max(0.0, ((na + nc) * d[a, c] ** 2 + (nb + nc) * d[b, c] ** 2 - nc * h**2) / (na + nb + nc)))
            else:
                new = (na * d[a, c] + nb * d[b, c]) / (na + nb)
            d[a, c] = d[c, a] = new
        merges.append((where[a], where[b], float(h), na + nb))
        where[a], size[a] = len(distance) + len(merges) - 1, na + nb
        active.remove(b)
    return merges


def leaves(n: int, merges: list[tuple[int, int, float, float]]) -> list[int]:
    """The order of the items along the tree."""
    members = {i: [i] for i in range(n)}
    for k, (a, b, _, _) in enumerate(merges):
        members[n + k] = members.pop(a) + members.pop(b)
    return [i for group in members.values() for i in group]


def dendrogram(df: DataFrame, missing_values: Values = None, method: str = "average") -> DataFrame:
    """step, left, right, height, size of the merges of columns at distance 1 - |r|."""
    columns = columns_with_missing(df, missing_values)
    at = {c: i for i, c in enumerate(columns)}
    d = np.ones((len(columns), len(columns)))
    for a, b, r, _ in nullity_correlation(df, "pearson", missing_values).collect():
        d[at[a], at[b]] = 0.0 if a == b else 1 - abs(r or 0.0)
    merges = linkage(d, np.ones(len(columns)), method)
    name = lambda i: columns[i] if i < len(columns) else f"#{i - len(columns)}"
    rows = [(k, name(a), name(b), h, int(w)) for k, (a, b, h, w) in enumerate(merges)]
    return df.sparkSession.createDataFrame(rows, "step int, left string, right string, height double, size int")


def _column_order(table: DataFrame, columns: list[str]) -> list[str]:
    """The columns along a Ward tree of their indicators; two are apart by the root of the rows in which they differ."""
    if len(columns) < 2:
        return columns
    indicators = [nullity.column(c).cast("double") for c in columns]
    both = cross_products(table, indicators, F.col("__n"))
    n = both[None][1] if both else np.zeros((len(columns), len(columns)))
    apart = np.sqrt(np.maximum(np.diag(n)[:, None] + np.diag(n)[None, :] - 2 * n, 0.0))
    return [columns[i] for i in leaves(len(columns), linkage(apart, np.ones(len(columns)), "ward"))]


def miss_cluster(df: DataFrame, *, missing_values: Values = None, method: str = "ward", max_patterns: int | None = None) -> DataFrame:
    """Patterns in the order of Ward clusterings of rows and of columns: a boolean per column, n, place.

    Equal rows are merged at height 0, so distinct patterns weighted by their rows give the same tree. All patterns are
    clustered: the driver holds one centroid for each, tasks look for the nearest ones (``plans.linkage``). With
    ``max_patterns`` only the commonest are, and the others stand after them by falling frequency. The columns of the result
    stand in the order of their own tree.
    """
    if method != "ward":
        raise InvalidStrategyError("method", method, ("ward",))
    table = pattern_table(df, missing_values)
    if max_patterns is not None:
        table = table.orderBy(F.desc("__n"), *[nullity.column(c) for c in df.columns])
    columns = _column_order(pattern_table(df, missing_values), df.columns)
    wanted = table.select(*[nullity.column(c).alias(f"__h{i}") for i, c in enumerate(columns)], "__n")
    rows = (wanted if max_patterns is None else wanted.limit(max_patterns + 1)).toArrow()
    more = max_patterns is not None and rows.num_rows > max_patterns
    if more:
        rows = rows.slice(0, max_patterns)
    # The smallest pattern, as a number read from the left, is the first point, so ties don't hang on the order of arrival.
    rows = rows.sort_by([(name, "ascending") for name in rows.column_names])
    x = np.column_stack([c.to_numpy() for c in rows.columns[:-1]]).astype(float) if columns else np.zeros((rows.num_rows, 0))
    order = leaf_order(rows.num_rows, ward(df.sparkSession, x, rows.column("__n").to_numpy()))
    placed = rows.take(pa.array(order, pa.int64())).rename_columns([*columns, "n"]).append_column("place", pa.array(range(len(order)), pa.int64()))
    schema = T.StructType([*[T.StructField(c, T.BooleanType()) for c in columns], T.StructField("n", T.LongType()), T.StructField("place", T.LongType())])
    out = df.sparkSession.createDataFrame(placed, schema)
    if not more:
        return out
    head = out.select(*[nullity.column(c).alias(f"__h{i}") for i, c in enumerate(columns)])
    same = [nullity.column(c) == F.col(f"__h{i}") for i, c in enumerate(columns)]
    rest = pattern_table(df, missing_values).join(F.broadcast(head), same, "left_anti")
    rest = with_position(rest.withColumn("__at", -F.col("__n")), ["__at", *columns])
    place = F.col("__pos") + F.lit(len(order) - 1)
    return out.unionAll(rest.select(*[nullity.column(c) for c in columns], F.col("__n").alias("n"), place.alias("place")))


def vis_miss(df: DataFrame, *, sort: bool = False, cluster: bool = False, missing_values: Values = None) -> DataFrame:
    """The null tiles by pattern: n, pct of all rows, columns in order of their missing count if ``sort``."""
    if cluster:
        return miss_cluster(df, missing_values=missing_values).select(*[nullity.column(c) for c in df.columns], "n", "place")
    columns = df.columns
    if sort:
        columns = [r.variable for r in missing_counts(df, missing_values).orderBy(F.desc("n_miss"), "ordinal").collect()]
    table = pattern_table(df, missing_values)
    total = scalars(table, n=F.sum("__n"))["n"] or 1
    return table.select(*[nullity.column(c) for c in columns], F.col("__n").alias("n"), (F.col("__n") / F.lit(total) * 100).alias("pct"))


def miss_var_cumsum(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """variable, n_miss, cum_pct: the share of all missing cells up to each column, the worst first."""
    counts = missing_counts(df, missing_values)
    down = Window.orderBy(F.desc("n_miss"), "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return counts.select("variable", "n_miss", nullity.percent(F.sum("n_miss").over(down), F.sum("n_miss").over(every)).alias("cum_pct"))


def miss_case_cumsum(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """n_miss, n_rows, cum_rows, cum_pct: rows by falling missing count; only as many rows as counts exist are sorted."""
    profile = miss_row_profile(df, missing_values=missing_values).select("n_miss", "n_rows")
    down = Window.orderBy(F.desc("n_miss")).rowsBetween(Window.unboundedPreceding, 0)
    cells = F.col("n_miss") * F.col("n_rows")
    return profile.select(
        "n_miss",
        "n_rows",
        F.sum("n_rows").over(down).alias("cum_rows"),
        nullity.percent(F.sum(cells).over(down), F.sum(cells).over(Window.partitionBy())).alias("cum_pct"),
    )
