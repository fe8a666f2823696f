"""Missingness summaries: one scan and one partial aggregate each, whatever the number of columns."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions import nullity
from gapwise.plans.fused import missing_counts

Values = Iterable[object] | None


def summarise(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """One row: n_rows, n_cols, n_cells, n_miss, n_complete, pct_miss, pct_complete; zeros for an empty frame."""
    n_cols = len(df.columns)
    per_row = nullity.row_count(nullity.flags(df, missing_values).values())
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(per_row), F.lit(0)).alias("n_miss"))
    cells = (F.col("n_rows") * n_cols).cast("bigint")
    complete = cells - F.col("n_miss")
    return totals.select(
        "n_rows",
        F.lit(n_cols).cast("bigint").alias("n_cols"),
        cells.alias("n_cells"),
        "n_miss",
        complete.alias("n_complete"),
        nullity.percent(F.col("n_miss"), cells).alias("pct_miss"),
        nullity.percent(complete, cells).alias("pct_complete"),
    )


def n_miss(df: DataFrame, missing_values: Values = None) -> int:
    return summarise(df, missing_values).first()["n_miss"]


def n_complete(df: DataFrame, missing_values: Values = None) -> int:
    return summarise(df, missing_values).first()["n_complete"]


def pct_miss(df: DataFrame, missing_values: Values = None) -> float:
    return summarise(df, missing_values).first()["pct_miss"]


def pct_complete(df: DataFrame, missing_values: Values = None) -> float:
    row = summarise(df, missing_values).first()
    return row["pct_complete"] if row["n_cells"] else 100.0


def miss_var_summary(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """variable, n_miss, pct_miss per column, in column order."""
    counts = missing_counts(df, missing_values)
    return counts.select("variable", "n_miss", nullity.percent(F.col("n_miss"), F.col("n_rows")).alias("pct_miss"))


def miss_case_summary(df: DataFrame, row_id: str, missing_values: Values = None) -> DataFrame:
    """case, n_miss, pct_miss per row: a projection without a shuffle. ``row_id`` names rows and isn't counted."""
    columns = [c for c in df.columns if c != row_id]
    n = nullity.row_count(nullity.flags(df, missing_values, columns).values())
    return df.select(nullity.column(row_id).alias("case"), n.alias("n_miss"), nullity.percent(n, F.lit(len(columns))).alias("pct_miss"))


def miss_summary(df: DataFrame, row_id: str, missing_values: Values = None, digits: int = 2) -> dict[str, DataFrame]:
    """summary, by_variable and by_case, percentages rounded to ``digits``."""
    parts = {"summary": summarise(df.drop(row_id), missing_values), "by_variable": miss_var_summary(df.drop(row_id), missing_values), "by_case": miss_case_summary(df, row_id, missing_values)}
    return {k: f.withColumns({c: F.round(c, digits) for c in f.columns if c.startswith("pct_")}) for k, f in parts.items()}


def n_miss_var(df: DataFrame, missing_values: Values = None) -> DataFrame:
    return miss_var_summary(df, missing_values).select("variable", "n_miss")


def pct_miss_var(df: DataFrame, missing_values: Values = None) -> DataFrame:
    return miss_var_summary(df, missing_values).select("variable", "pct_miss")


def n_miss_case(df: DataFrame, row_id: str, missing_values: Values = None) -> DataFrame:
    return miss_case_summary(df, row_id, missing_values).select("case", "n_miss")


def null_only_summary(df: DataFrame) -> DataFrame:
    """variable, n_missing, n_complete, pct_missing under the policy that NaN is a value."""
    counts = missing_counts(df, nan_is_missing=False)
    pct = F.when(F.col("n_rows") == 0, 0.0).otherwise(F.col("n_miss") * 100.0 / F.nullif(F.col("n_rows"), F.lit(0)))
    return counts.select("variable", F.col("n_miss").alias("n_missing"), (F.col("n_rows") - F.col("n_miss")).alias("n_complete"), pct.alias("pct_missing"))


def miss_scan_count(df: DataFrame, search: object, missing_values: Values = None) -> DataFrame:
    """variable, value, n for every searched value that a column holds; None and NaN count what is missing.

    Values of a type that the column can't hold are skipped. One aggregate over all columns and values.
    """
    wanted: Sequence[object] = list(search) if isinstance(search, (list, tuple, set)) else [search]
    tests = []
    for c in df.columns:
        for v in wanted:
            test = nullity.miss(df, c, missing_values) if nullity._empty(v) else nullity.matches(df, c, v)
            if test is not None:
                tests.append((c, "NA" if nullity._empty(v) else str(v), test))
    if not tests:
        return df.sparkSession.createDataFrame([], "variable string, value string, n bigint")
    wide = df.agg(*[F.count_if(t).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)])
    rows = [F.struct(F.lit(c).alias("variable"), F.lit(v).alias("value"), F.col(f"t{i}").alias("n")) for i, (c, v, _) in enumerate(tests)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0")


def miss_by_group(df: DataFrame, group_col: str, missing_values: Values = None, *, keep_null_group: bool = False) -> DataFrame:
    """group, variable, n_miss, n_rows, pct_miss; rows without a group are left out unless asked for."""
    rows = df if keep_null_group else df.where(~nullity.miss(df, group_col, missing_values))
    counts = missing_counts(rows, missing_values, by=[group_col])
    return counts.select(
        nullity.column(group_col).alias("group"), "variable", "n_miss", "n_rows", nullity.percent(F.col("n_miss"), F.col("n_rows")).alias("pct_miss")
    )


def warn_if_pairs(n_left: int, n_right: int, what: str) -> None:
    """The pairwise operators are exact and cost rows times donors; say so where that is much."""
    from gapwise.config import config

    if max(n_left, n_right) > config.large_df_threshold:
        warnings.warn(f"{what} compares {n_left} x {n_right} rows", stacklevel=3)


def warn_if_categorical(n_categorical: int, n_columns: int, n_neighbors: int) -> None:
    """Places of categories are no distances: say so where most columns are categories and many neighbours are averaged."""
    from gapwise.config import config

    if 2 * n_categorical > n_columns and n_neighbors > config.knn_cat_neighbors_threshold:
        warnings.warn(f"{n_categorical} of {n_columns} columns are categories, and the mean of {n_neighbors} neighbours' places says little of them", stacklevel=3)
