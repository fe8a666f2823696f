"""The data behind each plot, as frames of plot size; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions import nullity
from gapwise.operators.summary import miss_by_group, miss_case_summary, miss_var_summary
from gapwise.plans.fused import columns_with_missing, missing_counts, scalars

Values = Iterable[object] | None


def pct_labels(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """variable, label: "name (12.3%)"."""
    rows = miss_var_summary(df, missing_values)
    return rows.select("variable", F.format_string("%s (%.1f%%)", "variable", "pct_miss").alias("label"))


def matrix(df: DataFrame, row_id: str, *, missing_values: Values = None, limit: int | None = None) -> DataFrame:
    """Presence of each value and the completeness of each row; ``limit`` rows in order of the id, if given."""
    columns = [c for c in df.columns if c != row_id]
    tests = nullity.flags(df, missing_values, columns)
    n = nullity.row_count(tests.values())
    out = df.select(nullity.column(row_id).alias("row"), *[(~t).alias(c) for c, t in tests.items()], ((F.lit(len(columns)) - n) / max(1, len(columns))).alias("completeness"))
    return out if limit is None else out.orderBy("row").limit(limit)


def miss_which(df: DataFrame, row_id: str, *, missing_values: Values = None) -> DataFrame:
    """The matrix of the columns that miss anything."""
    return matrix(df.select(row_id, *[nullity.column(c) for c in columns_with_missing(df.drop(row_id), missing_values)]), row_id, missing_values=missing_values)


def bar(df: DataFrame, *, sort: bool = False, missing_values: Values = None) -> DataFrame:
    """variable, n_miss, n_complete; the most missing first if ``sort``."""
    counts = missing_counts(df, missing_values).select("variable", "ordinal", "n_miss", (F.col("n_rows") - F.col("n_miss")).alias("n_complete"))
    return counts.orderBy(*([F.desc("n_miss")] if sort else []), "ordinal").drop("ordinal")


def miss_var_pct(df: DataFrame, *, sort: bool = True, missing_values: Values = None) -> DataFrame:
    rows = miss_var_summary(df, missing_values).select("variable", "pct_miss")
    return rows.orderBy("pct_miss", "variable") if sort else rows


def miss_case(df: DataFrame, row_id: str, *, sort: bool = True, missing_values: Values = None) -> DataFrame:
    rows = miss_case_summary(df, row_id, missing_values)
    return rows.orderBy(F.desc("n_miss"), "case") if sort else rows


def gg_miss_var(df: DataFrame, missing_values: Values = None) -> DataFrame:
    return miss_var_summary(df, missing_values).orderBy("n_miss", "variable")


def gg_miss_case(df: DataFrame, row_id: str, missing_values: Values = None) -> DataFrame:
    return miss_case_summary(df, row_id, missing_values)


def gg_miss_fct(df: DataFrame, fct: str, missing_values: Values = None) -> DataFrame:
    """One row per column, the % missing in each level of ``fct`` as a column."""
    long = miss_by_group(df, fct, missing_values).withColumn("group", F.col("group").cast("string"))
    levels = [r.group for r in long.select("group").distinct().orderBy("group").collect()]
    return long.groupBy("variable").pivot("group", levels).agg(F.first("pct_miss"))


def vis_miss_fct(df: DataFrame, fct: str, missing_values: Values = None) -> DataFrame:
    return miss_by_group(df, fct, missing_values)


def miss_row_histogram(df: DataFrame, *, bins: int = 30, missing_values: Values = None) -> DataFrame:
    """bin, low, high, n_rows of the rows' completeness in per cent."""
    from gapwise.operators.patterns import miss_row_profile

    profile = miss_row_profile(df, missing_values=missing_values)
    place = F.least(F.floor(F.col("completeness") / (100 / bins)), F.lit(bins - 1)).cast("int")
    out = profile.groupBy(place.alias("bin")).agg(F.sum("n_rows").alias("n_rows"))
    return out.select("bin", (F.col("bin") * 100.0 / bins).alias("low"), ((F.col("bin") + 1) * 100.0 / bins).alias("high"), "n_rows")


def shadow_scatter(df: DataFrame, x: str, y: str, *, hue: str | None = None, missing_values: Values = None) -> DataFrame:
    """x, y, missing, hue: missing coordinates stand 2 % of the range below the least value."""
    ends = scalars(df, **{f"{s}{i}": f(nullity.value(df, c, missing_values).cast("double")) for i, c in enumerate((x, y)) for s, f in (("a", F.min), ("b", F.max))})

    def shown(i: int, c: str):
        low, high = ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0
        return F.coalesce(nullity.value(df, c, missing_values).cast("double"), F.lit(low - 0.02 * ((high - low) or 1.0)))

    either = nullity.miss(df, x, missing_values) | nullity.miss(df, y, missing_values)
    more = [nullity.column(hue).alias("hue")] if hue else []
    return df.select(shown(0, x).alias("x"), shown(1, y).alias("y"), either.alias("missing"), *more)


scatter_miss = shadow_scatter


def impute_histograms(original: DataFrame, imputed: Mapping[str, DataFrame] | DataFrame, column: str, *, bins: int = 30, missing_values: Values = None) -> DataFrame:
    """frame, bin, low, high, n: histograms over the same edges, of the original and of each imputed frame."""
    frames = imputed if isinstance(imputed, Mapping) else {"imputed": imputed}
    v = nullity.value(original, column, missing_values).cast("double")
    long = original.select(F.lit("original").alias("frame"), v.alias("v"))
    for name, frame in frames.items():
        long = long.unionByName(frame.select(F.lit(name).alias("frame"), nullity.value(frame, column).cast("double").alias("v")))
    long = long.where("v is not null")
    ends = scalars(long, low=F.min("v"), high=F.max("v"))
    low = ends["low"] if ends["low"] is not None else 0.0
    width = ((ends["high"] - low) if ends["high"] is not None else 0.0) / bins or 1.0
    place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    return long.groupBy("frame", place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("frame", "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


vis_impute_dist = impute_histograms
miss_impute_compare = impute_histograms


def vis_parallel_coords(df: DataFrame, *, missing_values: Values = None) -> DataFrame:
    """Numeric columns scaled to 0..1, and has_missing."""
    columns = nullity.numeric_columns(df)
    ends = scalars(df, **{f"{s}{i}": f(nullity.value(df, c, missing_values).cast("double")) for i, c in enumerate(columns) for s, f in (("a", F.min), ("b", F.max))}) if columns else {}
    made = []
    for i, c in enumerate(columns):
        low, high = ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0
        made.append(((nullity.value(df, c, missing_values).cast("double") - F.lit(low)) / F.lit((high - low) or 1.0)).alias(c))
    return df.select(*made, (nullity.row_count(nullity.flags(df, missing_values).values()) > 0).alias("has_missing"))
