"""Plans that several operators share: one scan for all columns, and the table of missing patterns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions import nullity


def melted(wide: DataFrame, entries: Sequence[tuple[str, Mapping[str, Column]]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per entry: variable, ordinal, and its fields, from the columns of ``wide``."""
    rows = [F.struct(F.lit(name).alias("variable"), F.lit(i).alias("ordinal"), *[c.alias(k) for k, c in fields.items()]) for i, (name, fields) in enumerate(entries)]
    if not rows:
        empty = wide.select(*keep, F.lit("").alias("variable"), F.lit(0).alias("ordinal"), F.lit(0).cast("bigint").alias("n_miss"), F.lit(0).cast("bigint").alias("n_rows"))
        return empty.where(F.lit(False))
    return wide.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")


def missing_counts(df: DataFrame, missing_values: Iterable[object] | None = None, *, by: Sequence[str] = (), columns: Sequence[str] | None = None, nan_is_missing: bool = True) -> DataFrame:
    """variable, ordinal, n_miss, n_rows (per group): a single scan and one partial aggregate for all columns."""
    columns = [c for c in columns or df.columns if c not in by]
    tests = {c: nullity.miss(df, c, missing_values, nan_is_missing=nan_is_missing) for c in columns}
    wide = df.groupBy(*[nullity.column(c) for c in by]).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(t).alias(f"__m{i}") for i, t in enumerate(tests.values())]
    )
    return melted(wide, [(c, {"n_miss": F.col(f"__m{i}"), "n_rows": F.col("__n")}) for i, c in enumerate(columns)], keep=[f"`{c}`" for c in by])


def columns_with_missing(df: DataFrame, missing_values: Iterable[object] | None = None) -> list[str]:
    """Names of the columns with any missing value, in order: one aggregate."""
    rows = missing_counts(df, missing_values).where("n_miss > 0").orderBy("ordinal").collect()
    return [r.variable for r in rows]


def pattern_table(df: DataFrame, missing_values: Iterable[object] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct missing pattern: a boolean per column, and n.

    At most min(rows, 2**columns) rows, so what is rolled up from it no longer depends on the row count.
    """
    tests = nullity.flags(df, missing_values, columns)
    return df.select(*[t.alias(c) for c, t in tests.items()]).groupBy(*[nullity.column(c) for c in tests]).agg(F.count(F.lit(1)).alias("__n"))


def scalars(df: DataFrame, **aggregates: Column) -> dict[str, object]:
    """Aggregates of the frame as Python values, by one job."""
    return df.agg(*[c.alias(k) for k, c in aggregates.items()]).first().asDict()
