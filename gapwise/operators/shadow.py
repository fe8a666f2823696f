"""Shadow columns and replacement of values by missing ones: projections without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError
from gapwise.functions import nullity
from gapwise.operators.validate import validate_columns
from gapwise.plans.fused import columns_with_missing

Values = Iterable[object] | None


def bind_shadow(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """All columns, then a boolean ``<column>_NA`` for each."""
    return df.select("*", *[t.alias(f"{c}_NA") for c, t in nullity.flags(df, missing_values).items()])


def bind_shadow_matrix(df: DataFrame, missing_values: Values = None) -> DataFrame:
    return df.select(*[t.alias(f"{c}_NA") for c, t in nullity.flags(df, missing_values).items()])


def shadow_matrix(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """"NA" where missing, "!" elsewhere, under the original names."""
    return df.select(*[F.when(t, "NA").otherwise("!").alias(c) for c, t in nullity.flags(df, missing_values).items()])


def shadow_wide(df: DataFrame, missing_values: Values = None) -> DataFrame:
    return df.select(*[t.alias(c) for c, t in nullity.flags(df, missing_values).items()])


def shadow_long(df: DataFrame, row_id: str, missing_values: Values = None) -> DataFrame:
    """variable, row, value (as text), missing: one row per cell."""
    cells = [
        F.struct(F.lit(c).alias("variable"), nullity.column(c).cast("string").alias("value"), nullity.miss(df, c, missing_values).alias("missing"))
        for c in df.columns
        if c != row_id
    ]
    return df.select(nullity.column(row_id).alias("row"), F.explode(F.array(*cells)).alias("c")).select("c.variable", "row", "c.value", "c.missing")


def add_any_miss_var(df: DataFrame, missing_values: Values = None, col_name: str = "any_miss") -> DataFrame:
    if col_name in df.columns:
        raise ConfigurationError("col_name", col_name, "is a column already")
    tests = list(nullity.flags(df, missing_values).values())
    return df.withColumn(col_name, nullity.row_count(tests) > 0)


def miss_as_feature(df: DataFrame, columns: Sequence[str] | None = None, *, missing_values: Values = None, suffix: str = "_NA", keep_original: bool = True) -> DataFrame:
    """A 0/1 column after each chosen column; by default after those with anything missing (one aggregate)."""
    chosen = set(validate_columns(df, columns) if columns is not None else columns_with_missing(df, missing_values))
    out: list[Column] = []
    for c in df.columns:
        if keep_original or c not in chosen:
            out.append(nullity.column(c))
        if c in chosen:
            out.append(nullity.miss(df, c, missing_values).cast("int").alias(f"{c}{suffix}"))
    return df.select(*out)


def _dropped(df: DataFrame, name: str, test: Column | None) -> Column:
    c = nullity.column(name)
    return c if test is None else F.when(~F.coalesce(test, F.lit(False)), c).alias(name)


def _test(df: DataFrame, name: str, rule: object) -> Column | None:
    """A rule as a condition: a value, a list of values, a function of the Column, or of a pandas Series."""
    if callable(rule):
        try:
            made = rule(nullity.column(name))
        except TypeError:
            return None
        return made if isinstance(made, Column) else None
    found = None
    for v in rule if isinstance(rule, (list, tuple, set)) else [rule]:
        test = nullity.miss(df, name) if nullity._empty(v) else nullity.matches(df, name, v)
        if test is not None:
            found = test if found is None else found | test
    return found


def replace_with_na(df: DataFrame, replace: Mapping[str, object]) -> DataFrame:
    """NULL where a column's rule holds. Functions get the Column and return a condition."""
    validate_columns(df, list(replace), param="replace")
    return df.select(*[_dropped(df, c, _test(df, c, replace[c])) if c in replace else nullity.column(c) for c in df.columns])


def replace_with_na_all(df: DataFrame, condition: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """NULL wherever the condition on a cell holds; by default over the numeric columns and, for text conditions, name them."""
    chosen = set(validate_columns(df, columns) if columns is not None else nullity.numeric_columns(df))
    return df.select(*[_dropped(df, c, condition(nullity.column(c))) if c in chosen else nullity.column(c) for c in df.columns])


def replace_with_na_python(df: DataFrame, name: str, condition: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """For conditions that only Python can tell: an Arrow-batched function of a pandas Series."""
    test = F.pandas_udf(lambda s: condition(s).astype(bool), "boolean")
    return df.select(*[_dropped(df, c, test(nullity.column(c))) if c == name else nullity.column(c) for c in df.columns])


def special_missing(df: DataFrame, replacements: Mapping[str, object]) -> DataFrame:
    """Like replace_with_na for values only; unknown columns are ignored."""
    return replace_with_na(df, {c: v for c, v in replacements.items() if c in df.columns and not callable(v)})
