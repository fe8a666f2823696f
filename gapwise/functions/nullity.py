"""What counts as missing: the one place that knows NULL, NaN and sentinels.

Sentinels are matched by type, so a number never meets a string column: comparisons that ANSI mode would
reject aren't built at all.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numbers proper: booleans and times aren't."""
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [c for c in columns or df.columns if is_numeric(df, c)]


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def _empty(value: object) -> bool:
    return value is None or (isinstance(value, float) and math.isnan(value))


def matches(df: DataFrame, name: str, value: object) -> Column | None:
    """The test for one sentinel, or None where the types can't match."""
    kind, c = df.schema[name].dataType, column(name)
    if isinstance(value, bool):
        return c == F.lit(value) if isinstance(kind, T.BooleanType) else None
    if isinstance(value, (int, float, Decimal)):
        if not isinstance(kind, T.NumericType):
            return None
        return c == F.lit(value) if isinstance(kind, T.DecimalType) else c.cast("double") == F.lit(float(value))
    if isinstance(value, str):
        return c == F.lit(value) if isinstance(kind, T.StringType) else None
    if isinstance(value, (dt.datetime, dt.date)):
        return c == F.lit(value) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None
    return None


def miss(df: DataFrame, name: str, missing_values: Iterable[object] | None = None, *, nan_is_missing: bool = True) -> Column:
    """True where the column is missing; never null."""
    tests = [column(name).isNull()]
    if nan_is_missing and isinstance(df.schema[name].dataType, FLOATS):
        tests.append(F.isnan(column(name)))
    for value in missing_values or ():
        if not _empty(value) and (test := matches(df, name, value)) is not None:
            tests.append(F.coalesce(test, F.lit(False)))
    return reduce(or_, tests)


def flags(df: DataFrame, missing_values: Iterable[object] | None = None, columns: Sequence[str] | None = None) -> dict[str, Column]:
    return {c: miss(df, c, missing_values) for c in columns or df.columns}


def row_count(tests: Iterable[Column]) -> Column:
    """How many of the tests hold in a row."""
    return reduce(lambda a, b: a + b, [t.cast("bigint") for t in tests], F.lit(0).cast("bigint"))


def value(df: DataFrame, name: str, missing_values: Iterable[object] | None = None) -> Column:
    """The column with NULL wherever it is missing."""
    return F.when(~miss(df, name, missing_values), column(name))


def canonical(df: DataFrame, missing_values: Iterable[object] | None = None) -> DataFrame:
    """NaN and sentinels become NULL in all columns."""
    return df.select(*[value(df, c, missing_values).alias(c) for c in df.columns])


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 of an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * 100)
