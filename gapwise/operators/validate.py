"""Input checks; all but the row checks read the schema alone."""

from __future__ import annotations

import numbers
from collections.abc import Collection

from pyspark.sql import DataFrame

from gapwise.errors import ConfigurationError, InsufficientDataError, InvalidStrategyError, MissingColumnError
from gapwise.functions.nullity import is_numeric


def validate_dataframe(df: object, *, param: str = "df", allow_empty: bool = True, min_rows: int | None = None) -> DataFrame:
    """TypeError for anything but a DataFrame; row checks read ``min_rows`` rows at most."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"{param} must be a pyspark.sql.DataFrame, not {type(df).__name__}")
    if not allow_empty and (not df.columns or df.isEmpty()):
        raise ConfigurationError(param, "an empty frame", "needs rows and columns")
    if min_rows is not None and (n := df.limit(min_rows).count()) < min_rows:
        raise InsufficientDataError(param, n, min_rows)
    return df


def validate_columns(df: DataFrame, columns: Collection[str], *, param: str = "columns", require_numeric: bool = False) -> list[str]:
    if absent := [c for c in columns if c not in df.columns]:
        raise MissingColumnError(absent, df.columns)
    if require_numeric and (other := [c for c in columns if not is_numeric(df, c)]):
        raise ConfigurationError(param, other, "must be numeric")
    return list(columns)


def validate_strategy(strategy: object, allowed: Collection[str], *, param: str = "strategy", example: str | None = None) -> str:
    if strategy not in allowed:
        raise InvalidStrategyError(param, strategy, allowed, example)
    return strategy


def validate_positive_int(value: object, *, param: str, allow_zero: bool = False) -> int:
    if not isinstance(value, numbers.Integral):
        raise ConfigurationError(param, value, "must be an integer")
    if value < 0 or (value == 0 and not allow_zero):
        raise ConfigurationError(param, value, "must be positive" + " or zero" * allow_zero)
    return int(value)
