"""Mean, median and mode imputation, as functions and as a fitted imputer: a few aggregates, then a projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError, InsufficientDataError, MissingColumnError
from gapwise.functions import nullity
from gapwise.operators.validate import validate_strategy
from gapwise.plans.fused import scalars
from gapwise.plans.selection import medians, modes

STRATEGIES = ("mean", "median", "mode")


def fill_values(df: DataFrame, strategy: str, columns: list[str]) -> dict[str, object]:
    """The fill value of each column: the mode for what isn't numeric, the smallest of tied modes.

    Counts and means are one aggregate; medians and modes share their scans and hold no column's values in a task.
    """
    if not columns:
        return {}
    counts = scalars(df, **{f"n{i}": F.count(nullity.value(df, c)) for i, c in enumerate(columns)} | {f"v{i}": F.avg(nullity.value(df, c)) for i, c in enumerate(columns) if strategy == "mean" and nullity.is_numeric(df, c)})
    for i, c in enumerate(columns):
        if not counts[f"n{i}"]:
            raise InsufficientDataError(c, 0)
    found = {c: counts[f"v{i}"] for i, c in enumerate(columns) if f"v{i}" in counts}
    middle = [c for c in columns if strategy == "median" and nullity.is_numeric(df, c)]
    found |= medians(df, {c: (nullity.value(df, c).cast("double"), counts[f"n{columns.index(c)}"]) for c in middle})
    found |= modes(df, {c: (nullity.value(df, c), df.schema[c].dataType.simpleString()) for c in columns if c not in found})
    return {c: found[c] for c in columns}


def apply_fill(df: DataFrame, values: dict[str, object], *, widen: bool = True) -> DataFrame:
    """Put the values where the columns are missing. Numbers widen to double for a fractional fill."""
    out = []
    for c in df.columns:
        v = nullity.value(df, c)
        if c not in values:
            out.append(nullity.column(c))
        elif isinstance(values[c], float) and (widen or not values[c].is_integer()):
            out.append(F.coalesce(v.cast("double"), F.lit(values[c])).alias(c))
        else:
            out.append(F.coalesce(v, F.lit(values[c]).cast(df.schema[c].dataType)).alias(c))
    return df.select(*out)


def _impute(df: DataFrame, strategy: str, numeric_only: bool) -> DataFrame:
    columns = nullity.numeric_columns(df) if numeric_only else df.columns
    return apply_fill(df, fill_values(df, strategy, list(columns)))


def impute_mean(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    return _impute(df, "mean", numeric_only)


def impute_median(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    """The exact median, the mean of the two middle values of an even count."""
    return _impute(df, "median", numeric_only)


def impute_mode(df: DataFrame) -> DataFrame:
    return _impute(df, "mode", False)


@dataclass
class FittedImputer:
    """Fill values learned from one frame and applied to others with the same columns, in their own order."""

    strategy: str = "mean"
    values: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        validate_strategy(self.strategy, STRATEGIES, example="mean")

    def fit(self, df: DataFrame) -> FittedImputer:
        self.values = fill_values(df, self.strategy, df.columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.values:
            raise ConfigurationError("imputer", self.strategy, "isn't fitted")
        if absent := [c for c in self.values if c not in df.columns]:
            raise MissingColumnError(absent, df.columns)
        if extra := [c for c in df.columns if c not in self.values]:
            raise ConfigurationError("columns", extra, "weren't in the training frame")
        return apply_fill(df, self.values, widen=False)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


def make_imputer(strategy: str = "mean") -> FittedImputer:
    return FittedImputer(strategy)
