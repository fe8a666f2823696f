"""Names, empty rows and columns, coalescing, narrow types. The semantics are this library's own."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.errors import InvalidStrategyError
from gapwise.functions import nullity
from gapwise.operators.validate import validate_columns
from gapwise.plans.fused import missing_counts, scalars


def clean_name(name: str, *, case: str = "lower", sep: str = "_", strip_accents: bool = False) -> str:
    if strip_accents:
        name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    words = re.findall(r"\w+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).replace("_", " "))
    joined = sep.join(words) or "x"
    cases = {"lower": str.lower, "upper": str.upper, "title": str.title, "preserve": str}
    if case not in cases:
        raise InvalidStrategyError("case", case, cases)
    return cases[case](joined)


def clean_names(df: DataFrame, *, case: str = "lower", sep: str = "_", strip_accents: bool = False) -> DataFrame:
    """Snake-cased names; a repeated name gets a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = clean_name(c, case=case, sep=sep, strip_accents=strip_accents)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}{sep}{seen[name]}")
    return df.toDF(*names)


def remove_empty(df: DataFrame, *, axis: str = "both", missing_values: Iterable[object] | None = None, thresh_row: float | None = None, thresh_col: float | None = None) -> DataFrame:
    """Drop rows and columns whose share of missing values reaches the threshold (default: all missing).

    Rows are a filter; columns need one aggregate first, taken over the rows that stay.
    """
    if axis not in ("rows", "columns", "both", 0, 1):
        raise InvalidStrategyError("axis", axis, ("rows", "columns", "both"))
    out = df
    if axis in ("rows", "both", 0):
        n = nullity.row_count(nullity.flags(df, missing_values).values())
        out = out.where(n < (1.0 if thresh_row is None else thresh_row) * len(df.columns))
    if axis in ("columns", "both", 1):
        limit = 1.0 if thresh_col is None else thresh_col
        counts = missing_counts(out, missing_values).where((F.col("n_rows") > 0) & (F.col("n_miss") >= limit * F.col("n_rows"))).collect()
        out = out.drop(*[r.variable for r in counts])
    return out


def coalesce_columns(df: DataFrame, target: str, *donors: str, remove_donors: bool = False) -> DataFrame:
    """Fill ``target`` from the donors, left to right."""
    validate_columns(df, [target, *donors])
    filled = F.coalesce(*[nullity.value(df, c) for c in (target, *donors)]).alias(target)
    return df.select(*[filled if c == target else nullity.column(c) for c in df.columns if not (remove_donors and c in donors)])


def memory_usage_mb(df: DataFrame) -> float:
    """Catalyst's size estimate of the optimised plan; no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6


def optimize_dtypes(df: DataFrame) -> DataFrame:
    """Integer columns in the narrowest type that holds their range: one aggregate, then casts."""
    whole = [c for c in df.columns if isinstance(df.schema[c].dataType, T.IntegralType)]
    if not whole:
        return df
    found = scalars(df, **{f"{s}{i}": f(nullity.column(c)) for i, c in enumerate(whole) for s, f in (("a", F.min), ("b", F.max))})
    types = ((1 << 7, "tinyint"), (1 << 15, "smallint"), (1 << 31, "int"), (1 << 63, "bigint"))
    casts = {}
    for i, c in enumerate(whole):
        low, high = found[f"a{i}"], found[f"b{i}"]
        if low is not None:
            casts[c] = nullity.column(c).cast(next(t for limit, t in types if -limit <= low and high < limit))
    return df.withColumns(casts)


def chunk_apply(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType | None = None, chunk_size: int = 10_000) -> DataFrame:
    """Apply a pandas function to pieces of at most ``chunk_size`` rows, in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), chunk_size):
                yield func(batch.iloc[start : start + chunk_size])

    return df.mapInPandas(run, schema or df.schema)
