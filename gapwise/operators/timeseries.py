"""Ordered operators: gaps, rolling rates, filling along an order.

``order_by`` is explicit; add a unique key after a time that may repeat. Without ``partition_by`` the table is one
series, handled in ranges (see gapwise.plans.ordered).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError
from gapwise.functions import nullity
from gapwise.operators.splines import ORDERS, fill_spline
from gapwise.operators.validate import validate_columns, validate_strategy
from gapwise.plans.fused import scalars
from gapwise.plans.ordered import sort_number, with_neighbours, with_position

Values = Iterable[object] | None
METHODS = ("ffill", "bfill", "linear", "time", "spline")


def _columns(df: DataFrame, columns: Sequence[str] | None, order_by: Sequence[str], partition_by: Sequence[str]) -> list[str]:
    if columns is not None:
        return validate_columns(df, columns)
    return [c for c in df.columns if c not in (*order_by, *partition_by)]


def is_sorted(df: DataFrame, file_order: str, order_by: str) -> bool:
    """Whether ``order_by`` never falls along ``file_order``; equal values are fine."""
    placed = with_neighbours(df, {"x": nullity.column(order_by)}, [file_order])
    before = placed.select(F.col("__pos").alias("p"), nullity.column(order_by).alias("v"))
    after = before.select((F.col("p") - 1).alias("p"), F.col("v").alias("w"))
    return before.join(after, "p").where("v > w").isEmpty()


def gap_table(df: DataFrame, order_by: Sequence[str], *, partition_by: Sequence[str] = (), columns: Sequence[str] | None = None, missing_values: Values = None) -> DataFrame:
    """column, gap_id, start, end, length per run of missing values.

    ``end`` is the key of the first observed row after the run, or the last key of the series if the run is at
    its end; length counts rows. A run is known by the observed row before it, so no row numbers are compared.
    """
    columns = _columns(df, columns, order_by, partition_by)
    placed = with_neighbours(df, {c: nullity.value(df, c, missing_values) for c in columns}, order_by, partition_by)
    first = nullity.column(order_by[0])
    keys = [nullity.column(c) for c in partition_by]
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("i"), F.coalesce(F.col(f"`__prev_{c}`.pos"), F.lit(0)).alias("after"), F.col(f"`__next_{c}`.at").alias("next"))
        for i, c in enumerate(columns)
    ]
    gone = [F.when(F.col(f"`__prev_{c}`.pos").isNull() | (F.col(f"`__prev_{c}`.pos") != F.col("__pos")), cell) for c, cell in zip(columns, cells, strict=True)]
    rows = placed.select(*keys, first.alias("__at"), F.explode(F.filter(F.array(*gone), lambda x: x.isNotNull())).alias("c"))
    gaps = rows.groupBy(*partition_by, "c.column", "c.i", "c.after").agg(
        F.min("__at").alias("start"), F.coalesce(F.max("c.next"), F.max("__at")).alias("end"), F.count(F.lit(1)).alias("length")
    )
    # Numbering needs an order within each column, range by range.
    numbered = with_position(gaps, ["after"], [*partition_by, "column"]).withColumnRenamed("__pos", "gap_id")
    return numbered.select(*partition_by, "column", "gap_id", "start", "end", "length")


def miss_ts_summary(df: DataFrame, order_by: Sequence[str], *, columns: Sequence[str] | None = None, missing_values: Values = None) -> DataFrame:
    """variable, n_miss, pct_miss, n_gaps, mean_gap, max_gap, max_gap_len, median_gap; zeros without gaps.

    Lengths are counted by value first: of n rows no column has more than sqrt(2 n) different ones, which is all that a median holds.
    """
    columns = _columns(df, columns, order_by, ())
    gaps = gap_table(df, order_by, columns=columns, missing_values=missing_values)
    total = df.count()
    found = gaps.groupBy("column").agg(
        F.sum("length").alias("n"), F.count(F.lit(1)).alias("g"), F.avg("length").alias("m"), F.max("length").alias("x"), F.median("length").alias("d")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return names.join(found, names["variable"] == found["column"], "left").select(
        "variable",
        zero("n").alias("n_miss"),
        F.round(zero("n") / F.lit(max(total, 1)) * 100, 2).alias("pct_miss"),
        zero("g").alias("n_gaps"),
        F.round(F.coalesce("m", F.lit(0.0)), 2).alias("mean_gap"),
        zero("x").alias("max_gap"),
        zero("x").alias("max_gap_len"),
        F.coalesce("d", F.lit(0.0)).alias("median_gap"),
    )


def gap_lengths(df: DataFrame, order_by: Sequence[str], *, columns: Sequence[str] | None = None, missing_values: Values = None) -> DataFrame:
    """column, length, n_gaps: the histogram of gap lengths."""
    gaps = gap_table(df, order_by, columns=columns, missing_values=missing_values)
    return gaps.groupBy("column", "length").agg(F.count(F.lit(1)).alias("n_gaps"))


def gap_length_box(df: DataFrame, order_by: Sequence[str], *, columns: Sequence[str] | None = None, missing_values: Values = None) -> DataFrame:
    """column, low, q1, median, q3, high of the gap lengths."""
    gaps = gap_table(df, order_by, columns=columns, missing_values=missing_values)
    q = lambda p: F.percentile("length", p)
    return gaps.groupBy("column").agg(F.min("length").alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("length").alias("high"))


def miss_over_time(df: DataFrame, order_by: Sequence[str], *, columns: Sequence[str] | None = None, window: int = 10, missing_values: Values = None) -> DataFrame:
    """The order columns, pos, and per column the % missing among the last ``window`` rows (fewer at the start).

    A rolling sum is the difference of two running sums, found ``window`` places earlier by an equi-join on
    the place.
    """
    columns = _columns(df, columns, order_by, ())
    sums = {f"__c_{c}": nullity.miss(df, c, missing_values).cast("bigint") for c in columns}
    placed = with_position(df, order_by, (), sums).select(*order_by, F.col("__pos").alias("pos"), *[f"`{s}`" for s in sums])
    before = placed.select((F.col("pos") + window).alias("b_pos"), *[nullity.column(s).alias(f"b_{i}") for i, s in enumerate(sums)])
    joined = placed.join(before, placed["pos"] == before["b_pos"], "left")
    size = F.least(F.col("pos"), F.lit(window))
    rates = [((nullity.column(s) - F.coalesce(F.col(f"b_{i}"), F.lit(0))) / size * 100).alias(c) for i, (s, c) in enumerate(zip(sums, columns, strict=True))]
    return joined.select(*order_by, "pos", *rates)


def miss_span(df: DataFrame, column: str, order_by: Sequence[str], span: int = 20, *, missing_values: Values = None) -> DataFrame:
    """Rolling % missing of one column: the order columns, pos, pct_miss."""
    out = miss_over_time(df, order_by, columns=[column], window=span, missing_values=missing_values)
    return out.withColumnRenamed(column, "pct_miss") if column not in order_by else out


def ts_presence(df: DataFrame, order_by: str, *, columns: Sequence[str] | None = None, buckets: int = 200, missing_values: Values = None) -> DataFrame:
    """bucket, variable, n_rows, n_miss: the presence matrix over time in equal steps of the order key."""
    columns = _columns(df, columns, [order_by], ())
    at = sort_number(df, order_by)
    ends = scalars(df, low=F.min(at), high=F.max(at))
    low, high = ends["low"], ends["high"]
    place = F.lit(0) if low is None or high == low else F.least(F.floor((at - low) / (high - low) * buckets), F.lit(buckets - 1)).cast("int")
    wide = df.groupBy(place.alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(nullity.miss(df, c, missing_values)).alias(f"__m{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"__m{i}").alias("n_miss")) for i, c in enumerate(columns)])
    return wide.select("bucket", "n_rows", F.explode(rows).alias("r")).select("bucket", "r.variable", "n_rows", "r.n_miss")


def _filled(df: DataFrame, c: str, method: str, limit: int | None, missing_values: Values) -> Column:
    observed, prev, next_ = nullity.value(df, c, missing_values), F.col(f"`__prev_{c}`"), F.col(f"`__next_{c}`")
    back = F.col("__pos") - prev["pos"]
    if method == "ffill":
        made, steps = prev["value"], back
    elif method == "bfill":
        made, steps = next_["value"], next_["pos"] - F.col("__pos")
    else:
        if method == "linear":
            share = back / F.nullif(next_["pos"] - prev["pos"], F.lit(0))
        else:
            micros = lambda x: F.unix_micros(x.cast("timestamp")).cast("double")
            share = (micros(F.col("__at")) - micros(prev["at"])) / F.nullif(micros(next_["at"]) - micros(prev["at"]), F.lit(0.0))
        low, high = prev["value"].cast("double"), next_["value"].cast("double")
        made, steps = F.when(next_["value"].isNull(), low).otherwise(low + (high - low) * share), back
    if limit is not None:
        made = F.when(steps <= limit, made)
    return F.coalesce(observed if method in ("ffill", "bfill") else observed.cast("double"), made)


def impute_ts(df: DataFrame, order_by: Sequence[str], method: str | None = None, *, strategy: str | None = None, partition_by: Sequence[str] = (), columns: Sequence[str] | None = None, limit: int | None = None, spline_order: int = 3, missing_values: Values = None) -> DataFrame:
    """Fill along the order: ffill, bfill, linear, time or spline (default linear).

    Columns that aren't numeric are always filled forward. linear and time fill between observed values and
    carry the last one to the end; values before the first observed one stay missing. ``limit`` counts from the
    start of a gap (from its end for bfill). spline goes through all observed values with polynomials of ``spline_order``,
    1 to 5, over row places (see ``fill_spline``).
    """
    chosen = validate_strategy(method or strategy or "linear", METHODS, param="method", example="linear")
    if limit is not None and limit < 1:
        raise ConfigurationError("limit", limit, "must be positive")
    if spline_order not in ORDERS:
        raise ConfigurationError("spline_order", spline_order, "must be 1 to 5")
    columns = _columns(df, columns, order_by, partition_by)
    if chosen == "spline":
        spline = [c for c in columns if nullity.is_numeric(df, c)]
        rest = [c for c in columns if c not in spline]
        out = impute_ts(df, order_by, "ffill", partition_by=partition_by, columns=rest, limit=limit, missing_values=missing_values) if rest else df
        return fill_spline(out, order_by, partition_by, spline, limit, spline_order, missing_values) if spline else out
    placed = with_neighbours(df, {c: nullity.value(df, c, missing_values) for c in columns}, order_by, partition_by)
    placed = placed.withColumn("__at", nullity.column(order_by[0]))
    out = [
        (_filled(df, c, chosen if nullity.is_numeric(df, c) else "ffill", limit, missing_values).alias(c) if c in columns else nullity.column(c))
        for c in df.columns
    ]
    return placed.select(*out)
