"""Ordered operators without a single-task window over the whole table.

Every series is cut into ranges of its order keys, at quantiles over all rows, so that one long series among many
is cut up too. Windows run within the ranges of a series; what a range must know of those before and after it is one
row per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions.nullity import column


def sort_number(df: DataFrame, name: str) -> Column:
    """An order key as a double that sorts alike."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(column(name).cast("timestamp")).cast("double")
    return column(name).cast("double")


#: Rows of the sample from which the ranges are cut, per range.
SAMPLED = 32


def _cuts(df: DataFrame, keys: Sequence[str], n: int) -> list:
    """Up to n - 1 distinct tuples of the keys, ascending, that cut the rows into parts of about one size.

    The sample are the rows of the smallest hashes over the keys and the row's place, so a key that many rows share is there as
    often as its share; what it says decides how even the ranges are and nothing else.
    """
    draw = F.xxhash64(*[column(c) for c in keys], F.monotonically_increasing_id())
    sample = df.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keys)], draw.alias("draw")).orderBy("draw").limit(SAMPLED * n)
    rows = [tuple(r)[:-1] for r in sample.orderBy(*[f"k{i}" for i in range(len(keys))]).collect()]
    return list(dict.fromkeys(rows[len(rows) * i // n] for i in range(1, n) if rows))


def with_range(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add __range: of one series, rows in a lower range come first.

    Ranges are cut between tuples of all order keys, of any type that has an order, so that many rows of one first key are cut
    up too. A row finds its range by bisection in one constant array.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(df, order_by, n) if n > 1 else []
    if not cuts:
        return df.withColumn("__range", F.lit(0))
    kinds = [df.schema[c].dataType for c in order_by]
    tuple_of = lambda values: F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)])
    table = F.array(*[tuple_of([F.lit(v).cast(kind) for v, kind in zip(cut, kinds, strict=True)]) for cut in cuts])
    key = tuple_of([column(c) for c in order_by])
    # low: cuts known to be at or below the key; high: the first known to be above it.
    begin = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = ((at["low"] + at["high"]) / 2).cast("int")
        above = F.get(table, middle) > key
        return F.when(at["low"] == at["high"], at).when(above, F.struct(at["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), at["high"].alias("high")))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return df.withColumn("__range", F.aggregate(steps, begin, halve, lambda at: at["low"]))


def _windows(order_by: Sequence[str], partition_by: Sequence[str]):
    parts = [column(c) for c in partition_by] + [F.col("__range")]
    local = Window.partitionBy(*parts).orderBy(*[column(c) for c in order_by])
    ranges = Window.partitionBy(*[column(c) for c in partition_by]).orderBy("__range") if partition_by else Window.orderBy("__range")
    return parts, local, ranges


def _with_carry(ranged: DataFrame, carry: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Join one row per range of a series; of a single one there are no more than the shuffle partitions, so it is broadcast."""
    keys = [*partition_by, "__range"]
    carry = carry.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [column(k).eqNullSafe(column(f"__k_{k}")) for k in keys]
    return ranged.join(carry if partition_by else F.broadcast(carry), same).drop(*[f"__k_{k}" for k in keys])


def with_position(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), sums: Mapping[str, Column] | None = None, *, keep_range: bool = False) -> DataFrame:
    """Add __pos, the row's place from 1, and inclusive running sums of the given columns."""
    sums = dict(sums or {})
    ranged = with_range(df, order_by).withColumns({f"__v_{k}": c for k, c in sums.items()})
    parts, local, ranges = _windows(order_by, partition_by)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums])
    names = ["n", *[f"s_{k}" for k in sums]]
    carry = carry.select(*partition_by, "__range", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in names])
    added = {"__pos": (F.row_number().over(local) + F.col("__b_n")).cast("bigint")}
    added |= {k: F.sum(f"__v_{k}").over(upto) + F.col(f"__b_s_{k}") for k in sums}
    out = _with_carry(ranged, carry, partition_by).withColumns(added)
    return out.drop(*([] if keep_range else ["__range"]), *[f"__v_{k}" for k in sums], *[f"__b_{n}" for n in names])


def with_neighbours(df: DataFrame, observed: Mapping[str, Column], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Add __pos and for each entry k the observed rows around each row, itself included: __prev_k and __next_k.

    ``observed[k]`` is the value, null where missing. A neighbour is a struct (pos, at, value): the place, the
    first order key and the value.
    """
    return neighbours_of(with_position(df, order_by, partition_by, keep_range=True), observed, order_by, partition_by)


def neighbours_of(placed: DataFrame, observed: Mapping[str, Column], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """As ``with_neighbours``, of rows that have their __pos and __range already; ``order_by`` may be __pos itself."""
    mark = {f"__o_{k}": F.when(c.isNotNull(), F.struct(F.col("__pos").alias("pos"), column(order_by[0]).alias("at"), c.alias("value"))) for k, c in observed.items()}
    placed = placed.withColumns(mark)
    parts, local, ranges = _windows(order_by, partition_by)
    # What comes next is the last in the reverse order: a frame up to the end would be gone through again for each row.
    falling = Window.partitionBy(*parts).orderBy(*[column(c).desc() for c in order_by])
    back, ahead = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (local, falling))
    earlier, later = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(1, Window.unboundedFollowing)
    ends = placed.groupBy(*parts).agg(
        *[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("__pos"))).alias(f"__l{m}") for m in mark],
        *[F.min_by(m, F.when(F.col(m).isNotNull(), F.col("__pos"))).alias(f"__f{m}") for m in mark],
    )
    carry = ends.select(
        *partition_by,
        "__range",
        *[F.last(f"__l{m}", ignorenulls=True).over(earlier).alias(f"__e{m}") for m in mark],
        *[F.first(f"__f{m}", ignorenulls=True).over(later).alias(f"__n{m}") for m in mark],
    )
    added = {}
    for k in observed:
        m = f"__o_{k}"
        added[f"__prev_{k}"] = F.coalesce(F.last(m, ignorenulls=True).over(back), F.col(f"__e{m}"))
        added[f"__next_{k}"] = F.coalesce(F.last(m, ignorenulls=True).over(ahead), F.col(f"__n{m}"))
    out = _with_carry(placed, carry, partition_by).withColumns(added)
    return out.drop("__range", *mark, *[f"__e{m}" for m in mark], *[f"__n{m}" for m in mark])
