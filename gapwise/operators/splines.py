"""Interpolating splines of orders 1 to 5 along an order.

Only observed values take part in the fit: they are dealt to blocks of bounded size, where banded collocation gives the
spline as polynomials. One row per gap takes its polynomials back to the table, and built-in expressions evaluate them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions import nullity
from gapwise.plans.ordered import neighbours_of, with_position

#: A spline is fitted in blocks of so many observed values, with so many more on either side.
BLOCK, HALO = 8_192, 128
ORDERS = (1, 2, 3, 4, 5)


def breaks(x: np.ndarray, order: int) -> np.ndarray:
    """The knots of the interpolating spline: values (odd orders) or the middles between them (even), without those near the ends."""
    if order % 2:
        half = (order + 1) // 2
        inner = x[half : len(x) - half]
    else:
        inner = ((x[1:] + x[:-1]) / 2)[order // 2 : len(x) - 1 - order // 2]
    return np.concatenate([np.repeat(x[0], order + 1), inner, np.repeat(x[-1], order + 1)])


def _spans(knots: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """For each place the knot that begins its polynomial; places beyond the ends belong to the outermost ones."""
    return np.clip(np.searchsorted(knots, at, side="right") - 1, order, len(knots) - order - 2)


def _basis(knots: np.ndarray, order: int, span: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order + 1 B-splines that aren't 0 on each span, by their recurrence: row r belongs to coefficient span - order + r."""
    b = np.ones((1, len(at)))
    for d in range(1, order + 1):
        new = np.zeros((d + 1, len(at)))
        for r in range(d):
            left, right = knots[span - d + 1 + r], knots[span + 1 + r]
            share = b[r] / (right - left)
            new[r] += share * (right - at)
            new[r + 1] += share * (at - left)
        b = new
    return b


def _collocate(knots: np.ndarray, x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """Coefficients that meet all values. The matrix is banded and totally positive, so elimination needs no pivots."""
    n, span = len(x), _spans(knots, order, x)
    band = np.zeros((n, 2 * order + 1))
    place = np.arange(n)
    for r, weight in enumerate(_basis(knots, order, span, x)):
        offset = span - order + r - place + order
        inside = (offset >= 0) & (offset <= 2 * order)
        band[place[inside], offset[inside]] += weight[inside]
    c = y.astype(float).copy()
    for i in range(n):
        for below in range(i + 1, min(i + order + 1, n)):
            first = i - below + order
            if band[below, first]:
                share = band[below, first] / band[i, order]
                band[below, first : first + order + 1] -= share * band[i, order:]
                c[below] -= share * c[i]
    for i in range(n - 1, -1, -1):
        ahead = min(order, n - 1 - i)
        c[i] = (c[i] - band[i, order + 1 : order + 1 + ahead] @ c[i + 1 : i + 1 + ahead]) / band[i, order]
    return c


def _taylor(knots: np.ndarray, c: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """For each place the coefficients of its polynomial in the distance from there, constant first."""
    span, out, factorial = _spans(knots, order, at), [], 1.0
    for d in range(order + 1):
        if d:
            low = order - d + 1
            width = knots[d + low : len(c) + low] - knots[d : len(c)]
            c = np.concatenate([np.zeros(d), low * (c[d:] - c[d - 1 : -1]) / np.where(width > 0, width, 1.0)])
            factorial *= d
        b = _basis(knots, order - d, span, at)
        out.append(sum(b[r] * c[span - (order - d) + r] for r in range(order - d + 1)) / factorial)
    return np.stack(out, axis=1)


def pieces(x: np.ndarray, y: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(low, cut, high): from each value on low holds in the distance from it, beyond ``cut`` high in the distance from there.

    Orders without a knot in the middle have no high. With fewer than order + 1 values the polynomial through all of them is taken.
    """
    order = min(order, len(x) - 1)
    knots = breaks(x, order)
    c = _collocate(knots, x, y, order)
    low = _taylor(knots, c, order, x)
    if order % 2:
        return low, np.zeros(len(x)), None
    middle = np.append((x[1:] + x[:-1]) / 2, x[-1])
    return low, middle - x, _taylor(knots, c, order, middle)


def _pieces_table(rows: pa.Table, keys: list[str], cut, low, high) -> pa.Table:
    lists = pa.list_(pa.float64())
    made = {"__cut": pa.array(cut, pa.float64()), "__low": pa.array(list(low), lists), "__high": pa.array(list(high) or [None] * len(rows), lists)}
    out = rows.select([*keys, "__i", "__pos"])
    for name, values in made.items():
        out = out.append_column(name, values)
    return out


def _fit(order: int, keys: list[str]):
    """Polynomials of a block's own values that a gap follows or that end their series."""

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("__pos")
        at = table.column("__pos").to_numpy()
        gone = at[0]
        x, y = (at - gone).astype(float), table.column("__y").to_numpy()
        if len(x) < 2:
            return _pieces_table(table.slice(0, 0), keys, [], [], [])
        own = table.column("__own").to_numpy() == table.column("__block").to_numpy()
        gap = np.append(np.diff(x) > 1, True)
        chosen = np.flatnonzero(own & gap)
        low, cut, high = pieces(x, y, order)
        return _pieces_table(table.take(pa.array(chosen)), keys, cut[chosen], low[chosen], [] if high is None else high[chosen])

    return fit


def blocks(placed: DataFrame, columns: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """The observed values of all columns, one row each, dealt to blocks: of no more than BLOCK + 2 HALO rows, however sparse they are.

    A block solves its own values; those of its neighbours within HALO settle them, as a value's weight falls by a factor of more
    than 2 with each value between.
    """
    entries = [
        F.when(nullity.column(c).isNotNull(), F.struct(F.lit(i).alias("__i"), F.col("__pos"), nullity.column(c).alias("__y"), (F.col(f"__seen_{i}") - 1).alias("__k")))
        for i, c in enumerate(columns)
    ]
    keys = [nullity.column(c) for c in partition_by]
    long = placed.select(*keys, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("__e")).select(*keys, "__e.*")
    own, at = F.floor(F.col("__k") / BLOCK), F.pmod(F.col("__k"), F.lit(BLOCK))
    near = F.array(own, F.when((at < HALO) & (own > 0), own - 1), F.when(at >= BLOCK - HALO, own + 1))
    return long.select(*keys, "__i", "__pos", "__y", own.alias("__own"), F.explode(F.filter(near, lambda b: b.isNotNull())).alias("__block"))


def _value(coefficients: Column, distance: Column, order: int) -> Column:
    """The polynomial by Horner's rule; series with few values have fewer coefficients."""
    terms = [F.coalesce(F.get(coefficients, F.lit(d)), F.lit(0.0)) for d in range(order, -1, -1)]
    return F.when(coefficients.isNotNull(), reduce(lambda made, term: made * distance + term, terms))


def fill_spline(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], columns: Sequence[str], limit: int | None, order: int, missing_values: Iterable[object] | None) -> DataFrame:
    """Fill ``columns`` (they become double) by the interpolating spline through each series' observed values, over row places.

    Knots lie at the values (odd orders) or midway (even orders), without those near the ends, so that polynomials of the
    order are met exactly. Rows after the last value follow the last polynomial; rows before the first stay missing, as does
    a series with one value; a series with no more than ``order`` values follows the polynomial through them. ``limit`` counts
    from the start of a gap. Polynomials go from the value before a gap along the ranges, so that a gap that holds most
    of the table is no hot key.
    """
    out = df.withColumns({c: nullity.value(df, c, missing_values).cast("double") for c in columns})
    placed = with_position(out, order_by, partition_by, {f"__seen_{i}": nullity.column(c).isNotNull().cast("bigint") for i, c in enumerate(columns)}, keep_range=True)
    dealt = blocks(placed, columns, partition_by)
    array = T.ArrayType(T.DoubleType())
    keys = list(partition_by)
    schema = T.StructType([dealt.schema[c] for c in [*keys, "__i", "__pos"]]).add("__cut", T.DoubleType()).add("__low", array).add("__high", array)
    fitted = dealt.groupBy(*[nullity.column(k) for k in keys], "__i", "__block").applyInArrow(_fit(order, keys), schema)
    piece = F.struct("__cut", "__low", "__high")
    wide = fitted.groupBy(*[nullity.column(k) for k in keys], "__pos").agg(*[F.first(F.when(F.col("__i") == i, piece), ignorenulls=True).alias(f"__piece_{i}") for i in range(len(columns))])
    wide = wide.withColumnsRenamed({k: f"__of_{k}" for k in [*keys, "__pos"]})
    same = [nullity.column(k).eqNullSafe(nullity.column(f"__of_{k}")) for k in keys] + [F.col("__pos") == F.col("__of___pos")]
    joined = placed.join(wide, same, "left")
    # Every observed value is a mark, also without a polynomial: what follows it is its own.
    marks = {f"spline_{i}": F.when(nullity.column(c).isNotNull(), F.struct(F.col(f"__piece_{i}").alias("piece"))) for i, c in enumerate(columns)}
    around = neighbours_of(joined, marks, ["__pos"], partition_by)
    made = {}
    for i, c in enumerate(columns):
        before = F.col(f"__prev_spline_{i}")
        back, found = F.col("__pos") - before["pos"], before["value"]["piece"]
        cut, high = found["__cut"], found["__high"]
        value = F.when(high.isNull() | (back < cut), _value(found["__low"], back, order)).otherwise(_value(high, back - cut, order))
        made[c] = F.coalesce(nullity.column(c), value if limit is None else F.when(back <= limit, value))
    return around.select(*[made[c].alias(c) if c in made else nullity.column(c) for c in df.columns])
