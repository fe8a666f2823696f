"""Imputation from donor rows: nearest neighbours, Gower distances, hot-deck.

Neighbours are exact: donors lie in boxes around pivots, and a recipient meets only the boxes that may hold one of its k
nearest (see gapwise.plans.neighbours). Keys may be of any type with an order, columns may have any name that doesn't
begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError, InsufficientDataError, MissingColumnError
from gapwise.functions import nullity
from gapwise.functions.draws import uniform
from gapwise.operators.summary import warn_if_categorical, warn_if_pairs
from gapwise.operators.validate import validate_positive_int, validate_strategy
from gapwise.plans.fused import missing_counts, scalars
from gapwise.plans.neighbours import Euclidean, Gower, nearest, vector

#: Pairs of a task at most, about; rows of a part of the fewer rows; bytes of rows that are broadcast.
PAIRS, ROWS, SHARED_BYTES = 1 << 24, 1 << 7, 1 << 13
#: A column of more distinct values is an identifier rather than a category.
MAX_LEVELS = 10_000


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """The sorted distinct values of each categorical column; they become part of the plan, so more than MAX_LEVELS are refused."""
    out = {}
    for c in columns:
        rows = df.select(nullity.value(df, c).alias(c)).distinct().where(nullity.column(c).isNotNull()).orderBy(c).limit(MAX_LEVELS + 1).collect()
        if len(rows) > MAX_LEVELS:
            raise ConfigurationError("columns", c, f"has more than {MAX_LEVELS} distinct values: leave it out or group them")
        out[c] = [r[0] for r in rows]
    return out


def encoded(df: DataFrame, columns: Sequence[str], levels: dict[str, list]) -> list:
    """Columns as doubles: numbers as they are, categories by their place."""
    out = []
    for c in columns:
        v = nullity.value(df, c)
        if c in levels:
            v = F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels[c]]), v), F.lit(0)) - 1 if levels[c] else F.lit(None)
        out.append(v.cast("double"))
    return out


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return Euclidean().between(a, b)


def gower(a: np.ndarray, b: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    return Gower(tuple(map(float, ranges))).between(a, b)


def _matrix(df: DataFrame, row_id: str, columns: Sequence[str], levels: dict[str, list], carry: Sequence[str] = ()) -> DataFrame:
    """__id, __x, and of each column of ``carry`` its value __v and whether it is missing, __m; no name of ``df`` goes along."""
    more = [x for c in carry for x in (nullity.value(df, c).alias(f"__v_{c}"), nullity.miss(df, c).alias(f"__m_{c}"))]
    return df.select(nullity.column(row_id).alias("__id"), vector(encoded(df, columns, levels)).alias("__x"), *more)


def _found(recipients: DataFrame, donors: DataFrame, k: int, metric, exclude_self: bool) -> DataFrame:
    """The neighbours, from reliable copies of what the search reads twice."""
    from gapwise.operators.models import reliable

    return nearest(recipients.select("__id", "__x"), donors.select("__id", "__x"), k, metric, exclude_self=exclude_self, keep=reliable)


def _put(df: DataFrame, fills: dict[str, DataFrame], row_id: str, kept: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of ``fills`` (__rid, __fill) where ``kept`` has nothing."""
    out = df.withColumns({f"__k_{c}": v for c, v in kept.items()})
    for c, filled in fills.items():
        out = out.join(filled.select(F.col("__rid"), F.col("__fill").alias(f"__f_{c}")), nullity.column(row_id) == F.col("__rid"), "left").drop("__rid")
    made = {c: F.coalesce(nullity.column(f"__k_{c}"), nullity.column(f"__f_{c}")).alias(c) for c in fills}
    return out.select(*[made.get(c, nullity.column(c)) for c in df.columns])


def gower_ranges(df: DataFrame, columns: Sequence[str], levels: dict[str, list]) -> np.ndarray:
    """max - min of the numeric columns, 0 for categorical ones; a constant column has 1."""
    numeric = [c for c in columns if c not in levels]
    if not numeric:
        return np.zeros(len(columns))
    found = scalars(df, **{f"r{i}": F.max(nullity.value(df, c)) - F.min(nullity.value(df, c)) for i, c in enumerate(numeric)})
    spread = {c: float(found[f"r{i}"] or 0.0) or 1.0 for i, c in enumerate(numeric)}
    return np.array([0.0 if c in levels else spread[c] for c in columns])


def gower_distance(df: DataFrame, row_id: str, cat_cols: Sequence[str] | None = None, *, queries: DataFrame | None = None) -> DataFrame:
    """id_a, id_b, distance between the rows of ``queries`` (default: all) and all rows: every pair is a row of the result.

    Pairs are made where they are read: the others meet the fewer rows by a broadcast, or part by part if they are too many;
    no pair and no copy of a row is shuffled. Rows lie in the order of what they miss and their values, and the inner rows of
    a task are few, so that equal distances follow each other and a file of pairs spends little on ids.
    """
    from gapwise.operators.models import reliable

    columns = [c for c in df.columns if c != row_id]
    cats = [c for c in columns if c in (cat_cols or ()) or not nullity.is_numeric(df, c)]
    levels = categories(df, cats)
    ranges = gower_ranges(df, columns, levels)

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select(nullity.column(row_id).alias(f"id_{name}"), *[v.alias(f"__{name}{j}") for j, v in enumerate(encoded(of, columns, levels))])

    def placed(name: str, parts: int) -> DataFrame:
        # A copy is kept as Spark drops an order below a join.
        values = [F.col(f"__{name}{j}") for j in range(len(columns))]
        keys = [*[v.isNull() for v in values], *values, F.col(f"id_{name}")]
        return reliable(sides[name].repartitionByRange(max(1, parts), *keys).sortWithinPartitions(*keys))

    sides = {"a": side(df if queries is None else queries, "a"), "b": side(df, "b")}
    sizes = {name: of.count() for name, of in sides.items()}
    warn_if_pairs(sizes["a"], sizes["b"], "gower_distance")
    total, both = F.lit(0.0), F.lit(0)
    for j, r in enumerate(ranges):
        x, y = F.col(f"__a{j}"), F.col(f"__b{j}")
        part = F.abs(x - y) / F.lit(float(r)) if r > 0 else (x != y).cast("double")
        total, both = total + F.coalesce(part, F.lit(0.0)), both + F.when(x.isNotNull() & y.isNotNull(), 1).otherwise(0)
    few, many = sorted(sizes, key=sizes.get)
    shared = sizes[few] * (len(columns) + 2) * 8 <= SHARED_BYTES
    parts = 1 if shared else -(-sizes[few] // ROWS)
    inner, outer = placed(few, parts), placed(many, -(-sizes[few] * sizes[many] // (PAIRS * parts)))
    pairs = outer.crossJoin(F.broadcast(inner)) if shared else outer.hint("shuffle_replicate_nl").crossJoin(inner)
    return pairs.select("id_a", "id_b", F.when(both > 0, total / both).otherwise(1.0).alias("distance"))


def _with_misses(df: DataFrame, row_id: str) -> list[str]:
    """Columns to fill; one without any observed value is an error."""
    rows = missing_counts(df.drop(row_id)).collect()
    for r in rows:
        if r.n_rows and r.n_miss == r.n_rows:
            raise InsufficientDataError(r.variable, 0)
    return [r.variable for r in rows if r.n_miss]


def impute_knn(df: DataFrame, row_id: str, n_neighbors: int = 5, metric: str = "euclidean", *, donors: DataFrame | None = None) -> DataFrame:
    """Fill each missing value from the k nearest rows that have it.

    ``euclidean``: distances over all columns, categories by their place; the mean of the donors, rounded back
    to a category. ``mixed``: Gower distances; the mean, or the most frequent category (the smallest of tied
    ones). ``donors`` are other rows to learn from, with the same columns.
    """
    validate_positive_int(n_neighbors, param="n_neighbors")
    validate_strategy(metric, ("euclidean", "mixed"), param="metric")
    pool = df if donors is None else donors
    if row_id not in df.columns:
        raise MissingColumnError([row_id], df.columns)
    columns = [c for c in df.columns if c != row_id]
    if metric == "euclidean":
        warn_if_categorical(len([c for c in columns if not nullity.is_numeric(df, c)]), len(columns), n_neighbors)
    levels = categories(pool, [c for c in columns if not nullity.is_numeric(df, c)])
    _with_misses(pool, row_id)
    targets = [r.variable for r in missing_counts(df.drop(row_id)).collect() if r.n_miss]
    measure = Euclidean() if metric == "euclidean" else Gower(tuple(map(float, gower_ranges(pool, columns, levels))))
    left, right = _matrix(df, row_id, columns, levels, targets), _matrix(pool, row_id, columns, levels, targets)
    fills, kept = {}, {}
    for c in targets:
        gone = nullity.column(f"__m_{c}")
        found = _found(left.where(gone), right.where(~gone), n_neighbors, measure, donors is None)
        given = right.select(F.col("__id").alias("__did"), nullity.column(f"__v_{c}").alias("__v"), F.get("__x", F.lit(columns.index(c))).alias("__code"))
        joined = found.join(given, "__did").groupBy("__rid")
        if c in levels and metric == "euclidean":
            place = F.greatest(F.lit(0), F.least(F.bround(F.avg("__code")), F.lit(len(levels[c]) - 1))).cast("int")
            fills[c] = joined.agg(F.get(F.array(*[F.lit(x) for x in levels[c]]), place).alias("__fill"))
        elif c in levels:
            fills[c] = joined.agg(F.mode("__v", True).alias("__fill"))
        else:
            fills[c] = joined.agg(F.avg("__v").alias("__fill"))
        kept[c] = nullity.value(df, c) if c in levels else nullity.value(df, c).cast("double")
    return _put(df, fills, row_id, kept)


def impute_hotdeck_random(df: DataFrame, row_id: str, random_state: int = 0, *, donors: DataFrame | None = None) -> DataFrame:
    """Draw an observed value of the column with replacement.

    Donors get gapless numbers; a recipient's draw names one, and an equi-join on the number fetches it. No
    donor array is built.
    """
    from gapwise.plans.ordered import with_position

    pool = df if donors is None else donors
    _with_misses(pool, row_id)
    targets = [r.variable for r in missing_counts(df.drop(row_id)).collect() if r.n_miss]
    fills = {}
    for c in targets:
        observed = pool.where(~nullity.miss(pool, c)).select(nullity.column(row_id).alias("__id"), nullity.column(c).alias("__fill"))
        n = observed.count()
        numbered = with_position(observed, ["__id"]).select(F.col("__pos").alias("__k"), "__fill")
        asked = df.where(nullity.miss(df, c)).select(nullity.column(row_id).alias("__rid"), (F.floor(uniform(random_state, f"hotdeck/{c}", nullity.column(row_id)) * n) + 1).alias("__k"))
        fills[c] = asked.join(numbered, "__k").select("__rid", "__fill")
    return _put(df, fills, row_id, {c: nullity.value(df, c) for c in targets})


def impute_hotdeck_sequential(df: DataFrame, order_by: Sequence[str], direction: str = "nearest", *, partition_by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The last observed value (forward), the next one (backward), or forward and then backward (nearest)."""
    validate_strategy(direction, ("forward", "backward", "nearest"), param="direction", example="nearest")
    if direction != "nearest":
        method = "ffill" if direction == "forward" else "bfill"
        return _carried(df, order_by, partition_by, columns, (method,))
    return _carried(df, order_by, partition_by, columns, ("ffill", "bfill"))


def _carried(df: DataFrame, order_by, partition_by, columns, methods) -> DataFrame:
    from gapwise.plans.ordered import with_neighbours

    columns = [c for c in (columns or df.columns) if c not in (*order_by, *partition_by)]
    placed = with_neighbours(df, {c: nullity.value(df, c) for c in columns}, order_by, partition_by)
    pick = lambda c: F.coalesce(*[F.col(f"`__{'prev' if m == 'ffill' else 'next'}_{c}`.value") for m in methods])
    return placed.select(*[pick(c).alias(c) if c in columns else nullity.column(c) for c in df.columns])


def impute_hotdeck_weighted(df: DataFrame, row_id: str, n_donors: int = 5, random_state: int = 0) -> DataFrame:
    """Of the k nearest donors by Gower distance over the other columns, one drawn with weights 1 / (distance + 1e-10).

    The draw is an exponential race: the least -log(u) / weight wins.
    """
    validate_positive_int(n_donors, param="n_donors")
    targets = _with_misses(df, row_id)
    columns = [c for c in df.columns if c != row_id]
    levels = categories(df, [c for c in columns if not nullity.is_numeric(df, c)])
    fills = {}
    for c in targets:
        others = [x for x in columns if x != c]
        rows, gone = _matrix(df, row_id, others, levels, [c]), nullity.column(f"__m_{c}")
        found = _found(rows.where(gone), rows.where(~gone), n_donors, Gower(tuple(map(float, gower_ranges(df, others, levels)))), True)
        race = -F.log(1 - uniform(random_state, f"weighted/{c}", F.col("__rid"), F.col("__did"))) * (F.col("__dist") + 1e-10)
        won = found.groupBy("__rid").agg(F.min_by("__did", F.struct(race, F.col("__did"))).alias("__did"))
        fills[c] = won.join(rows.select(F.col("__id").alias("__did"), nullity.column(f"__v_{c}").alias("__fill")), "__did").select("__rid", "__fill")
    return _put(df, fills, row_id, {c: nullity.value(df, c) for c in targets})


__all__ = ["gower_distance", "impute_hotdeck_random", "impute_hotdeck_sequential", "impute_hotdeck_weighted", "impute_knn", "nearest"]
