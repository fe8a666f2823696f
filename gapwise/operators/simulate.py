"""Missingness mechanisms over complete data. Draws depend on the seed, the row's key and the column alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError
from gapwise.functions import nullity
from gapwise.functions.draws import uniform
from gapwise.operators.validate import validate_columns, validate_strategy
from gapwise.plans.fused import missing_counts, scalars
from gapwise.plans.ordered import with_position
from gapwise.plans.selection import medians, order_statistics


def _check(df: DataFrame, frac: float, complete: Sequence[str]) -> None:
    if not 0 < frac < 1:
        raise ConfigurationError("frac", frac, "must lie between 0 and 1")
    if complete and (gone := [r.variable for r in missing_counts(df, columns=complete).where("n_miss > 0").collect()]):
        raise ConfigurationError("df", gone, "has missing values already")


def _exactly(df: DataFrame, c: str, k: int, row_id: str, seed: int, label: str) -> DataFrame:
    """NULL in the k observed rows of the smallest draws, by their place in that order."""
    draw = F.when(~nullity.miss(df, c), uniform(seed, f"{label}/{c}", nullity.column(row_id))).otherwise(2.0)
    placed = with_position(df.withColumn("__u", draw), ["__u", row_id])
    return placed.select(*[(F.when(F.col("__pos") > k, nullity.column(x)).alias(x) if x == c else nullity.column(x)) for x in df.columns])


def smallest_gone(df: DataFrame, wanted: Mapping[str, int], row_id: str, seed: int, label: str) -> DataFrame:
    """NULL in so many observed rows of each column as ``wanted`` says, those of the smallest draws.

    The k-th smallest draw of each column is a threshold, found for all columns by shared scans; the cells then go by a projection.
    Only where rows share the draw at the threshold, as rows that repeat a key do, are they put in order.
    """
    draws = {c: uniform(seed, f"{label}/{c}", nullity.column(row_id)) for c in wanted}
    found = order_statistics(df, {c: (F.when(~nullity.miss(df, c), draws[c]), [k - 1]) for c, k in wanted.items()})
    cuts = {c: found[c][k - 1] for c, k in wanted.items()}
    alone = {c: cut for c, (cut, below, equal) in cuts.items() if below + equal == wanted[c]}
    gone = {c: F.when(draws[c] > F.lit(cut), nullity.column(c)).alias(c) for c, cut in alone.items()}
    out = df.select(*[gone.get(c, nullity.column(c)) for c in df.columns])
    for c in wanted:
        if c not in alone:
            out = _exactly(out, c, wanted[c], row_id, seed, label)
    return out


def simulate_mcar(df: DataFrame, row_id: str, frac: float = 0.1, *, columns: Sequence[str] | None = None, random_state: int = 0, require_complete: bool = True) -> DataFrame:
    """Exactly max(1, round(n * frac)) cells of each column, without replacement; by default of the numeric ones."""
    columns = validate_columns(df, columns) if columns is not None else [c for c in nullity.numeric_columns(df) if c != row_id]
    _check(df, frac, columns if require_complete else ())
    counts = {r.variable: r.n_rows - r.n_miss for r in missing_counts(df, columns=columns).collect()}
    wanted = {c: max(1, round(counts[c] * frac)) for c in columns if counts[c]}
    return smallest_gone(df, wanted, row_id, random_state, "mcar")


def _tail(df: DataFrame, by: str, tail: str, threshold: float | None) -> Column:
    validate_strategy(tail, ("upper", "lower"), param="tail")
    v = nullity.value(df, by).cast("double")
    cut = medians(df, {by: (v, scalars(df, n=F.count(v))["n"])}).get(by) if threshold is None else threshold
    return F.coalesce(v > F.lit(cut) if tail == "upper" else v < F.lit(cut), F.lit(False))


def _masked(df: DataFrame, target: str, probability: Column, row_id: str, seed: int, label: str) -> DataFrame:
    hit = uniform(seed, f"{label}/{target}", nullity.column(row_id)) < probability
    return df.select(*[(F.when(~hit, nullity.column(c)).alias(c) if c == target else nullity.column(c)) for c in df.columns])


def simulate_mar(df: DataFrame, row_id: str, frac: float = 0.1, *, target_col: str, predictor_col: str, tail: str = "upper", threshold: float | None = None, random_state: int = 0, require_complete: bool = True) -> DataFrame:
    """A cell goes with probability min(1, 2 frac) where the predictor lies in the tail, frac / 2 elsewhere."""
    validate_columns(df, [target_col, predictor_col])
    _check(df, frac, [target_col, predictor_col] if require_complete else ())
    p = F.when(_tail(df, predictor_col, tail, threshold), min(1.0, 2 * frac)).otherwise(0.5 * frac)
    return _masked(df, target_col, p, row_id, random_state, "mar")


def simulate_mnar(df: DataFrame, row_id: str, frac: float = 0.1, *, target_col: str, tail: str = "upper", threshold: float | None = None, random_state: int = 0) -> DataFrame:
    """The same on the target itself: min(1, 2 frac) in its tail, frac / 4 elsewhere."""
    validate_columns(df, [target_col])
    _check(df, frac, ())
    p = F.when(_tail(df, target_col, tail, threshold), min(1.0, 2 * frac)).otherwise(0.25 * frac)
    return _masked(df, target_col, p, row_id, random_state, "mnar")


def simulate_mixed(df: DataFrame, row_id: str, mechanisms: Sequence[Mapping], *, random_state: int = 0) -> DataFrame:
    """Specifications {"mechanism": "mcar" | "mar" | "mnar", ...} in turn, each with its own seed; cells already gone stay so."""
    out = df
    for i, spec in enumerate(mechanisms):
        options = dict(spec)
        kind = validate_strategy(options.pop("mechanism", options.pop("type", None)), ("mcar", "mar", "mnar"), param="mechanism")
        options["random_state"] = random_state + i
        if kind == "mnar":
            out = simulate_mnar(out, row_id, **options)
        else:
            out = (simulate_mcar if kind == "mcar" else simulate_mar)(out, row_id, require_complete=False, **options)
    return out
