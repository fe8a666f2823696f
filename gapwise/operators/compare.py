"""Comparison of imputers on masked cells, and of what they do to a downstream model."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError, GapwiseError
from gapwise.functions import nullity
from gapwise.functions.draws import uniform
from gapwise.operators import donors, fill, models
from gapwise.operators.estimator import MissingImputer
from gapwise.operators.simulate import smallest_gone
from gapwise.plans.fused import missing_counts

METHODS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "mean": lambda df, i: _by_row(df, i, fill.impute_mean),
    "median": lambda df, i: _by_row(df, i, fill.impute_median),
    "mode": lambda df, i: _by_row(df, i, fill.impute_mode),
    "knn": donors.impute_knn,
    "mice": lambda df, i: models.impute_mice(df, i, max_iter=3),
    "pmm": lambda df, i: models.impute_pmm(df, i, max_iter=2),
    "rf": models.impute_rf,
    "gb": models.impute_gb,
    "hotdeck": donors.impute_hotdeck_random,
}


def _by_row(df: DataFrame, row_id: str, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Simple fills keep rows as they are; the key column has no missing value and stays as it is."""
    values = function(df)
    return values.withColumn(row_id, nullity.column(row_id).cast(df.schema[row_id].dataType))


def compare_imputations(df: DataFrame, row_id: str, methods: Sequence[str] | Mapping[str, Callable[[DataFrame, str], DataFrame]] = ("mean", "median", "mode"), mask_frac: float = 0.2, random_state: int = 42) -> DataFrame:
    """method, rmse, accuracy, score, error: each method fills max(1, int(n * frac)) masked cells of every column.

    rmse is the mean over numeric columns, accuracy over the others; score is the mean of the min-max scaled
    rmse and 1 - accuracy, as far as there are any; the best first, failures last.
    """
    if missing_counts(df).where("n_miss > 0").limit(1).count():
        raise ConfigurationError("df", "missing values", "must be complete")
    chosen = methods if isinstance(methods, Mapping) else {m: METHODS[m] for m in methods}
    columns = [c for c in df.columns if c != row_id]
    n = df.count()
    whole = models.spread(df.withColumns({f"__t{i}": nullity.column(c) for i, c in enumerate(columns)}), row_id)
    both = models.reliable(smallest_gone(whole, {c: min(n, max(1, int(n * mask_frac))) for c in columns}, row_id, random_state, "compare") if n else whole)
    masked = both.select(*[nullity.column(c) for c in df.columns])
    marks = {f"__m{i}": nullity.miss(both, c) for i, c in enumerate(columns)}
    truth = both.select(nullity.column(row_id).alias("__id"), *[f"__t{i}" for i in range(len(columns))], *[m.alias(k) for k, m in marks.items()])
    truth = truth.where(reduce(or_, [F.col(k) for k in marks], F.lit(False)))
    rows = []
    for name, method in chosen.items():
        try:
            done = method(masked, row_id)
            joined = done.join(truth, done[row_id] == truth["__id"])
            aggs = []
            for i, c in enumerate(columns):
                if nullity.is_numeric(df, c):
                    aggs.append(F.sqrt(F.avg(F.when(F.col(f"__m{i}"), F.pow(nullity.column(c).cast("double") - F.col(f"__t{i}").cast("double"), 2)))).alias(f"e{i}"))
                else:
                    aggs.append(F.avg(F.when(F.col(f"__m{i}"), F.coalesce(nullity.column(c) == F.col(f"__t{i}"), F.lit(False)).cast("double"))).alias(f"e{i}"))
            r = joined.agg(*aggs).first()
            numeric = [r[f"e{i}"] for i, c in enumerate(columns) if nullity.is_numeric(df, c)]
            other = [r[f"e{i}"] for i, c in enumerate(columns) if not nullity.is_numeric(df, c)]
            rows.append([name, sum(numeric) / len(numeric) if numeric else None, sum(other) / len(other) if other else None, None, None])
        except (GapwiseError, ValueError, RuntimeError) as exc:
            rows.append([name, None, None, None, str(exc)])
    known = [r[1] for r in rows if r[1] is not None]
    for r in rows:
        if r[4] is None:
            scaled = 0.0 if r[1] is None or max(known) == min(known) else (r[1] - min(known)) / (max(known) - min(known))
            parts = ([scaled] if r[1] is not None else []) + ([1 - r[2]] if r[2] is not None else [])
            r[3] = sum(parts) / len(parts) if parts else None
    out = df.sparkSession.createDataFrame([tuple(r) for r in rows], "method string, rmse double, accuracy double, score double, error string")
    return out.orderBy(F.asc_nulls_last("score"), "method")


def cv_compare_imputations(df: DataFrame, row_id: str, label: str, pipeline: Callable[[DataFrame], object], evaluator: Evaluator, strategies: Sequence[str] = ("mean", "median", "mode"), n_splits: int = 5, random_state: int = 42, imputer_options: Mapping[str, object] | None = None) -> DataFrame:
    """strategy, mean_score, std_score (population): impute on each fold's training rows, fit, and score the held-out fold.

    ``pipeline`` makes an estimator for an imputed training frame. Folds come from a hash of the key.
    """
    if n_splits < 2:
        raise ConfigurationError("n_splits", n_splits, "must be two at least")
    fold = F.floor(uniform(random_state, "fold", nullity.column(row_id)) * n_splits).cast("int")
    folded = df.withColumn("__fold", fold)
    rows = []
    for strategy in strategies:
        scores = []
        for k in range(n_splits):
            train, test = folded.where(F.col("__fold") != k).drop("__fold"), folded.where(F.col("__fold") == k).drop("__fold")
            if test.isEmpty():
                continue
            imputer = MissingImputer(strategy=strategy, rowId=row_id, **dict(imputer_options or {})).fit(train.drop(label))
            ready = lambda part, fitted=imputer: fitted.transform(part.drop(label)).join(part.select(row_id, label), row_id)
            done = ready(train)
            scores.append(evaluator.evaluate(pipeline(done).fit(done).transform(ready(test))))
        mean = sum(scores) / len(scores)
        rows.append((strategy, mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5))
    out = df.sparkSession.createDataFrame(rows, "strategy string, mean_score double, std_score double")
    return out.orderBy(F.desc("mean_score"), "strategy")
