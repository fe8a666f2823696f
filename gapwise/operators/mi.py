"""Multiple imputation: Rubin's rules, convergence, models per chain, and contracts."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.errors import ConfigurationError, InsufficientDataError
from gapwise.functions import nullity
from gapwise.operators.models import impute_mice
from gapwise.operators.validate import validate_columns
from gapwise.plans.products import cross_products


def pool_estimates(df: DataFrame, estimate: str = "estimate", variance: str = "variance", by: Sequence[str] = ()) -> DataFrame:
    """Rubin's rules for each group of a long frame, one row per estimate and chain.

    m, q_bar, u_bar, b (sample variance), t, df, r, lambda_, fmi. Without between-variance df is infinite;
    without within-variance r is infinite, df = m - 1 and lambda_ = fmi = 1 (unless both are 0).
    """
    m, u, b, r = F.col("m").cast("double"), F.col("u_bar"), F.col("b"), F.col("r")
    inf = F.lit(float("inf"))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("m"),
        F.avg(estimate).alias("q_bar"),
        F.avg(variance).alias("u_bar"),
        F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("b"),
    )
    extra = (1 + 1 / m) * b
    out = base.withColumn("t", u + extra)
    out = out.withColumn("r", F.when(b == 0, 0.0).when(u == 0, inf).otherwise(extra / F.nullif(u, F.lit(0.0))))
    out = out.withColumn("df", F.when(b == 0, inf).when(u == 0, m - 1).otherwise((m - 1) * (1 + 1 / F.nullif(r, F.lit(0.0))) * (1 + 1 / F.nullif(r, F.lit(0.0)))))
    out = out.withColumn("lambda_", F.when(b == 0, 0.0).when(u == 0, 1.0).otherwise(extra / F.nullif(F.col("t"), F.lit(0.0))))
    fmi = (r + 2 / (F.col("df") + 3)) / (r + 1)
    out = out.withColumn("fmi", F.when(b == 0, 0.0).when(u == 0, 1.0).otherwise(fmi))
    return out.select(*by, "m", "q_bar", "u_bar", "b", "t", "df", "r", "lambda_", "fmi")


def pool_scalar_estimates(estimates: Sequence[float], variances: Sequence[float]) -> dict[str, float]:
    """Rubin's rules for one scalar from numbers already at hand."""
    q, u = np.asarray(estimates, dtype=float), np.asarray(variances, dtype=float)
    if len(q) != len(u) or len(q) < 2:
        raise ConfigurationError("estimates", len(q), "needs two or more, with as many variances")
    if not (np.isfinite(q).all() and np.isfinite(u).all()) or (u < 0).any():
        raise ConfigurationError("variances", variances, "must be finite and not negative")
    m, q_bar, u_bar, b = len(q), float(q.mean()), float(u.mean()), float(q.var(ddof=1))
    extra = (1 + 1 / m) * b
    out = {"m": m, "q_bar": q_bar, "u_bar": u_bar, "b": b, "t": u_bar + extra}
    if b == 0:
        return out | {"df": math.inf, "r": 0.0, "lambda_": 0.0, "fmi": 0.0}
    if u_bar == 0:
        return out | {"df": m - 1.0, "r": math.inf, "lambda_": 1.0, "fmi": 1.0}
    r = extra / u_bar
    df = (m - 1) * (1 + 1 / r) ** 2
    return out | {"df": df, "r": r, "lambda_": extra / out["t"], "fmi": (r + 2 / (df + 3)) / (r + 1)}


def pool_linear_regression_results(coefs: np.ndarray, covs: np.ndarray) -> dict[str, np.ndarray]:
    """Rubin's rules for coefficient vectors (m x p) with covariances (m x p x p)."""
    q, u = np.atleast_2d(np.asarray(coefs, dtype=float)), np.asarray(covs, dtype=float)
    m, p = q.shape
    if m < 2 or u.shape != (m, p, p):
        raise ConfigurationError("covs", u.shape, f"needs shape {(m, p, p)} and m of 2 at least")
    if not np.isfinite(q).all() or not np.isfinite(u).all():
        raise ConfigurationError("coefs", "values", "must be finite")
    if not np.allclose(u, np.transpose(u, (0, 2, 1))) or min(np.linalg.eigvalsh(x).min() for x in u) < -1e-8:
        raise ConfigurationError("covs", "matrices", "must be symmetric and positive semi-definite")
    within, between = u.mean(axis=0), np.atleast_2d(np.cov(q, rowvar=False, ddof=1))
    total = within + (1 + 1 / m) * between
    se = np.sqrt(np.diag(total))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (1 + 1 / m) * np.diag(between) / np.diag(within)
        df = np.where(np.diag(between) == 0, np.inf, (m - 1) * (1 + 1 / r) ** 2)
        t = q.mean(axis=0) / se
    return {"coef_": q.mean(axis=0), "cov_": total, "se_": se, "t_": t, "df_": df}


def pool_regressions(df: DataFrame, features: Sequence[str], target: str, chain: str = "chain") -> DataFrame:
    """term, coef, se, t, df: least squares of ``target`` on ``features`` per chain of one long frame, pooled by Rubin's rules.

    One pass gives the means and one the cross products around them of all chains, as matrices; what the driver solves is of
    the size of the columns. Rows that miss a value aren't used. A chain needs more rows than coefficients; of features that
    depend on each other the shortest solution counts.
    """
    names = validate_columns(df, [*features, target])
    x = [nullity.value(df, c).cast("double") for c in names]
    full = df.where(reduce(and_, [c.isNotNull() for c in x]))
    means = full.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    sums = cross_products(full, [F.lit(1.0), *[c - F.lit(float(m)) for c, m in zip(x, centre, strict=True)]], by=nullity.column(chain))
    p = len(names)
    coefs, covs = [], []
    for g in sorted(sums, key=str):
        n, m = sums[g]
        if n <= p:
            raise InsufficientDataError(target, n, p + 1)
        inverse = np.linalg.pinv(m[:p, :p], hermitian=True)
        b = inverse @ m[:p, p]
        cov = max(0.0, m[p, p] - b @ m[:p, p]) / (n - p) * inverse
        # Back from centred columns: the intercept takes the means along.
        back = np.eye(p)
        back[0, 1:] = -centre[:-1]
        b = back @ b
        b[0] += centre[-1]
        coefs.append(b)
        covs.append(back @ cov @ back.T)
    pooled = pool_linear_regression_results(np.array(coefs).reshape(-1, p), np.array(covs).reshape(-1, p, p))
    rows = [(term, *[float(pooled[k][i]) for k in ("coef_", "se_", "t_", "df_")]) for i, term in enumerate(["intercept", *features])]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, df double")


def pool_linear_models(df: DataFrame, feature: str, target: str, chain: str = "chain") -> DataFrame:
    """The pooled slope of target on feature over the chains of one long frame: two aggregates."""
    x, y = nullity.column(feature).cast("double"), nullity.column(target).cast("double")
    per = df.where(x.isNotNull() & y.isNotNull()).groupBy(nullity.column(chain).alias("chain")).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")
    )
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    sigma2 = sse / F.greatest(F.col("n") - 2, F.lit(1))
    variance = F.when(F.col("sxx") <= 1e-12, 1e-6).otherwise(F.greatest(sigma2 / F.nullif("sxx", F.lit(0.0)), F.lit(1e-10)))
    return pool_estimates(per.select(F.coalesce("slope", F.lit(0.0)).alias("estimate"), variance.alias("variance")))


def gelman_rubin_rhat(traces: DataFrame) -> DataFrame:
    """variable, n_chains, n_iter, rhat of a long trace (chain, iter, variable, value).

    Chains are cut to the shortest one's length; rhat is null if the chains don't vary.
    """
    lengths = traces.groupBy("variable", "chain").agg(F.count(F.lit(1)).alias("k"))
    shortest = lengths.groupBy("variable").agg(F.min("k").alias("n"))
    cut = traces.join(shortest, "variable").where(F.col("iter") < F.col("n"))
    chains = cut.groupBy("variable", "n", "chain").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    both = chains.groupBy("variable", "n").agg(F.count(F.lit(1)).alias("n_chains"), F.avg("var").alias("w"), F.var_samp("mean").alias("bn"))
    n = F.col("n").cast("double")
    rhat = F.sqrt(((n - 1) / n * F.col("w") + F.col("bn")) / F.nullif("w", F.lit(0.0)))
    return both.select("variable", "n_chains", F.col("n").alias("n_iter"), F.when(F.col("bn") > 0, rhat).alias("rhat"))


def mice_convergence(histories: DataFrame, variables: Sequence[str] | None = None, rhat_threshold: float = 1.1) -> DataFrame:
    """gelman_rubin_rhat plus converged; needs two chains and two iterations."""
    rows = histories if variables is None else histories.where(F.col("variable").isin(list(variables)))
    shape = rows.agg(F.count_distinct("chain"), F.count_distinct("iter")).first()
    if shape[0] < 2 or shape[1] < 2:
        raise ConfigurationError("histories", tuple(shape), "needs two chains of two iterations at least")
    return gelman_rubin_rhat(rows).withColumn("converged", F.coalesce(F.col("rhat") < rhat_threshold, F.lit(False)))


def mi_with(df: DataFrame, model_fn: Callable[[GroupedData], DataFrame] | Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None, chain: str = "chain") -> DataFrame:
    """A model per chain: aggregates of the frame grouped by chain, summed partly where the rows lie.

    With a ``schema`` it is a pandas model, run in parallel; then each chain must fit a task.
    """
    if schema is None:
        return model_fn(df.groupBy(chain))
    return df.groupBy(chain).applyInPandas(lambda pdf: model_fn(pdf), schema)


def mi_fit(df: DataFrame, row_id: str, n_imputations: int, model_fn: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """Impute ``n_imputations`` chains and apply ``model_fn`` to the long frame with its chain column."""
    if n_imputations < 2:
        raise ConfigurationError("n_imputations", n_imputations, "must be two at least")
    return model_fn(impute_mice(df, row_id, n_imputations=n_imputations, **options))


@dataclass(frozen=True)
class MissingnessSchema:
    """Columns, types and the mask of the original frame, by row id."""

    columns: tuple[str, ...]
    types: tuple[str, ...]
    row_id: str
    mask: DataFrame

    @classmethod
    def from_dataframe(cls, frame: DataFrame, row_id: str) -> MissingnessSchema:
        validate_columns(frame, [row_id])
        if frame.groupBy(nullity.column(row_id)).count().where("count > 1").limit(1).count():
            raise ConfigurationError("row_id", row_id, "must be unique")
        marks = [nullity.miss(frame, c).alias(c) for c in frame.columns if c != row_id]
        return cls(tuple(frame.columns), tuple(f.dataType.simpleString() for f in frame.schema), row_id, frame.select(nullity.column(row_id), *marks))

    def validate_frame(self, frame: DataFrame, *, name: str = "frame") -> None:
        """The same columns and kinds of types, and the same row ids."""
        if tuple(frame.columns) != self.columns:
            raise ConfigurationError(name, frame.columns, f"must have the columns {list(self.columns)}")
        for f, kind in zip(frame.schema, self.types, strict=True):
            widened = isinstance(f.dataType, T.DoubleType) and kind in ("tinyint", "smallint", "int", "bigint", "float")
            if f.dataType.simpleString() != kind and not widened:
                raise ConfigurationError(name, f"{f.name} {f.dataType.simpleString()}", f"must be {kind}")
        mine, theirs = self.mask.select(self.row_id), frame.select(self.row_id)
        if mine.exceptAll(theirs).limit(1).count() or theirs.exceptAll(mine).limit(1).count():
            raise ConfigurationError(name, self.row_id, "must hold the same rows")


@dataclass(frozen=True)
class ImputationPlan:
    """Methods by column, chains, iterations, seeds and constraints."""

    methods: Mapping[str, str]
    n_imputations: int = 5
    max_iter: int = 10
    seeds: tuple[int, ...] = ()
    constraints: Mapping[str, object] = field(default_factory=dict)
    provenance: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if self.n_imputations < 1 or self.max_iter < 1:
            raise ConfigurationError("n_imputations", (self.n_imputations, self.max_iter), "must be positive")
        if self.seeds and (len(self.seeds) != self.n_imputations or len(set(self.seeds)) != len(self.seeds)):
            raise ConfigurationError("seeds", self.seeds, "needs one distinct seed per imputation")

    def validate_schema(self, schema: MissingnessSchema) -> None:
        if absent := [c for c in (*self.methods, *self.constraints) if c not in schema.columns]:
            raise ConfigurationError("plan", absent, "aren't columns of the schema")


class FCSKernel(Protocol):
    """An extension: the column that fills ``target`` where ``mask`` holds."""

    def impute(self, state: DataFrame, target: str, mask: Column, seed: int) -> Column: ...


def completed_violations(original: DataFrame, completed: DataFrame, row_id: str, chain: str = "chain") -> DataFrame:
    """variable, n_observed_changed, n_still_missing, n_rows_lost of completed frames (one, or long with a chain column).

    A row is lost if it is not in the completed frame once for each chain; so is one that the original doesn't hold.
    """
    columns = [c for c in original.columns if c != row_id]
    chains = completed.select(chain).distinct().count() if chain in completed.columns and chain not in columns else 1
    right = completed.select(nullity.column(row_id).alias("__id"), *[nullity.column(c).alias(f"__c_{c}") for c in columns])
    joined = original.withColumn("__given", F.lit(True)).join(right.withColumn("__made", F.lit(True)), original[row_id] == right["__id"], "full")
    both = F.col("__given").isNotNull() & F.col("__made").isNotNull()
    aggs = []
    for i, c in enumerate(columns):
        gone, new = nullity.miss(original, c), nullity.column(f"__c_{c}")
        old = nullity.column(c)
        same = old.cast("double").eqNullSafe(new.cast("double")) if nullity.is_numeric(original, c) else old.eqNullSafe(new)
        aggs += [F.count_if(both & ~gone & ~same).alias(f"o{i}"), F.count_if(both & gone & new.isNull()).alias(f"m{i}")]
    met = F.count_if(both)
    per_row = joined.groupBy(F.coalesce(nullity.column(row_id), F.col("__id"))).agg(*aggs, (met != chains).alias("lost"))
    wide = per_row.agg(*[F.coalesce(F.sum(f"{k}{i}"), F.lit(0)).alias(f"{k}{i}") for i in range(len(columns)) for k in "om"], F.count_if("lost").alias("lost"))
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"o{i}").alias("n_observed_changed"), F.col(f"m{i}").alias("n_still_missing")) for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r"), "lost").select("r.*", F.col("lost").alias("n_rows_lost"))


@dataclass(frozen=True)
class MIData:
    """The original frame, its schema, the plan, and the completed chains in one long frame."""

    original: DataFrame
    schema: MissingnessSchema
    plan: ImputationPlan
    completed: DataFrame

    @property
    def n_imputations(self) -> int:
        return self.plan.n_imputations

    def validate(self) -> None:
        """Observed cells are unchanged and missing ones are filled, in every chain."""
        bad = completed_violations(self.original, self.completed, self.schema.row_id).where("n_observed_changed > 0 or n_still_missing > 0").collect()
        if bad:
            raise ConfigurationError("completed", [r.variable for r in bad], "changes observed cells or leaves cells missing")


@dataclass(frozen=True)
class ImputationResult:
    data: MIData
    histories: DataFrame | None = None
    warnings: tuple[str, ...] = ()
    validated: bool = False
