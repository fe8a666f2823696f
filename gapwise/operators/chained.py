"""Multiple imputation as a plan says: a method for each column, chains of their own seeds, bounds, passive terms, kernels of users."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError, InvalidStrategyError
from gapwise.functions import nullity
from gapwise.functions.draws import normal, uniform
from gapwise.operators import models
from gapwise.operators.fill import STRATEGIES, fill_values
from gapwise.operators.mi import FCSKernel, ImputationPlan, ImputationResult, MIData, MissingnessSchema
from gapwise.operators.validate import validate_columns

NUMERIC, CATEGORICAL = ("norm", "pmm"), ("logreg", "polyreg", "polr")
METHODS = (*STRATEGIES, *NUMERIC, *CATEGORICAL, "passive")


class _Run:
    """The chains as one frame in numbers, and a step per method."""

    def __init__(self, df: DataFrame, row_id: str, plan: ImputationPlan, kernels: Mapping[str, FCSKernel], donors: int):
        self.df, self.plan, self.kernels, self.donors, self.row_id = df, plan, dict(kernels), donors, row_id
        self.seeds = dict(enumerate(plan.seeds or range(plan.n_imputations)))
        self.state, self.warned = models._Coded(df, row_id, list(self.seeds)), []
        self.now = self.state.start
        for c in self.state.targets:
            self.check(c)
        self.order = [c for c in plan.methods if c in self.state.targets]

    def check(self, c: str) -> None:
        method, limit = self.plan.methods.get(c), self.plan.constraints.get(c)
        if method is None:
            raise ConfigurationError("methods", c, "has missing values and needs a method")
        if method not in METHODS and method not in self.kernels:
            raise InvalidStrategyError("methods", method, (*METHODS, *self.kernels))
        if (method in NUMERIC and c in self.state.levels) or (method in CATEGORICAL and c not in self.state.levels):
            raise ConfigurationError("methods", f"{c}: {method}", "doesn't fit the type of the column")
        if method == "passive":
            if not isinstance(limit, str):
                raise ConfigurationError("constraints", c, "a passive column needs its SQL expression")
        elif limit is not None and (isinstance(limit, str) or c in self.state.levels or len(limit) != 2 or limit[0] > limit[1]):
            raise ConfigurationError("constraints", limit, "must be the lower and the upper bound of a numeric column")

    def per_chain(self, make: Callable[[int, int], Column]) -> Column:
        out = F.lit(None).cast("double")
        for chain, seed in self.seeds.items():
            out = F.when(F.col("chain") == chain, make(chain, seed)).otherwise(out)
        return out

    def put(self, c: str, made: Column) -> None:
        """Fill the target where it was missing; what a method leaves open stays as it was."""
        t, limit = self.state.at[c], self.plan.constraints.get(c)
        if limit is not None and not isinstance(limit, str):
            made = F.when(made.isNotNull(), F.greatest(F.lit(float(limit[0])), F.least(F.lit(float(limit[1])), made)))
        self.now = self.now.withColumn(f"v{t}", F.when(F.col(f"m{t}"), F.coalesce(made, F.col(f"v{t}"))).otherwise(F.col(f"v{t}")))

    def constant(self, c: str, method: str) -> None:
        fill = fill_values(self.df, method, [c])[c]
        self.put(c, F.lit(float(self.state.levels[c].index(fill) if c in self.state.levels else fill)))

    def numeric(self, c: str, it: int) -> None:
        """A Bayesian ridge regression per chain, all from one aggregate; values are drawn or those of matched donors."""
        t, method = self.state.at[c], self.plan.methods[c]
        if method == "pmm":
            # Its search reads the frame many times, so what the steps before it made is kept.
            self.now = models.reliable(self.now)
        used = [i for i in range(len(self.state.columns)) if i != t]
        x, gone = [F.col(f"v{i}") for i in used], F.col(f"m{t}")
        fits = {chain: (*models.bayesian_ridge(n, m), m[0, 1:-1] / n) for (chain,), (n, m) in models.gram(self.now.where(~gone), x, F.col(f"v{t}"), by=["chain"]).items()}
        line = lambda w0, w: F.lit(float(w0)) + sum((F.lit(float(b)) * v for b, v in zip(w, x, strict=True)), F.lit(0.0))
        if method == "norm":
            # One matrix product per batch takes the spread of all chains, however many columns there are.
            fits = {chain: (w, cov, mean, float(noise)) for chain, (w, cov, noise, mean) in fits.items()}
            self.now = self.now.withColumn("__p", models._posterior(fits, F.col("chain"), x)) if used else self.now
            center = F.col("__p.line") if used else self.per_chain(lambda k, _: F.lit(float(fits[k][0][0])))
            spread = F.col("__p.spread") if used else self.per_chain(lambda k, _: F.lit(fits[k][3]))
            z = self.per_chain(lambda _, seed: normal(seed, f"plan/{it}/{c}", F.col("__id")))
            self.put(c, center + z * F.sqrt(F.greatest(spread, F.lit(0.0))))
            self.now = self.now.drop("__p")
            return
        drawn = {chain: np.random.default_rng([self.seeds[chain] & 0xFFFFFFFF, it, t]).multivariate_normal(w[1:], cov) if used else w[1:] for chain, (w, cov, *_) in fits.items()}
        known, asked = self.per_chain(lambda k, _: line(fits[k][0][0], fits[k][0][1:])), self.per_chain(lambda k, _: line(fits[k][0][0], drawn[k]))
        donors = self.now.where(~gone).select("chain", F.col("__id").alias("donor"), known.alias("score"), F.col(f"v{t}").alias("value"))
        rows = self.now.where(gone).select("chain", F.col("__id").alias("id"), asked.alias("score"))
        u, v = (self.per_chain(lambda _, seed, tag=tag: uniform(seed, f"plan/{it}/{c}/{tag}", F.col("id"))) for tag in ("rank", "tied"))
        fills = models.donor_values(rows, donors, self.donors, u, v, ["chain"]).select(F.col("chain").alias("__chain"), F.col("id").alias("__to"), "value")
        self.now = self.now.join(fills, (F.col("chain") == F.col("__chain")) & (F.col("__id") == F.col("__to")), "left")
        self.put(c, F.col("value"))
        self.now = models.reliable(self.now.drop("__chain", "__to", "value"))

    def features(self, c: str) -> list[Column]:
        out = []
        for x in self.state.columns:
            v = F.col(f"v{self.state.at[x]}")
            if x != c:
                out += [(v == F.lit(float(k))).cast("double") for k in range(1, len(self.state.levels[x]))] if x in self.state.levels else [v]
        return out

    def category(self, c: str, it: int) -> None:
        """A level drawn from the probabilities of a regression per chain; of an ordinal one without a maximum, of a multinomial one."""
        t, method, n = self.state.at[c], self.plan.methods[c], len(self.state.levels[c])
        x, place = self.features(c), F.col(f"v{t}")
        if n < 2 or (method == "logreg" and n != 2) or (method != "logreg" and n < 3):
            self.warned.append(f"{c}: {method} doesn't fit {n} levels, the commonest one fills")
            self.constant(c, "mode")
            return

        def drawn(chain: int, seed: int) -> Column:
            """The place of a level; the model's terms stand in the plan once, however many levels there are."""
            rows, u = self.now.where(~F.col(f"m{t}") & (F.col("chain") == chain)), uniform(seed, f"plan/{it}/{c}", F.col("__id"))
            dot = lambda w: sum((F.lit(float(b)) * v for b, v in zip(w, x, strict=True) if b), F.lit(0.0))
            bind = models.bound
            if method == "polr":
                try:
                    cuts, slopes = models.fit_ordinal(rows, place, x, n)
                    above = lambda eta, u: F.size(F.filter(F.array(*[F.lit(float(cut)) for cut in cuts]), lambda cut: u >= 1 / (1 + F.exp(eta - cut))))
                    return bind(dot(slopes), lambda eta: bind(u, lambda u: above(eta, u))).cast("double")
                except (ValueError, np.linalg.LinAlgError) as exc:
                    self.warned.append(f"{c}: the ordinal model failed ({exc}), a multinomial one fills")
            model = models._softmax_fit(rows, place, x, n)
            eta = F.array(*[dot(w) + F.lit(float(b)) for w, b in zip(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), strict=True)])
            begin = F.struct(F.lit(0.0).alias("upto"), F.lit(0.0).alias("level"))

            def pick(weight: Column) -> Column:
                step = lambda aim: lambda at, w: F.struct((at["upto"] + w).alias("upto"), (at["level"] + (aim >= at["upto"] + w).cast("double")).alias("level"))
                last = lambda at: F.least(at["level"], F.lit(float(n - 1)))
                return bind(u * F.aggregate(weight, F.lit(0.0), lambda s, w: s + w), lambda aim: F.aggregate(weight, begin, step(aim), last))

            weights = lambda e: bind(F.array_max(e), lambda top: F.transform(e, lambda v: F.exp(v - top)))
            return bind(bind(eta, weights), pick)

        self.put(c, self.per_chain(drawn))

    def named(self, c: str, it: int) -> None:
        """A passive term or a kernel of the user: a column over the frame as it stands, under its own names."""
        t, method, levels = self.state.at[c], self.plan.methods[c], self.state.levels
        values = []
        for x in self.state.columns:
            v = F.col(f"v{self.state.at[x]}")
            if x in levels:
                v = F.get(F.array(*[F.lit(k) for k in levels[x]]), F.greatest(F.lit(0), F.least(F.bround(v), F.lit(len(levels[x]) - 1))).cast("int"))
            values.append(v.alias(x))
        key = F.col("__id").alias(self.row_id)
        frame = self.now.select(F.struct(*self.now.columns).alias("__s"), F.col("chain").alias("__chain"), key, *values)
        if method == "passive":
            made = F.expr(self.plan.constraints[c])
        else:
            made = F.lit(None)
            for chain, seed in self.seeds.items():
                filled = self.kernels[method].impute(frame, c, F.col("__s")[f"m{t}"], seed + it * 1_000_003)
                made = F.when(F.col("__chain") == chain, filled).otherwise(made)
        if c in levels:
            made = F.nullif(F.array_position(F.array(*[F.lit(k) for k in levels[c]]), made.cast(self.df.schema[c].dataType)), F.lit(0)) - 1
        self.now = frame.select("__s.*", made.cast("double").alias("__made"))
        self.put(c, F.col("__made"))
        self.now = self.now.drop("__made")


def impute_plan(df: DataFrame, row_id: str, plan: ImputationPlan, kernels: Mapping[str, FCSKernel] | None = None, *, n_nearest_donors: int = 5) -> ImputationResult:
    """Carry out a plan of chained equations: completed chains, held against the original, and the traces of their means.

    Columns are visited in the order of ``plan.methods``, ``max_iter`` times. Methods: mean, median, mode (once, at the start),
    norm and pmm for numbers, logreg (two levels), polyreg and polr (the sorted levels are their order) for the others, passive
    (``constraints`` holds an SQL expression over the columns) or the name of one of ``kernels``, whose column is read as is;
    where it is null or no level of the column, the cell keeps its last value. For numbers, ``constraints`` may hold
    (low, high). All chains are one frame: numbers take one aggregate per step for all chains, categories a fit per chain.
    Draws hang on the chain's seed, the column and the row's key. Every column with missing values needs a method. The result's
    ``data.completed`` has a column chain before those of the frame, so none of these may be called so; an empty frame gives
    an empty one. Iterations are checkpointed.
    """
    validate_columns(df, [row_id])
    if "chain" in df.columns:
        raise ConfigurationError("df", "chain", "is the column that tells the chains apart: rename it")
    schema = MissingnessSchema.from_dataframe(df, row_id)
    plan.validate_schema(schema)
    run = _Run(df, row_id, plan, kernels or {}, n_nearest_donors)
    for c in run.order:
        if plan.methods[c] in STRATEGIES:
            run.constant(c, plan.methods[c])
    visited, history = [c for c in run.order if plan.methods[c] not in STRATEGIES], []
    for it in range(plan.max_iter if visited else 0):
        for c in visited:
            method = plan.methods[c]
            step = run.numeric if method in NUMERIC else run.category if method in CATEGORICAL else run.named
            step(c, it)
        run.now = models.reliable(run.now)
        at = run.state.at
        means = run.now.groupBy("chain").agg(*[F.avg(F.when(F.col(f"m{at[c]}"), F.col(f"v{at[c]}"))).alias(f"h{at[c]}") for c in visited]).orderBy("chain").collect()
        history += [(r["chain"], it, c, r[f"h{at[c]}"]) for r in means for c in visited]
    data = MIData(df, schema, plan, run.state.decoded(run.now, chain=True))
    data.validate()
    for text in dict.fromkeys(run.warned):
        warnings.warn(f"impute_plan: {text}", UserWarning, stacklevel=2)
    traces = df.sparkSession.createDataFrame(history, "chain int, iter int, variable string, value double")
    return ImputationResult(data, traces, tuple(dict.fromkeys(run.warned)), True)
