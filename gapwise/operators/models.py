"""Model-based imputation. Rows stay distributed; the driver solves systems of columns squared numbers.

A regression needs one aggregate of cross products (or one per Newton step); draws come from hashes of the
seed and the row's key, so that reruns and other partitionings give the same values.
"""

from __future__ import annotations

import re
import tempfile
import warnings
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.config import resolve_strict_mode
from gapwise.errors import ConfigurationError, ImputationError, InsufficientDataError
from gapwise.functions import nullity
from gapwise.functions.draws import normal, uniform
from gapwise.operators.donors import categories, encoded
from gapwise.operators.fill import apply_fill, fill_values
from gapwise.operators.validate import validate_columns, validate_positive_int
from gapwise.plans.fused import missing_counts, scalars
from gapwise.plans.ordered import with_position
from gapwise.plans.products import cross_products


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir; on one machine a folder of our own will do."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ConfigurationError("spark.checkpoint.dir", None, "must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gapwise-"))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by the hash of their key and kept: a small file is read by few tasks, but work on its rows should take all."""
    return reliable(df.repartition(nullity.column(key)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, computed once however often a lambda inside asks for it; the planner would copy it there from a column."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_hot(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Numbers with 0 for missing, and a 0/1 column per category, missing included as one (the first level is left out)."""
    out = []
    cats = categories(df, [c for c in columns if not nullity.is_numeric(df, c)])
    for c in columns:
        v = nullity.value(df, c)
        if c in cats:
            out += [F.coalesce((v == F.lit(x)).cast("double"), F.lit(0.0)) for x in cats[c][1:]] + [v.isNull().cast("double")]
        else:
            out.append(F.coalesce(v.cast("double"), F.lit(0.0)))
    return out


#: Of more columns than these, cross products and draws are matrix products in tasks, as expressions of their squares stop the planner.
WIDE = 32
#: Targets of a wide frame that are imputed before the lineage is cut.
WIDE_STEPS = 16


def gram(df: DataFrame, x: Sequence[Column], y: Column | None = None, weight: Column | None = None, by: Sequence[str] = ()) -> dict:
    """n and the cross products of [1, x, y] for each group: one partial aggregate, or matrices where columns are many."""
    cols = [F.lit(1.0), *x, *([y] if y is not None else [])]
    if len(cols) > WIDE and len(by) < 2:
        found = cross_products(df, cols, weight, nullity.column(by[0]) if by else None)
        return {(g,) if by else (): sums for g, sums in found.items()}
    named = df.select(*by, *[c.cast("double").alias(f"g{i}") for i, c in enumerate(cols)], (weight if weight is not None else F.lit(1.0)).alias("w"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("w") * F.col(f"g{i}") * F.col(f"g{j}")).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[tuple(r[c] for c in by)] = (r["n"], m)
    return out


def fit_logistic(df: DataFrame, y: Column, x: Sequence[Column], *, max_iter: int = 50, ridge: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """Coefficients (intercept first), log-likelihood and convergence of an unpenalised logistic regression.

    Features are scaled once; each Newton step is one aggregate of the gradient and the information matrix.
    """
    x = list(x)
    stats = scalars(df, n=F.count(F.lit(1)), **{f"m{i}": F.avg(c) for i, c in enumerate(x)}, **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(x)})
    use = [i for i in range(len(x)) if (stats[f"s{i}"] or 0.0) > 1e-12]
    z = [F.lit(1.0), *[(x[i] - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"]) for i in use]]
    rows = df.select(y.cast("double").alias("y"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    k = len(z)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta, last, ok = np.zeros(k), -np.inf, False
    for _ in range(max_iter):
        eta = sum((F.col(f"z{i}") * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
        scored = rows.withColumn("p", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-eta)))))
        r = scored.agg(
            F.sum(F.when(F.col("y") > 0.5, F.log("p")).otherwise(F.log(1 - F.col("p")))).alias("ll"),
            *[F.sum((F.col("y") - F.col("p")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(k)],
            *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        ll = r["ll"]
        if abs(ll - last) < 1e-9 * (1 + abs(ll)):
            ok, last = True, ll
            break
        last = ll
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        step = np.linalg.solve(h + ridge * np.trace(h) / k * np.eye(k) + 1e-12 * np.eye(k), np.array([r[f"g{i}"] for i in range(k)]))
        beta = beta + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
    coef = np.zeros(len(x) + 1)
    coef[0] = beta[0]
    for b, i in zip(beta[1:], use, strict=True):
        coef[i + 1] = b / stats[f"s{i}"]
        coef[0] -= b * stats[f"m{i}"] / stats[f"s{i}"]
    return coef, float(last), ok


def logistic_log_likelihood(df: DataFrame, probability: Column, y: Column) -> float:
    """The Bernoulli log-likelihood, probabilities clipped at 1e-12."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), probability))
    return df.agg(F.sum(F.when(y > 0.5, F.log(p)).otherwise(F.log(1 - p)))).first()[0]


def bayesian_ridge(n: int, m: np.ndarray, *, max_iter: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and covariance of the coefficients (intercept first) and the noise variance, from cross products of [1, x, y].

    Evidence maximisation with Gamma(1e-6, 1e-6) priors on both precisions, after centring.
    """
    p = len(m) - 2
    mean = m[0, 1:] / n
    xx = m[1:-1, 1:-1] - n * np.outer(mean[:-1], mean[:-1])
    xy = m[1:-1, -1] - n * mean[:-1] * mean[-1]
    yy = max(m[-1, -1] - n * mean[-1] ** 2, 0.0)
    eigen, basis = np.linalg.eigh(xx) if p else (np.zeros(0), np.zeros((0, 0)))
    eigen = np.maximum(eigen, 0.0)
    alpha, lam, w = 1.0 / (yy / n + 1e-12), 1.0, np.zeros(p)
    for _ in range(max_iter):
        new = basis @ ((basis.T @ xy) / (eigen + lam / alpha)) if p else w
        sse = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        gamma = float(np.sum(alpha * eigen / (lam + alpha * eigen)))
        lam = (gamma + 2e-6) / (float(new @ new) + 2e-6)
        alpha = (n - gamma + 2e-6) / (sse + 2e-6)
        done, w = np.abs(new - w).sum() < tol, new
        if done:
            break
    cov = basis @ np.diag(1 / (alpha * eigen + lam)) @ basis.T if p else np.zeros((0, 0))
    return np.concatenate([[mean[-1] - w @ mean[:-1]], w]), cov, 1.0 / alpha


class _Coded:
    """A frame in numbers: row id, chain, every column as a double (categories by place), and missing marks."""

    def __init__(self, df: DataFrame, row_id: str, chains: Sequence[int] = (0,)):
        self.df, self.row_id = df, row_id
        self.columns = [c for c in df.columns if c != row_id]
        counts = {r.variable: (r.n_miss, r.n_rows) for r in missing_counts(df.drop(row_id)).collect()}
        for c, (gone, n) in counts.items():
            if n and gone == n:
                raise InsufficientDataError(c, 0)
        self.targets = [c for c in self.columns if counts[c][0]]
        self.levels = categories(df, [c for c in self.columns if not nullity.is_numeric(df, c)])
        self.at = {c: i for i, c in enumerate(self.columns)}
        coded = df.select(nullity.column(row_id).alias("__id"), *[v.alias(f"v{i}") for i, v in enumerate(encoded(df, self.columns, self.levels))])
        marks = {f"m{i}": F.col(f"v{i}").isNull() for i in range(len(self.columns))}
        self.coded = coded.withColumns(marks).withColumn("chain", F.explode(F.array(*[F.lit(int(c)) for c in chains])))
        means = scalars(coded, **{f"a{i}": F.avg(f"v{i}") for i in range(len(self.columns))})
        self.means = [means[f"a{i}"] for i in range(len(self.columns))]
        self.start = spread(self.coded.withColumns({f"v{i}": F.coalesce(f"v{i}", F.lit(self.means[i])) for i in range(len(self.columns))}), "__id")

    def decoded(self, coded: DataFrame, only: Mapping[str, Column] | None = None, chain: bool = False) -> DataFrame:
        """The original columns with the coded values where they were missing."""
        made = {}
        for c in self.targets:
            v = F.col(f"v{self.at[c]}")
            if c in self.levels:
                place = F.greatest(F.lit(0), F.least(F.bround(v), F.lit(len(self.levels[c]) - 1))).cast("int")
                v = F.get(F.array(*[F.lit(x) for x in self.levels[c]]), place)
            made[c] = v.alias(f"__f_{c}")
        fills = coded.select("__id", F.col("chain").alias("__chain"), *made.values())
        joined = self.df.join(fills, nullity.column(self.row_id) == F.col("__id"))
        out = []
        for c in self.df.columns:
            if c not in made:
                out.append(nullity.column(c))
                continue
            fill = nullity.column(f"__f_{c}")
            if only and c in only:
                fill = F.when(only[c], fill)
            old = nullity.value(self.df, c)
            out.append(F.coalesce(old if c in self.levels else old.cast("double"), fill).alias(c))
        return joined.select(*([F.col("__chain").alias("chain")] if chain else []), *out)


def _posterior(fits: Mapping[int, tuple], chain: Column, x: Sequence[Column]) -> Column:
    """struct(line, spread): the mean of each row's prediction and its variance, by one matrix product per batch and chain."""

    def predict(chains: pd.Series, rows: pd.Series) -> pd.DataFrame:
        values, of = np.array(rows.tolist(), dtype=float), chains.to_numpy()
        out = np.full((len(of), 2), np.nan)
        for c, (w, cov, mean, noise) in fits.items():
            mine = of == c
            z, off = values[mine], values[mine] - mean
            out[mine, 0] = w[0] + z @ w[1:]
            out[mine, 1] = noise + ((off @ cov) * off).sum(axis=1)
        return pd.DataFrame(out, columns=["line", "spread"])

    return F.pandas_udf(predict, "line double, spread double")(chain, F.array(*x))


def impute_mice(df: DataFrame, row_id: str, max_iter: int = 10, random_state: int = 0, *, n_imputations: int = 1, sample_posterior: bool = True, visit_sequence: Sequence[str] | None = None, predictor_matrix: Mapping[str, Sequence[str]] | None = None, where: Mapping[str, Column] | None = None, bounds: Mapping[str, tuple[float, float]] | None = None, return_history: bool = False):
    """Chained equations by Bayesian ridge regression with posterior draws.

    All ``n_imputations`` chains are one frame with a ``chain`` column (left out for a single one). A step is one
    aggregate of cross products per chain, a solution on the driver and a projection; each iteration is
    checkpointed. Categories are regressed by their place, rounded and clipped. ``predictor_matrix`` maps a
    target to its predictors, ``where`` to a condition for the cells to fill, ``bounds`` to limits. With
    ``return_history`` also a frame (chain, iter, variable, value) of the mean imputed values.
    """
    validate_positive_int(max_iter, param="max_iter")
    validate_positive_int(n_imputations, param="n_imputations")
    state = _Coded(df, row_id, range(n_imputations))
    order = [c for c in validate_columns(df, visit_sequence, param="visit_sequence") if c in state.targets] if visit_sequence else state.targets
    now, history = state.start, []
    for it in range(max_iter):
        for c in order:
            t = state.at[c]
            used = [state.at[x] for x in (predictor_matrix or {}).get(c, [x for x in state.columns if x != c])]
            sums = gram(now.where(~F.col(f"m{t}")), [F.col(f"v{i}") for i in used], F.col(f"v{t}"), by=["chain"])
            made, fits = F.lit(None).cast("double"), {}
            for (chain,), (n, m) in sums.items():
                w, cov, noise = bayesian_ridge(n, m)
                mean = m[0, 1:-1] / n
                fits[chain] = (w, cov, mean, float(noise))
            predictors, label = [F.col(f"v{i}") for i in used], f"mice/{it}/{c}"
            if len(used) > WIDE:
                now = now.withColumn("__p", _posterior(fits, F.col("chain"), predictors))
            for chain, (w, cov, mean, noise) in fits.items():
                if len(used) > WIDE:
                    line, spread = F.col("__p.line"), F.col("__p.spread")
                else:
                    line = sum((F.lit(float(b)) * v for b, v in zip(w[1:], predictors, strict=True)), F.lit(float(w[0])))
                    off = [v - F.lit(float(mu)) for v, mu in zip(predictors, mean, strict=True)]
                    spread = F.lit(noise)
                    if sample_posterior:
                        for a in range(len(used)):
                            for b in range(len(used)):
                                spread = spread + F.lit(float(cov[a, b])) * off[a] * off[b]
                if sample_posterior:
                    line = line + normal(random_state + chain, label, F.col("__id")) * F.sqrt(F.greatest(spread, F.lit(0.0)))
                made = F.when(F.col("chain") == chain, line).otherwise(made)
            if bounds and c in bounds:
                made = F.greatest(F.lit(float(bounds[c][0])), F.least(F.lit(float(bounds[c][1])), made))
            now = now.withColumn(f"v{t}", F.when(F.col(f"m{t}"), made).otherwise(F.col(f"v{t}"))).drop("__p")
            if len(used) > WIDE and (order.index(c) + 1) % WIDE_STEPS == 0:
                now = reliable(now)
        now = reliable(now)
        if return_history:
            means = now.groupBy("chain").agg(*[F.avg(F.when(F.col(f"m{state.at[c]}"), F.col(f"v{state.at[c]}"))).alias(f"h{state.at[c]}") for c in order]).collect()
            history += [(r["chain"], it, c, r[f"h{state.at[c]}"]) for r in means for c in order]
    out = state.decoded(now, where, chain=n_imputations > 1)
    return (out, df.sparkSession.createDataFrame(history, "chain int, iter int, variable string, value double")) if return_history else out


def _numbered(donors: DataFrame, by: list[str]) -> DataFrame:
    """The donors with their place, from 1, in the order of (score, donor); kept, as what follows reads them several times."""
    return reliable(with_position(donors.select(*by, "donor", "score", "value"), ["score", "donor"], by).withColumnRenamed("__pos", "place"))


def _near_scores(recipients: DataFrame, placed: DataFrame, k: int, by: list[str]) -> DataFrame:
    """A row per distinct score of the recipients: n of them, and near, up to 2k distinct scores of donors, the nearest first.

    An entry (dist, of, first, count) says that donors of places first + 1 to first + count have the score ``of``; ties of
    distance go to the lower score. Both kinds of scores are sorted together, range by range, so that the k donor scores on
    either side are found by equi-joins on their number.
    """
    groups = placed.groupBy(*by, "score").agg((F.min("place") - 1).alias("first"), F.count(F.lit(1)).alias("count"))
    scores = recipients.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = groups.withColumns({"n": none, "kind": none}).unionByName(scores.withColumns({"first": none, "count": none, "kind": one}))
    ranked = reliable(with_position(reliable(both), ["score", "kind"], by, {"number": one - F.col("kind")}))
    ask = ranked.where("kind = 1").select(*by, F.col("score").alias("asked"), "n", F.explode(F.sequence(F.col("number") - k + 1, F.col("number") + k)).alias("number"))
    met = ask.join(ranked.where("kind = 0").select(*by, "number", "score", "first", "count"), [*by, "number"])
    entry = F.struct(F.abs(F.col("asked") - F.col("score")).alias("dist"), F.col("score").alias("of"), "first", "count")
    return met.groupBy(*by, "asked").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("near")).withColumnRenamed("asked", "score")


def _given(recipients: DataFrame, lists: DataFrame, by: list[str]) -> DataFrame:
    """The recipients with the list of their score; lists of scores that many share are broadcast, a few per shuffle partition and key."""
    many = 4 * int(recipients.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1.0, (lists.agg(F.sum("n")).first()[0] or 0) / many)
    on, shared, rare = [*by, "score"], lists.where(F.col("n") > limit).drop("n"), lists.where(F.col("n") <= limit).drop("n")
    met = recipients.join(F.broadcast(shared), on, "left")
    return met.where(F.col("near").isNotNull()).unionByName(met.where(F.col("near").isNull()).drop("near").join(rare, on))


def nearest_scores(recipients: DataFrame, donors: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """id, donor, value, rank: the k donors of nearest score of each recipient (id, score), from donors (donor, score, value).

    Ties go to the lower score, then to the smallest donor. With ``by`` donors are sought among those of equal key, such as a
    chain. Recipients of one score ask once.
    """
    by = list(by)
    placed = _numbered(donors, by)
    lists = _near_scores(recipients, placed, k, by)
    of = lambda g: F.transform(F.sequence(F.lit(1).cast("bigint"), F.least(g["count"], F.lit(k))), lambda i: g["first"] + i)
    places = lists.select(*by, "score", "n", F.posexplode(F.slice(F.flatten(F.transform("near", of)), 1, k)).alias("at", "place"))
    held = places.join(placed.select(*by, "place", "donor", "value"), [*by, "place"])
    chosen = held.groupBy(*by, "score").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "donor", "value"))).alias("near"))
    near = _given(recipients, reliable(chosen), by).select(*by, "id", F.explode("near").alias("near"))
    return near.select(*by, "id", "near.donor", "near.value", (F.col("near.at") + 1).alias("rank"))


def donor_values(recipients: DataFrame, donors: DataFrame, k: int, drawn: Column, within: Column, by: Sequence[str] = ()) -> DataFrame:
    """id, value: one of the k nearest donors, pointed at by ``drawn`` in [0, 1).

    Of a score that more donors share than are needed, any of them is taken, as ``within`` in [0, 1) says: recipients of
    one score spread over all donors of the nearest scores, and so do their look-ups.
    """
    by = list(by)
    placed = _numbered(donors, by)
    given = _given(recipients, reliable(_near_scores(recipients, placed, k, by)), by)
    zero, end = F.lit(0).cast("bigint"), F.lit(k).cast("bigint")
    there = F.least(end, F.aggregate("near", zero, lambda s, g: s + g["count"]))
    begin = F.struct(zero.alias("before"), F.lit(None).cast("bigint").alias("place"))

    def walked(asked: Column) -> Column:
        def step(at: Column, g: Column) -> Column:
            upto = at["before"] + g["count"]
            own = F.when(upto <= end, asked["rank"] - at["before"]).otherwise(F.floor(asked["within"] * g["count"]))
            here = at["place"].isNull() & (asked["rank"] < upto)
            return F.struct(upto.alias("before"), F.when(here, g["first"] + own + 1).otherwise(at["place"]).alias("place"))

        return F.aggregate("near", begin, step, lambda at: at["place"])

    place = bound(there, lambda n: bound(F.struct(F.least(F.floor(drawn * n), n - 1).alias("rank"), within.alias("within")), walked))
    asks = given.select(*by, "id", place.alias("place"))
    return asks.join(placed.select(*by, "place", "value"), [*by, "place"]).select(*by, "id", "value")


def impute_pmm(df: DataFrame, row_id: str, max_iter: int = 10, random_state: int = 0, n_nearest_donors: int = 5) -> DataFrame:
    """Predictive mean matching on the numeric columns; the others get their mode.

    Donors are scored by the posterior mean of the coefficients, recipients by a draw of them (type 1), and
    each recipient takes the observed value of one of its k nearest donors.
    """
    validate_positive_int(n_nearest_donors, param="n_nearest_donors")
    cats = [c for c in df.columns if c != row_id and not nullity.is_numeric(df, c)]
    base = apply_fill(df, fill_values(df, "mode", cats)) if cats else df
    numeric = [c for c in nullity.numeric_columns(df) if c != row_id]
    state = _Coded(df.select(row_id, *numeric), row_id)
    rng = np.random.default_rng(random_state)
    now = state.start
    for it in range(max_iter):
        for c in state.targets:
            t, used = state.at[c], [i for i in range(len(state.columns)) if i != state.at[c]]
            n, m = gram(now.where(~F.col(f"m{t}")), [F.col(f"v{i}") for i in used], F.col(f"v{t}"))[()]
            w, cov, _ = bayesian_ridge(n, m)
            drawn = rng.multivariate_normal(w[1:], cov) if used else w[1:]
            line = lambda b, used=used, w=w: sum((F.lit(float(x)) * F.col(f"v{i}") for x, i in zip(b, used, strict=True)), F.lit(float(w[0])))
            donors = now.where(~F.col(f"m{t}")).select(F.col("__id").alias("donor"), line(w[1:]).alias("score"), F.col(f"v{t}").alias("value"))
            asked = now.where(F.col(f"m{t}")).select(F.col("__id").alias("id"), line(drawn).alias("score"))
            k = min(n_nearest_donors, n)
            fills = donor_values(asked, donors, k, uniform(random_state, f"pmm/{it}/{c}", F.col("id")), uniform(random_state, f"pmm/{it}/{c}/tied", F.col("id"))).select(F.col("id").alias("f_id"), F.col("value").alias("f_value"))
            now = now.join(fills, now["__id"] == fills["f_id"], "left").withColumn(f"v{t}", F.coalesce("f_value", f"v{t}")).drop("f_id", "f_value")
            now = reliable(now)
    done = state.decoded(now)
    out = base.drop(*numeric).join(done, row_id) if cats else done
    return out.select(*[nullity.column(c) for c in df.columns])


def _softmax_fit(df: DataFrame, label: Column, x: Sequence[Column], k: int):
    from pyspark.ml.classification import LogisticRegression

    rows = df.select(label.cast("double").alias("label"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)])
    made = VectorAssembler(inputCols=[f"x{i}" for i in range(len(x))], outputCol="features").transform(rows)
    return LogisticRegression(family="multinomial", maxIter=100, regParam=0.0).fit(made)


def _categorical(df: DataFrame, row_id: str, chosen: Sequence[str], label_of, random_state: int, strict_mode: bool | None, strategy: str) -> DataFrame:
    """Fill each chosen column by ``label_of(rows, target, features, levels)``, a column of the filled value; fall back to the mode."""
    strict = resolve_strict_mode(strict_mode)
    out = df
    for c in chosen:
        others = [x for x in df.columns if x not in (c, row_id)]
        values = categories(df, [c])[c]
        features = one_hot(df, others)
        try:
            made = label_of(df.where(~nullity.miss(df, c)), c, features, values)
        except (ValueError, np.linalg.LinAlgError) as exc:
            if strict:
                raise ImputationError(c, strategy, exc) from exc
            made = F.lit(fill_values(df, "mode", [c])[c])
        fills = df.where(nullity.miss(df, c)).select(nullity.column(row_id).alias("__id"), made.alias("__fill"))
        out = out.join(fills, out[row_id] == fills["__id"], "left").withColumn(c, F.coalesce(nullity.value(df, c), F.col("__fill").cast(df.schema[c].dataType))).drop("__id", "__fill")
    return out.select(*[nullity.column(c) for c in df.columns])


def _incomplete(df: DataFrame, row_id: str) -> list[str]:
    rows = missing_counts(df.drop(row_id)).collect()
    for r in rows:
        if r.n_rows and r.n_rows == r.n_miss:
            raise InsufficientDataError(r.variable, 0)
    return [r.variable for r in rows if r.n_miss]


def _distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    found = scalars(df, **{f"d{i}": F.count_distinct(nullity.value(df, c)) for i, c in enumerate(columns)}) if columns else {}
    return {c: found[f"d{i}"] for i, c in enumerate(columns)}


def impute_logreg(df: DataFrame, row_id: str, random_state: int = 0, strict_mode: bool | None = None) -> DataFrame:
    """Columns with exactly two distinct values: a logistic probability against a uniform draw."""
    resolve_strict_mode(strict_mode)
    levels = _distinct(df, _incomplete(df, row_id))

    def label(rows: DataFrame, c: str, features: list[Column], values: list) -> Column:
        coef, _, _ = fit_logistic(rows, (nullity.column(c) == F.lit(values[1])).cast("double"), features)
        eta = sum((F.lit(float(b)) * x for b, x in zip(coef[1:], features, strict=True)), F.lit(float(coef[0])))
        drawn = uniform(random_state, f"logreg/{c}", nullity.column(row_id)) < 1 / (1 + F.exp(-eta))
        return F.when(drawn, F.lit(values[1])).otherwise(F.lit(values[0]))

    return _categorical(df, row_id, [c for c, n in levels.items() if n == 2], label, random_state, strict_mode, "logreg")


def _most_probable(values: list, scores: list[Column]) -> Column:
    best = F.array_max(F.array(*[F.struct(e.alias("eta"), F.lit(-i).alias("i")) for i, e in enumerate(scores)]))
    return F.get(F.array(*[F.lit(v) for v in values]), -best["i"])


def _place(values: list, c: str) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), nullity.column(c)) - 1


def _multinomial(rows: DataFrame, c: str, features: list[Column], values: list) -> Column:
    model = _softmax_fit(rows, _place(values, c), features, len(values))
    weight, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return _most_probable(values, [sum((F.lit(float(b)) * x for b, x in zip(row, features, strict=True)), F.lit(float(bias[i]))) for i, row in enumerate(weight)])


def impute_polyreg(df: DataFrame, row_id: str, random_state: int = 0, strict_mode: bool | None = None) -> DataFrame:
    """Text columns with three levels or more: the most probable level of a multinomial regression."""
    resolve_strict_mode(strict_mode)
    gone = [c for c in _incomplete(df, row_id) if not nullity.is_numeric(df, c)]
    return _categorical(df, row_id, [c for c, n in _distinct(df, gone).items() if n >= 3], _multinomial, random_state, strict_mode, "polyreg")


def fit_ordinal(df: DataFrame, place: Column, x: Sequence[Column], levels: int, *, max_iter: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and slopes of a proportional-odds model, P(place <= j) = sigmoid(threshold_j - x . slopes), by maximum likelihood.

    Newton's method: each step is one job in which tasks add up the log-likelihood, its gradient and its curvature as matrices
    over their rows. A step is halved until the thresholds stay in order and the likelihood doesn't fall. Features that
    don't vary get a slope of 0. Raises ValueError where a level is empty or no finite maximum is found.
    """
    x = list(x)
    stats = scalars(df, n=F.count(F.lit(1)), **{f"m{i}": F.avg(c) for i, c in enumerate(x)}, **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(x)})
    use = [i for i in range(len(x)) if (stats[f"s{i}"] or 0.0) > 1e-12]
    mean, scale = (np.array([stats[f"{k}{i}"] for i in use], dtype=float) for k in "ms")
    rows = df.select(place.cast("int").alias("y"), F.array(*[x[i].cast("double") for i in use], F.lit(0.0)).alias("x")).where("y >= 0")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < levels or levels < 3:
        raise ValueError("every level needs an observed row, and there must be three at least")
    cuts, p = levels - 1, len(use)
    size = cuts + p

    def sums(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        theta, beta = np.r_[-np.inf, t[:cuts], np.inf], t[cuts:]

        def run(batches):
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                y = batch["y"].to_numpy(dtype=np.int64)
                z = (np.array(batch["x"].tolist(), dtype=float).reshape(len(y), p + 1)[:, :p] - mean) / scale
                eta = z @ beta
                parts = []
                for k in (y + 1, y):
                    f = 1 / (1 + np.exp(-np.clip(theta[k] - eta, -700, 700)))
                    near = np.zeros((len(y), size))
                    inner = np.flatnonzero((k > 0) & (k < levels))
                    near[inner, k[inner] - 1] = 1.0
                    near[inner, cuts:] = -z[inner]
                    parts.append((np.where(k == 0, 0.0, np.where(k == levels, 1.0, f)), np.where((k > 0) & (k < levels), f * (1 - f), 0.0), near))
                (fa, da, za), (fb, db, zb) = parts
                prob = np.maximum(fa - fb, 1e-300)
                ga, gb = da / prob, -db / prob
                haa, hbb, hab = da * (1 - 2 * fa) / prob - ga**2, -db * (1 - 2 * fb) / prob - gb**2, -ga * gb
                cross = (za * hab[:, None]).T @ zb
                h = (za * haa[:, None]).T @ za + (zb * hbb[:, None]).T @ zb + cross + cross.T
                total += np.concatenate([[np.log(prob).sum()], za.T @ ga + zb.T @ gb, h.ravel()])
            yield pd.DataFrame({"part": [total.tobytes()]})

        got = sum(np.frombuffer(r.part) for r in rows.mapInPandas(run, "part binary").collect())
        return float(got[0]), got[1 : 1 + size], got[1 + size :].reshape(size, size)

    share = np.cumsum([counts[j] for j in range(cuts)]) / sum(counts.values())
    t = np.r_[np.log(share / (1 - share)), np.zeros(p)]
    value, gradient, h = sums(t)
    for _ in range(max_iter):
        step = np.linalg.solve(-h + 1e-10 * np.trace(-h) / size * np.eye(size), gradient)
        if not np.isfinite(step).all():
            raise ValueError("the likelihood has no finite maximum")
        rate = 1.0
        while True:
            new = t + rate * step
            if (np.diff(new[:cuts]) > 0).all():
                found = sums(new)
                if found[0] >= value - 1e-10 * abs(value):
                    break
            rate /= 2
            if rate < 1e-8:
                raise ValueError("no step raises the likelihood")
        gain, t, (value, gradient, h) = found[0] - value, new, found
        if abs(rate * step).max() < 1e-9 or (gain < 1e-11 * abs(value) and np.abs(gradient).max() < 1e-6 * stats["n"]):
            break
        if np.abs(t).max() > 1e6:
            raise ValueError("the likelihood has no finite maximum")
    else:
        raise ValueError("no convergence")
    slopes = np.zeros(len(x))
    slopes[use] = t[cuts:] / scale
    return t[:cuts] + float(slopes[use] @ mean), slopes


def impute_polr(df: DataFrame, row_id: str, random_state: int = 0, strict_mode: bool | None = None, *, orders: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Ordered levels by a proportional-odds model of maximum likelihood: the most probable level.

    ``orders`` gives level orders, by default sorted. Where the model can't be fitted, strict mode raises; else a warning is
    given and a multinomial regression fills, and the mode where that fails too.
    """
    strict = resolve_strict_mode(strict_mode)
    gone = [c for c in _incomplete(df, row_id) if not nullity.is_numeric(df, c)]

    def label(rows: DataFrame, c: str, features: list[Column], values: list) -> Column:
        values = list((orders or {}).get(c, values))
        try:
            thresholds, slopes = fit_ordinal(rows, _place(values, c), features, len(values))
        except (ValueError, np.linalg.LinAlgError) as exc:
            if strict:
                raise
            warnings.warn(f"impute_polr: the ordinal model failed for column {c!r} ({exc}); a multinomial regression fills it", UserWarning, stacklevel=4)
            return _multinomial(rows, c, features, values)
        line = sum((F.lit(float(b)) * x for b, x in zip(slopes, features, strict=True)), F.lit(0.0))
        upto = [F.lit(0.0), *[1 / (1 + F.exp(line - F.lit(float(s)))) for s in thresholds], F.lit(1.0)]
        return _most_probable(values, [upto[i + 1] - upto[i] for i in range(len(values))])

    return _categorical(df, row_id, [c for c, n in _distinct(df, gone).items() if n >= 3], label, random_state, strict_mode, "polr")


def tree(kind: str, n_levels: int, seed: int, label: str, options: Mapping[str, object]):
    """Trees for a number, or to tell the places of a category's levels; their prediction is __p."""
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "__p"}
    if kind == "rf":
        return (RandomForestClassifier if n_levels else RandomForestRegressor)(seed=seed, **common, **options)
    if n_levels > 2:
        return OneVsRest(classifier=GBTClassifier(seed=seed, featuresCol="features", labelCol=label, **options), **common)
    return (GBTClassifier if n_levels == 2 else GBTRegressor)(seed=seed, **common, **options)



def _trees(df: DataFrame, row_id: str, kind: str, max_iter: int, random_state: int, strict_mode: bool | None, options: dict) -> DataFrame:
    """Round-robin over the incomplete columns: fit on rows where the column was observed, predict the others."""
    strict = resolve_strict_mode(strict_mode)
    state = _Coded(df, row_id)
    now = state.start
    for _ in range(max_iter):
        for c in state.targets:
            t, used = state.at[c], [i for i in range(len(state.columns)) if i != state.at[c]]
            made = VectorAssembler(inputCols=[f"v{i}" for i in used], outputCol="features").transform(now)
            n = len(state.levels.get(c, ()))
            model = tree(kind, n, random_state, f"v{t}", options)
            train = made.where(~F.col(f"m{t}"))
            try:
                if n == 1:
                    continue
                fitted = model.fit(train)
            except ValueError as exc:
                if strict:
                    raise ImputationError(c, kind, exc) from exc
                continue
            scored = fitted.transform(made).withColumn(f"v{t}", F.when(F.col(f"m{t}"), F.col("__p").cast("double")).otherwise(F.col(f"v{t}")))
            now = reliable(scored.select(*now.columns))
    return state.decoded(now)


def impute_rf(df: DataFrame, row_id: str, max_iter: int = 1, random_state: int = 0, strict_mode: bool | None = None, **options) -> DataFrame:
    """Random forests; features that are missing count as the training mean."""
    return _trees(df, row_id, "rf", max_iter, random_state, strict_mode, {"numTrees": 20, "maxDepth": 6} | options)


def impute_gb(df: DataFrame, row_id: str, max_iter: int = 1, random_state: int = 0, strict_mode: bool | None = None, **options) -> DataFrame:
    """Gradient-boosted trees; one against the rest for more than two categories."""
    return _trees(df, row_id, "gb", max_iter, random_state, strict_mode, {"maxIter": 10, "maxDepth": 4} | options)


