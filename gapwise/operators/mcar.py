"""Tests of the missingness mechanism. Rows are added up per pattern once; all iterations run on those sums, on the driver while
they are few and on the executors beyond."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError, InsufficientDataError
from gapwise.functions import nullity
from gapwise.functions.distributions import chi2_sf
from gapwise.operators.models import fit_logistic, one_hot
from gapwise.operators.patterns import nullity_correlation
from gapwise.plans.fused import missing_counts, scalars

Values = Iterable[object] | None


#: Pattern sums of so many bytes are worked on by the driver; more stay on the executors.
DRIVER_BYTES = 32 << 20
#: Bytes of pattern sums that a task holds before it passes them on; tasks of an expectation step.
HELD_BYTES, TASKS = 64 << 20, 64


def pattern_sums(df: DataFrame, columns: list[str], centre: list[float]) -> DataFrame:
    """mask (a byte per column, 1 where observed), n, sums: the sums and cross products of the centred columns of each pattern.

    Tasks add up the rows of a pattern in matrices, so the plan doesn't grow with the columns and a pattern that holds most
    rows reaches the shuffle as one row per task; these are added in two steps.
    """
    p, nan = len(columns), F.lit(float("nan"))
    x = F.array(*[F.coalesce(nullity.value(df, c).cast("double") - F.lit(m), nan) for c, m in zip(columns, centre, strict=True)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        part = TaskContext.get().partitionId() % TASKS

        def passed() -> pd.DataFrame:
            out = pd.DataFrame({"mask": list(held), "part": part, "n": [v[0] for v in held.values()], "sums": [v[1].tobytes() for v in held.values()]})
            held.clear()
            return out

        for batch in batches:
            rows = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), p)
            seen = ~np.isnan(rows)
            masks, of = np.unique(seen, axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(of.ravel(), minlength=len(masks)))
            for mask, mine in zip(masks, np.split(order, ends[:-1]), strict=True):
                z = np.where(seen[mine], rows[mine], 0.0)
                old = held.setdefault(mask.astype(np.uint8).tobytes(), [0, np.zeros(p + p * p)])
                old[0] += len(mine)
                old[1] += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
            if len(held) * 8 * (p + p * p) > HELD_BYTES:
                yield passed()
        if held:
            yield passed()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(s) for s in rows["sums"]), np.zeros(p + p * p))
        return pd.DataFrame({"mask": rows["mask"].iloc[:1], "part": rows["part"].iloc[:1], "n": [int(rows["n"].sum())], "sums": [total.tobytes()]})

    schema = "mask binary, part int, n bigint, sums binary"
    once = df.select(x.alias("x")).mapInPandas(partial, schema).groupBy("mask", "part").applyInPandas(added, schema)
    return once.groupBy("mask").applyInPandas(added, schema).drop("part")


def _unpacked(rows) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    out = []
    for mask, n, sums in rows:
        o = np.frombuffer(mask, dtype=np.uint8).astype(bool)
        v = np.frombuffer(sums)
        out.append((o, n, v[: len(o)], v[len(o) :].reshape(len(o), len(o))))
    return sorted(out, key=lambda t: tuple(t[0]))


def pattern_moments(df: DataFrame, columns: list[str], centre: list[float]) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(observed, n, sums, cross products) of each pattern of the centred columns, for the driver."""
    return _unpacked(pattern_sums(df, columns, centre).select("mask", "n", "sums").collect())


Patterns = Iterable[tuple[np.ndarray, int, np.ndarray, np.ndarray]]


def _begun(patterns: Patterns, p: int, mu: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows, observed cells and sums of each column; with ``mu`` also the cross products around it of the cells that are observed."""
    n, seen, first, second = np.zeros(1), np.zeros(p), np.zeros(p), np.zeros((p, p))
    for o, k, s, c in patterns:
        n += k
        seen += k * o
        first += np.where(o, s, 0.0)
        if mu is not None:
            second += np.where(np.outer(o, o), c - np.outer(mu, s) - np.outer(s, mu) + k * np.outer(mu, mu), 0.0)
    return [n, seen, first, second]


def _expected(patterns: Patterns, mu: np.ndarray, sigma: np.ndarray, ridge: float) -> list[np.ndarray]:
    """The expected sums and cross products of all cells, given what is observed."""
    p = len(mu)
    first, second = np.zeros(p), np.zeros((p, p))
    for o, k, s, c in patterns:
        u = ~o
        b, extra = np.zeros((p, p)), np.zeros((p, p))
        if o.any():
            soo = sigma[np.ix_(o, o)] + ridge * np.eye(int(o.sum()))
            coef = np.linalg.solve(soo, sigma[np.ix_(o, u)]).T
            b[np.ix_(u, o)] = coef
            extra[np.ix_(u, u)] = sigma[np.ix_(u, u)] - coef @ sigma[np.ix_(o, u)]
        else:
            extra = sigma.copy()
        b[np.ix_(o, o)] = np.eye(int(o.sum()))
        shift = np.where(u, mu - b @ np.where(o, mu, 0.0), 0.0)
        s_o, c_o = np.where(o, s, 0.0), np.where(np.outer(o, o), c, 0.0)
        bs = b @ s_o
        first += bs + k * shift
        second += b @ c_o @ b.T + np.outer(bs, shift) + np.outer(shift, bs) + k * np.outer(shift, shift) + k * extra
    return [first, second]


def _distances(patterns: Patterns, mu: np.ndarray, sigma: np.ndarray, ridge: float) -> list[np.ndarray]:
    """Little's statistic, the observed columns of all patterns, and the number of patterns."""
    chi, observed, n = 0.0, 0, 0
    for o, k, s, _ in patterns:
        observed, n = observed + int(o.sum()), n + 1
        if o.any():
            d = s[o] / k - mu[o]
            chi += k * float(d @ np.linalg.solve(sigma[np.ix_(o, o)] + ridge * np.eye(int(o.sum())), d))
    return [np.array([chi]), np.array([float(observed), float(n)])]


class _Held:
    """Patterns on the driver."""

    def __init__(self, patterns):
        self.patterns = list(patterns)
        self.p = len(self.patterns[0][0])

    def total(self, f, *args) -> list[np.ndarray]:
        return f(self.patterns, *args)


class _Spread:
    """Patterns on the executors: each sum is one job over TASKS tasks, whose vectors are added in groups before the driver adds those."""

    def __init__(self, sums: DataFrame, p: int):
        from gapwise.operators.models import reliable

        self.sums, self.p = reliable(sums.select("mask", "n", "sums").repartition(TASKS)), p

    def total(self, f, *args) -> list[np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = None
            for batch in batches:
                for low in range(0, len(batch), 500):
                    new = f(_unpacked(batch.iloc[low : low + 500].itertuples(index=False, name=None)), *args)
                    parts = new if parts is None else [a + b for a, b in zip(parts, new, strict=True)]
            if parts is not None:
                yield pd.DataFrame({"at": [TaskContext.get().partitionId() // 8], "v": [np.concatenate([x.ravel() for x in parts]).tobytes()], "shapes": [json.dumps([x.shape for x in parts])]})

        def added(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": rows["at"].iloc[:1], "v": [sum(np.frombuffer(v) for v in rows["v"]).tobytes()], "shapes": rows["shapes"].iloc[:1]})

        schema = "at int, v binary, shapes string"
        rows = self.sums.mapInPandas(run, schema).groupBy("at").applyInPandas(added, schema).collect()
        shapes = [tuple(x) for x in json.loads(rows[0].shapes)]
        flat = np.split(sum(np.frombuffer(r.v) for r in rows), np.cumsum([math.prod(x) for x in shapes])[:-1])
        return [v.reshape(x) for v, x in zip(flat, shapes, strict=True)]


def em_moments(patterns, max_iter: int = 500, tol: float = 1e-7, ridge: float = 1e-8) -> tuple[np.ndarray, np.ndarray, int]:
    """Maximum-likelihood mean and covariance of a multivariate normal from pattern sums.

    Starts from mean-filled moments and stops when no parameter moves by more than ``tol``. ``patterns`` are a list or a
    holder of patterns; each iteration needs one sum over them.
    """
    held = patterns if isinstance(patterns, (_Held, _Spread)) else _Held(patterns)
    n, seen, first, _ = held.total(_begun, held.p)
    mu = first / np.maximum(seen, 1)
    sigma = held.total(_begun, held.p, mu)[3] / n[0]
    for step in range(1, max_iter + 1):
        first, second = held.total(_expected, mu, sigma, ridge)
        new_mu = first / n[0]
        new_sigma = second / n[0] - np.outer(new_mu, new_mu)
        new_sigma = (new_sigma + new_sigma.T) / 2
        moved = max(np.abs(new_mu - mu).max(), np.abs(new_sigma - sigma).max())
        mu, sigma = new_mu, new_sigma
        if moved <= tol:
            return mu, sigma, step
    raise RuntimeError(f"EM didn't converge in {max_iter} iterations")


def mcar_test(df: DataFrame, max_iter: int = 500, tol: float = 1e-7, ridge: float = 1e-8, missing_values: Values = None) -> DataFrame:
    """Little's test over the numeric columns, one row: chi_square, df, p_value, missing_patterns, amount_missing, em_iterations.

    Up to DRIVER_BYTES of pattern sums are worked on by the driver; more patterns stay in a reliable table on the executors,
    and each EM iteration is one sum over it. p_value is null if there are no degrees of freedom. Rows without any value form a pattern that adds nothing.
    """
    columns = nullity.numeric_columns(df)
    if len(columns) < 2:
        raise ConfigurationError("df", columns, "needs two numeric columns at least")
    clean = nullity.canonical(df.select(*[nullity.column(c) for c in columns]), missing_values)
    info = scalars(
        clean,
        n=F.count(F.lit(1)),
        any=F.count_if(nullity.row_count(nullity.flags(clean).values()) < len(columns)),
        **{f"n{i}": F.count(nullity.column(c)) for i, c in enumerate(columns)},
        **{f"m{i}": F.avg(nullity.column(c).cast("double")) for i, c in enumerate(columns)},
        inf=F.count_if(sum((F.coalesce(F.abs(nullity.column(c).cast("double")) == float("inf"), F.lit(False)).cast("int") for c in columns), F.lit(0)) > 0),
    )
    for i, c in enumerate(columns):
        if not info[f"n{i}"]:
            raise InsufficientDataError(c, 0)
    if info["inf"]:
        raise ConfigurationError("df", "infinite values", "must be finite")
    gone = info["n"] * len(columns) - sum(info[f"n{i}"] for i in range(len(columns)))
    if not gone:
        raise ConfigurationError("df", "no missing value", "needs one at least")
    if info["any"] <= len(columns):
        raise InsufficientDataError("rows", info["any"], len(columns) + 1)
    p = len(columns)
    sums = pattern_sums(clean, columns, [info[f"m{i}"] for i in range(p)]).select("mask", "n", "sums")
    most = max(1, DRIVER_BYTES // (8 * (p + p * p)))
    few = sums.limit(most + 1).collect()
    patterns = _Held(_unpacked(few)) if len(few) <= most else _Spread(sums, p)
    mu, sigma, steps = em_moments(patterns, max_iter, tol, ridge)
    (chi,), (observed, n) = (x.tolist() for x in patterns.total(_distances, mu, sigma, ridge))
    freedom = int(observed) - p
    p_value = chi2_sf(chi, freedom) if freedom > 0 else None
    row = (chi, freedom, p_value, int(n), gone, steps)
    return df.sparkSession.createDataFrame([row], "chi_square double, df bigint, p_value double, missing_patterns bigint, amount_missing bigint, em_iterations bigint")


def missingness_association_test(df: DataFrame, target: str, missing_values: Values = None, *, max_iter: int = 50) -> DataFrame:
    """variable, lr_statistic, p_value, converged for each other column with anything missing.

    A likelihood-ratio test (one degree of freedom) of two logistic regressions of observedness on the other
    columns, without and with ``target``. Each fit is Newton's method on sums that one aggregate gives.
    """
    clean = nullity.canonical(df, missing_values)
    counts = {r.variable: (r.n_miss, r.n_rows) for r in missing_counts(clean).collect()}
    if counts[target][0]:
        raise ConfigurationError("target", target, "has missing values")
    rows = []
    for c in [c for c in clean.columns if c != target and 0 < counts[c][0] < counts[c][1]]:
        others = [x for x in clean.columns if x not in (c, target)]
        features = one_hot(clean, others)
        outcome = one_hot(clean, [target])[:1]
        y = (~nullity.miss(clean, c)).cast("double")
        _, base, ok_a = fit_logistic(clean, y, features, max_iter=max_iter)
        _, full, ok_b = fit_logistic(clean, y, features + outcome, max_iter=max_iter)
        lr = max(0.0, 2 * (full - base))
        rows.append((c, lr, chi2_sf(lr, 1), ok_a and ok_b))
    return df.sparkSession.createDataFrame(rows, "variable string, lr_statistic double, p_value double, converged boolean")


def mar_mnar_test(df: DataFrame, target: str, missing_values: Values = None) -> list[tuple[str, float]]:
    """Deprecated: (variable, p_value) pairs after rows without the target are dropped."""
    rows = df.where(~nullity.miss(df, target, missing_values))
    return [(r.variable, r.p_value) for r in missingness_association_test(rows, target, missing_values).collect()]


def diagnose_missing(df: DataFrame, significance: float = 0.05, missing_values: Values = None, max_iter: int = 100, tol: float = 1e-5, ridge: float = 1e-6) -> dict:
    """MCAR evidence, columns over 40 % missing, the largest nullity correlation, and what to do about it."""
    clean = nullity.canonical(df, missing_values)
    high = [r.variable for r in missing_counts(clean).where("n_miss > 0.4 * n_rows").orderBy("ordinal").collect()]
    strongest = nullity_correlation(clean).where("var_a <> var_b").agg(F.max(F.abs("r"))).first()[0] if clean.columns else None
    result, error = None, None
    try:
        usable = [r.variable for r in missing_counts(clean).where("n_miss < n_rows").collect()]
        result = mcar_test(clean.select(*[nullity.column(c) for c in usable]), max_iter, tol, ridge).first().asDict()
    except (ConfigurationError, InsufficientDataError, RuntimeError, np.linalg.LinAlgError) as exc:
        error = str(exc)
    p = result and result["p_value"]
    evidence = "insufficient_data" if p is None else "MCAR_rejected" if p < significance else "MCAR_not_rejected"
    advice = {
        "insufficient_data": "The test could not decide; examine how missingness depends on observed columns.",
        "MCAR_rejected": "Missingness depends on data; prefer model-based or multiple imputation to deletion.",
        "MCAR_not_rejected": "The data do not contradict missingness completely at random; simple methods may do.",
    }[evidence]
    return {"evidence": evidence, "mcar": result, "mcar_test_error": error, "high_missing_columns": high, "max_nullity_corr": strongest if strongest is None or not math.isnan(strongest) else None, "recommendation": advice}
