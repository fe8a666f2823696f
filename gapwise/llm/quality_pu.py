"""A quality classifier learned from positive and unlabelled texts, by the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import load, staged, text_or_empty
from gapwise.llm.language_id import remainder
from gapwise.llm.words import _offsets, in_groups, mixed, word_hashes

#: Byte classes: every ASCII punctuation mark, then lower, upper, digit, space, line end, control, beyond ASCII.
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
LOWER, UPPER, DIGIT, SPACE, LINE, CONTROL, HIGH = range(len(PUNCTUATION), len(PUNCTUATION) + 7)
CLASSES = HIGH + 1
#: Coarse classes for neighbours: punctuation, then the seven above.
COARSE = 8
WORD_FEATURES = 8
FEATURES = CLASSES + COARSE * COARSE + WORD_FEATURES
GROUP_BYTES = 4 << 20


def _classes() -> np.ndarray:
    table = np.full(256, HIGH, dtype=np.int64)
    table[:32], table[127] = CONTROL, CONTROL
    table[[9, 32]], table[[10, 11, 12, 13]] = SPACE, LINE
    for first, last, kind in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
        table[ord(first) : ord(last) + 1] = kind
    table[PUNCTUATION] = range(len(PUNCTUATION))
    return table


CLASS_OF = _classes()
COARSE_OF = np.maximum(CLASS_OF - len(PUNCTUATION) + 1, 0)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per whole text (no nulls): shares of byte classes and of neighbouring coarse classes, repetition of
    neighbouring words, words, word pairs and lines, the commonest word's share, and the mean size and number of words."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    n, ends = len(texts), _offsets(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    of = np.repeat(np.arange(n), sizes)
    share = lambda counts, total: np.sqrt(counts / np.maximum(total, 1).reshape(-1, *[1] * (counts.ndim - 1)))
    single = np.bincount(of * CLASSES + CLASS_OF[raw], minlength=n * CLASSES).reshape(n, CLASSES)
    coarse, inside = COARSE_OF[raw], of[1:] == of[:-1]
    pairs = np.bincount((of[1:] * COARSE * COARSE + coarse[:-1] * COARSE + coarse[1:])[inside], minlength=n * COARSE * COARSE).reshape(n, COARSE * COARSE)

    hashes, words = word_hashes(texts)
    owner = np.repeat(np.arange(n), words)
    together = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][together & (hashes[1:] == hashes[:-1])], minlength=n)
    two = mixed(hashes[:-1].view(np.uint64) * np.uint64(3) + hashes[1:].view(np.uint64))[together]

    def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each text, and the size of its commonest."""
        order = np.lexsort((values, at))
        v, a = values[order], at[order]
        first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (a[1:] != a[:-1])]) if len(v) else np.zeros(0, dtype=np.int64)
        most = np.zeros(n, dtype=np.int64)
        np.maximum.at(most, a[first], np.diff(np.r_[first, len(v)]))
        return np.bincount(a[first], minlength=n), most

    kinds, most = distinct(hashes, owner)
    kinds2, _ = distinct(two, owner[1:][together])
    lines = [t.split("\n") for t in texts.to_pylist()]
    n_lines = np.array([len(x) for x in lines], dtype=np.int64)
    again = n_lines - np.array([len(set(x)) for x in lines], dtype=np.int64)
    per_word = [same, words - kinds, np.maximum(words - 1, 0) - kinds2, most]
    more = [share(x, words) for x in per_word] + [share(again, n_lines), np.log1p(words), np.log1p(sizes / np.maximum(words, 1)), np.log1p(words / n_lines)]
    return np.column_stack([share(single, sizes), share(pairs, sizes), *more]).astype(np.float32)


@dataclass
class Model:
    """Scores are sigmoid(weights . z) of z, the standardised features with their squares and a one. ``prior`` is the share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.mean, self.scale) @ self.weights


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, (z * z - 1) / 3, np.ones((len(z), 1))], axis=1)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def training_rows(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, tasks: int, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(positive, fold, x): about ``positives`` texts that labels trust and ``unlabelled`` of all texts, by a hash over all ids, each id once."""
    trusted = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("q")).where("q >= 1").select("__id")
    trusted = trusted.where(remainder("__id", 3) != 1)
    share = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "__id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = trusted.where(share("trusted") * max(1, trusted.count()) < positives).withColumn("__trusted", F.lit(True))
    open_ = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).where(F.col("__id").isNotNull() & (remainder("__id", 3) != 1))
    # The trusted ids are bounded by ``positives``, so they are broadcast and no other text moves.
    marked = open_.join(F.broadcast(chosen), "__id", "left").withColumn("__open", share("open") * max(1, open_.count()) < unlabelled)
    texts = marked.where(F.col("__trusted") | F.col("__open"))
    texts = texts.select("__id", "text", F.coalesce("__trusted", F.lit(False)).alias("trusted"), "__open").repartition(tasks)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, GROUP_BYTES):
            x = features(group.column("text"))
            yield from group.drop_columns(["text"]).append_column("x", pa.array([r.tobytes() for r in x], pa.binary())).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.mapInArrow(measured, f"__id {kind}, trusted boolean, __open boolean, x binary")
    once = found.groupBy("__id").agg(F.min(F.struct("trusted", "__open", "x")).alias("r"))
    sides = F.filter(F.array(F.when(F.col("r.trusted"), F.lit(True)), F.when(F.col("r.__open"), F.lit(False))), lambda s: s.isNotNull())
    return once.select(F.explode(sides).alias("positive"), (F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(2))).cast("int").alias("fold"), "r.x").repartition(tasks)


def _summed(rows: DataFrame, partial, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """The sums of the vectors of ``partial(positive, x)`` over all rows; each of the few tasks sends vectors of fixed ``sizes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(s) for s in sizes]
        for batch in batches:
            for low in range(0, len(batch), 2000):
                some = batch.iloc[low : low + 2000]
                x = np.frombuffer(b"".join(some["x"]), dtype=np.float32).reshape(len(some), -1).astype(np.float64)
                for t, part in zip(total, partial(some["positive"].to_numpy(dtype=bool), x), strict=True):
                    t += np.ravel(part)
        yield pd.DataFrame({"part": [np.concatenate(total).tobytes()]})

    got = sum((np.frombuffer(r.part) for r in rows.mapInPandas(run, "part binary").collect()), np.zeros(sum(sizes)))
    return np.split(got, np.cumsum(sizes)[:-1])


def minimise(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, counts: tuple[float, float], prior: float | None, *, reg: float, rounds: int) -> np.ndarray:
    """Weights of least risk by damped Newton steps, each one job over the rows.

    With a ``prior``, the non-negative risk: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)) of the logistic loss. While the
    second term is negative the step goes up that term instead, so that the fit doesn't sink below what negatives can
    lose, and weights are kept from where it isn't. Without one, the risk of telling positives from unlabelled rows, both sides weighted alike.
    """
    d = 2 * FEATURES + 1
    n_p, n_u = (max(1.0, c) for c in counts)
    up = 1.0 if prior is None else prior
    ridge = np.full(d, reg)
    ridge[-1] = 1e-9

    def state(w: np.ndarray):
        def partial(positive: np.ndarray, x: np.ndarray):
            z = expanded(x, mean, scale)
            g = z @ w
            s, soft = sigmoid(g), np.logaddexp(0, g)
            p, u = z[positive], z[~positive]
            sp, su = s[positive], s[~positive]
            bend = lambda m, q: (m * (q * (1 - q))[:, None]).T @ m
            return (
                np.array([np.sum(soft[positive] - g[positive]), np.sum(soft[positive]), np.sum(soft[~positive])]),
                p.sum(axis=0), p.T @ sp, u.T @ su, bend(u, su), bend(p, sp) if prior is None else np.zeros(0),
            )

        risks, p_x, p_s, u_s, u_h, p_h = _summed(rows, partial, (3, d, d, d, d * d, d * d if prior is None else 0))
        plus, minus, open_ = risks[0] / n_p, risks[1] / n_p, risks[2] / n_u
        if prior is None:
            slack, gradient, bent = open_, (p_s - p_x) / n_p + u_s / n_u, u_h / n_u + p_h / n_p
        else:
            slack, gradient, bent = open_ - up * minus, -up * p_x / n_p + u_s / n_u, u_h / n_u
            if slack < 0:
                gradient = -(u_s / n_u - up * p_s / n_p)
        value = up * plus + max(0.0, slack) + 0.5 * float(w @ (ridge * w))
        step = np.linalg.solve(bent.reshape(d, d) + np.diag(ridge), gradient + (ridge * w if slack >= 0 else 0))
        return value, slack, step

    w = np.zeros(d)
    value, slack, step = state(w)
    best, rate = (value, w), 1.0
    for _ in range(rounds):
        tried = w - rate * step
        found = state(tried)
        if slack >= 0 and found[0] > value + 1e-9 and rate > 1 / 64:
            rate /= 2
            continue
        gone = value - found[0]
        w, (value, slack, step), rate = tried, found, min(1.0, 2 * rate) if slack >= 0 else rate / 2
        if slack >= 0 and value < best[0]:
            best = (value, w)
        if slack >= 0 and abs(gone) < 1e-6 * max(1.0, abs(value)):
            break
    return best[1]


def estimated_prior(rows: DataFrame, model: Model, counts: tuple[float, float], *, bins: int = 4096, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled rows, at the best cut of a score that tells the two kinds apart.

    Above a cut lie parts U and P of the unlabelled and of the positive rows; wherever no negative lies above, U / P is the
    share. The cut is that of the least ratio with its sampling error added, from histograms of the scores.
    """

    def partial(positive: np.ndarray, x: np.ndarray):
        at = np.minimum((sigmoid(model.margins(x)) * bins).astype(np.int64), bins - 1)
        return np.bincount(at[positive], minlength=bins), np.bincount(at[~positive], minlength=bins)

    p, u = _summed(rows, partial, (bins, bins))
    n_p, n_u = max(1.0, p.sum()), max(1.0, u.sum())
    above_p, above_u = np.cumsum(p[::-1]) / n_p, np.cumsum(u[::-1]) / n_u
    error = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    usable = above_p > 0
    if not usable.any():
        return 0.5
    ratio = above_u[usable] / above_p[usable]
    best = int(np.argmin(ratio + (1 + slack) / above_p[usable] * error))
    return float(np.clip(ratio[best], 0.01, 0.99))


def fit(rows: DataFrame, *, reg: float = 2e-3, rounds: int = 30, prior: float | None = None) -> Model | None:
    """Learn from (positive, fold, x); None without rows of both kinds. Without ``prior``, it is estimated on the fold that its score didn't see."""
    n_p, n_u, mean, square = _summed(rows, lambda p, x: (np.array([p.sum()]), np.array([(~p).sum()]), x[~p].sum(axis=0), (x[~p] ** 2).sum(axis=0)), (1, 1, FEATURES, FEATURES))
    if not n_p[0] or not n_u[0]:
        return None
    mean = mean / n_u[0]
    scale = np.sqrt(np.maximum(square / n_u[0] - mean**2, 0)) + 1e-3
    # Few rows say little about many features: the penalty grows as the rows get fewer.
    reg = reg + FEATURES / (n_p[0] + n_u[0]) / 10
    if prior is None:
        seen, unseen = rows.where("fold = 0"), rows.where("fold = 1")
        sides = {r.positive: r["count"] for r in seen.groupBy("positive").count().collect()}
        told = minimise(seen, mean, scale, (sides.get(True, 0), sides.get(False, 0)), None, reg=reg, rounds=rounds)
        prior = estimated_prior(unseen, Model(mean, scale, told, 0.5), (n_p[0], n_u[0]))
    return Model(mean, scale, minimise(rows, mean, scale, (n_p[0], n_u[0]), prior, reg=reg, rounds=rounds), prior)


def classify(docs: DataFrame, labels: DataFrame, *, positives: int = 20_000, unlabelled: int = 40_000, prior: float | None = None, tasks: int = 32, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns in ``tasks`` tasks from rows whose remainder modulo 3 isn't 1: about ``positives`` texts with label 1 and ``unlabelled`` texts whatever
    their label, chosen by a hash over all ids; labels of 0 are never read as such. Every whole text is scored, from its
    bytes and words alone. Defined results: a null text counts as empty and is scored like one; without a positive or an
    unlabelled row every score is 0.5; an id labelled twice is trusted if all its labels are 1; labels of unknown or null
    ids are ignored; rows that repeat an id are learned from once and scored as often as they occur; an empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    rows = staged(training_rows(docs, labels, positives, unlabelled, tasks, id_col=id_col, text_col=text_col, label_col=label_col), "pu-train")
    model = fit(rows, prior=prior)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, GROUP_BYTES):
            score = np.full(len(group), 0.5) if model is None else sigmoid(model.margins(features(group.column("text"))))
            done = group.drop_columns(["text"]).append_column("score", pa.array(score, pa.float64()))
            yield from done.append_column("predicted", pa.array((score >= 0.5).astype(np.int32), pa.int32())).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    asked = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, 3) == 1).alias("held_out"), text_or_empty(text_col).alias("text"))
    return asked.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op13_quality_pu(spark, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
