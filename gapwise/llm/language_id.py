"""Language identification: the family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import load, staged, text_or_empty

#: Families by language code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "mr", "ur", "gu", "pa", "ne"),
    "sinitic": ("zh", "yue", "wuu"),
}
DIMENSIONS = 1 << 12
UNDETERMINED = "und"
MAX_LANGUAGES = 10_000


def grams(text: str) -> np.ndarray | None:
    """Square-rooted, normalised counts of hashed character 1- to 3-grams of the whole text; None without a letter."""
    lowered = text.lower()
    if not any(map(str.isalpha, lowered)):
        return None
    code = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Whatever isn't a letter separates words and looks alike.
    alphabet, inverse = np.unique(code, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in alphabet.tolist()])
    code = np.where(letter[inverse], code, 32).astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    one = (code + np.uint64(1)) * mix
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * mix + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * mix + one[2:]
    slots = [(g * mix) >> np.uint64(64 - 12) for g in (one, two, three)]
    counts = np.sqrt(np.bincount(np.concatenate(slots).astype(np.int64), minlength=DIMENSIONS).astype(np.float32))
    return counts / np.linalg.norm(counts)


def sliced(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Smaller batches, so that the feature matrix of one stays small."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows].copy()


def training_rows(docs: DataFrame, per_language: int, *, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang and features of about ``per_language`` texts of each language, chosen by the hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    if counts.count() <= MAX_LANGUAGES:  # a row per language: no text has to move to meet it
        counts = F.broadcast(counts)
    share = F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(counts, known[lang_col] == counts["__lang"]).where(share * F.col("__n") < per_language)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            rows = [(lang, g) for lang, g in zip(batch["lang"], map(grams, batch["text"]), strict=True) if g is not None]
            yield pd.DataFrame({"lang": [r[0] for r in rows], "x": [r[1].tobytes() for r in rows]})

    # Few texts are chosen; spread them, so that neither the scan nor the training depends on where they lay.
    texts = chosen.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).repartition(32)
    return texts.mapInPandas(featured, "lang string, x binary")


class Hierarchy:
    """Pairwise linear SVMs over families, and over the languages of each family."""

    def __init__(self, families: dict[str, list[str]]):
        self.families = families
        self.pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = {}

    @staticmethod
    def _vote(x: np.ndarray, labels: list[str], pairs: dict) -> tuple[list[str], np.ndarray]:
        """The label with the most pairwise wins for each row, by margin on ties; and its weakest win as a probability."""
        if len(labels) == 1:
            return [labels[0]] * len(x), np.ones(len(x))
        wins, margin = np.zeros((len(x), len(labels))), np.full((len(x), len(labels)), np.inf)
        for i, j in combinations(range(len(labels)), 2):
            weight, bias = pairs[labels[i], labels[j]]
            d = x @ weight + bias
            wins[:, i] += d >= 0
            wins[:, j] += d < 0
            margin[:, i] = np.minimum(margin[:, i], d)
            margin[:, j] = np.minimum(margin[:, j], -d)
        best = np.argmax(wins + np.tanh(margin) / 4, axis=1)
        return [labels[b] for b in best], 1 / (1 + np.exp(-4 * margin[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families, score = self._vote(x, sorted(self.families), self.pairs)
        langs, families = [""] * len(x), np.array(families, dtype=object)
        for family in set(families):
            rows = np.flatnonzero(families == family)
            found, p = self._vote(x[rows], self.families[family], self.pairs)
            score[rows] *= p
            for r, lang in zip(rows, found, strict=True):
                langs[r] = lang
        return langs, score


def _summed(rows: DataFrame, partial, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``partial(langs, matrix)`` over all rows: each task sends one array of ``shape``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in sliced(batches):
            total += partial(batch["lang"].to_numpy(), np.frombuffer(b"".join(batch["x"]), dtype=np.float32).reshape(len(batch), -1))
        yield pd.DataFrame({"part": [total.tobytes()]})

    return sum((np.frombuffer(r.part).reshape(shape) for r in rows.mapInPandas(run, "part binary").collect()), np.zeros(shape))


def fit(rows: DataFrame, families: Mapping[str, tuple[str, ...]] = FAMILIES, *, rounds: int = 60, reg: float = 1e-4) -> Hierarchy | None:
    """Train the SVMs of all pairs together on ``rows`` (lang, x); None without any row.

    Squared hinge loss, both sides of a pair weighted alike, on centred features; accelerated gradient steps of a
    fixed size, each one job that sums the gradients of all pairs over the rows.
    """
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return None
    family_of = {lang: next((f for f, members in families.items() if lang in members), f"other:{lang}") for lang in langs}
    model = Hierarchy({f: [x for x in langs if family_of[x] == f] for f in sorted(set(family_of.values()))})
    pairs = {(a, b): (model.families[a], model.families[b]) for a, b in combinations(sorted(model.families), 2)}
    pairs |= {(a, b): ([a], [b]) for members in model.families.values() for a, b in combinations(members, 2)}
    if not pairs:
        return model
    side = {lang: np.array([(lang in a) * 1.0 - (lang in b) * 1.0 for a, b in pairs.values()]) for lang in langs}
    share = {lang: np.array([0.5 / sum(counts[x] for x in (a if lang in a else b)) if lang in a or lang in b else 0.0 for a, b in pairs.values()]) for lang in langs}
    mean = _summed(rows, lambda _, x: x.sum(axis=0, dtype=np.float64), (DIMENSIONS,)) / sum(counts.values())
    bias = 0.3
    weights = np.zeros((len(pairs), DIMENSIONS + 1))
    step, ahead, speed = 1 / (2 * (max(0.0, 1 - float(mean @ mean)) + bias**2) + reg), weights, 1.0

    for _ in range(rounds):

        def gradient(lang: np.ndarray, x: np.ndarray, at: np.ndarray = ahead) -> np.ndarray:
            y, w = np.stack([side[v] for v in lang]), np.stack([share[v] for v in lang])
            z = np.concatenate([x - mean.astype(np.float32), np.full((len(x), 1), bias, dtype=np.float32)], axis=1)
            short = np.maximum(0.0, 1 - y * (z @ at.T.astype(np.float32)))
            return (-2 * w * y * short).T @ z

        moved = ahead - step * (_summed(rows, gradient, weights.shape) + reg * ahead)
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead, weights, speed = moved + (speed - 1) / faster * (moved - weights), moved, faster
    for pair, w in zip(pairs, weights, strict=True):
        model.pairs[pair] = (w[:-1].astype(np.float32), float(bias * w[-1] - w[:-1] @ mean))
    return model


def remainder(id_col: str, divisor: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def identify(docs: DataFrame, *, per_language: int = 1500, families: Mapping[str, tuple[str, ...]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from the text of labelled rows whose remainder modulo 3 isn't 1: of each language about
    ``per_language`` texts, chosen by a hash over all of them. Predicts from whole texts, nothing else.
    Defined results: ``und`` and score 0 for a null text or one without a letter, and for every text if no
    row can be learned from; a null lang isn't learned from; repeated rows are predicted alike; an empty
    table gives an empty result; other columns are ignored.
    """
    learn_from = docs.select(id_col, text_col, lang_col).where(remainder(id_col, 3) != 1)
    rows = staged(training_rows(learn_from, per_language, id_col=id_col, text_col=text_col, lang_col=lang_col), "lang-train")
    model = fit(rows, families)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            vectors = [grams(t) for t in batch.pop("text")]
            langs, scores = [UNDETERMINED] * len(vectors), np.zeros(len(vectors))
            usable = [i for i, v in enumerate(vectors) if v is not None]
            if usable and model is not None:
                found, p = model.predict(np.stack([vectors[i] for i in usable]))
                scores[usable] = p
                for i, lang in zip(usable, found, strict=True):
                    langs[i] = lang
            yield batch.assign(lang_pred=langs, score=scores)

    asked = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, 3) == 1).alias("held_out"), text_or_empty(text_col).alias("text"))
    id_type = asked.schema["doc_id"].dataType.simpleString()
    out = asked.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text").mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op1_language_hierarchy(spark, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
