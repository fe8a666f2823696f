"""The positive-unlabelled classifier: features, risk, prior and held-out accuracy against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapwise.llm import quality_pu

SCHEMA = "doc_id bigint, text string, lang string, source string, x int, trusted boolean, score double, text_ string"


def prose(rng, n):
    return " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "ü")) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def spoilt(rng, n):
    kind, text = rng.randrange(3), prose(rng, n)
    return text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", "*** ") if kind == 1 else " ".join(w for w in text.split()[: n // 5] for _ in range(5))


def corpus(n=600, seed=1, bad=0.3):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() >= bad
        rows.append((i, (prose if good else spoilt)(rng, rng.randrange(30, 120)), None, None, 1, True, 0.5, "t"))
        if i % 2:
            labels.append((i, int(good)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id bigint, quality int").cache()


def plainly(text):
    """The features of one text, one by one."""
    raw, shares = text.encode(), []
    root = lambda a, b: (a / max(b, 1)) ** 0.5
    tests = [lambda c, p=p: c == p for p in range(33, 127) if not chr(p).isalnum()] + [
        lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in (9, 32), lambda c: c in (10, 11, 12, 13),
        lambda c: (c < 32 and c not in (9, 10, 11, 12, 13)) or c == 127, lambda c: c > 127,
    ]
    shares += [root(sum(map(t, raw)), len(raw)) for t in tests]
    coarse = [next(k for k, t in enumerate([any_of(tests[:32]), *tests[32:]]) if t(c)) for c in raw]
    pairs = Counter(zip(coarse, coarse[1:]))
    shares += [root(pairs[a, b], len(raw)) for a in range(8) for b in range(8)]
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    lines, n = text.split("\n"), len(words)
    two = list(zip(words, words[1:]))
    shares += [root(v, n) for v in (sum(a == b for a, b in two), n - len(set(words)), len(two) - len(set(two)), max(Counter(words).values(), default=0))]
    return [*shares, root(len(lines) - len(set(lines)), len(lines)), np.log1p(n), np.log1p(len(raw) / max(n, 1)), np.log1p(n / len(lines))]


def any_of(tests):
    return lambda c: any(t(c) for t in tests)


def test_features():
    rng = random.Random(5)
    texts = ["", " ", "a", "a a", "A!! B!!\nA!! B!!\n", "é\x00\x7f\t9", "x" * 5000, "\n\n", "long " * 3000] + ["".join(rng.choice("aB1 !#\né") for _ in range(rng.randrange(60))) for _ in range(60)]
    assert np.allclose(quality_pu.features(pa.array(texts)), np.array([plainly(t) for t in texts]), atol=1e-5)
    assert np.array_equal(quality_pu.features(pa.array(texts).slice(3, 5)), quality_pu.features(pa.array(texts[3:8])))
    assert quality_pu.features(pa.array([], pa.string())).shape == (0, quality_pu.FEATURES)


def rows_of(spark, positive, x):
    data = [(bool(p), k % 2, v.astype(np.float32).tobytes()) for k, (p, v) in enumerate(zip(positive, x, strict=True))]
    return spark.createDataFrame(data, "positive boolean, fold int, x binary").repartition(3)


def drawn(seed, n_p, n_u, prior, shift):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n_p + n_u, quality_pu.FEATURES))
    good = np.r_[np.ones(n_p, dtype=bool), rng.random(n_u) < prior]
    x[:, :3] += np.where(good[:, None], shift, -shift)
    return np.r_[np.ones(n_p, dtype=bool), np.zeros(n_u, dtype=bool)], x.astype(np.float32).astype(float)


def test_risk_is_least(spark):
    positive, x = drawn(0, 1500, 2500, 0.6, 0.4)
    mean, scale, prior, reg = x.mean(axis=0), x.std(axis=0), 0.6, 0.1
    w = quality_pu.minimise(rows_of(spark, positive, x), mean, scale, (1500, 2500), prior, reg=reg, rounds=40)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.concatenate([z, (z * z - 1) / 3, np.ones((len(z), 1))], axis=1)
    ridge = np.r_[np.full(z.shape[1] - 1, reg), 1e-9]

    def risk(v):
        g = z @ v
        negative = np.logaddexp(0, g[~positive]).mean() - prior * np.logaddexp(0, g[positive]).mean()
        return prior * np.logaddexp(0, -g[positive]).mean() + max(0, negative) + 0.5 * v @ (ridge * v), negative

    at, slack = risk(w)
    assert slack > 0
    rng = np.random.default_rng(1)
    assert all(risk(w + rng.normal(size=len(w)) * size)[0] >= at - 1e-7 for size in (1e-4, 1e-3, 1e-2) for _ in range(30))


def test_fit_stays_above_nothing(spark):
    """With a prior that is too high, the plain unbiased risk sinks below zero; the fit must stay finite and keep the better weights."""
    positive, x = drawn(2, 60, 60, 0.3, 1.0)
    w = quality_pu.minimise(rows_of(spark, positive, x), x.mean(axis=0), x.std(axis=0), (60, 60), 0.95, reg=1e-4, rounds=25)
    g = quality_pu.expanded(x, x.mean(axis=0), x.std(axis=0)) @ w
    assert np.isfinite(w).all() and np.logaddexp(0, g[~positive]).mean() >= 0.95 * np.logaddexp(0, g[positive]).mean()


@pytest.mark.parametrize("prior", [0.3, 0.8])
def test_prior(spark, prior):
    positive, x = drawn(3, 3000, 5000, prior, 1.5)
    model = quality_pu.fit(rows_of(spark, positive, x), reg=1e-3)
    assert abs(model.prior - prior) < 0.06


def test_held_out_labels(tables):
    docs, labels = tables
    truth = dict(map(tuple, labels.collect()))
    found = quality_pu.classify(docs, labels, tasks=4).collect()
    assert sorted(r.doc_id for r in found) == list(range(600))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    good, bad = ([r.score for r in held if truth[r.doc_id] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_zeros_and_held_out_labels_teach_nothing(tables):
    docs, labels = tables
    whole = {r.doc_id: r.score for r in quality_pu.classify(docs, labels, tasks=4).collect()}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    for fewer in (labels.where("quality = 1"), labels.where(~held), labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))):
        got = {r.doc_id: r.score for r in quality_pu.classify(docs, fewer, tasks=4).collect()}
        assert max(abs(got[i] - whole[i]) for i in whole) < 1e-6


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, "no id", None, None, 1, True, 0.5, "t"), (7, None, None, None, 1, True, 0.5, "t"), (1000, "", None, None, 1, True, 0.5, "t"), (1001, "word " * 50_000, None, None, 1, True, 0.5, "t"), (3, "again", None, None, 1, True, 0.5, "t")], SCHEMA)
    some = labels.unionAll(spark.createDataFrame([(None, 1), (5000, 1), (1, None), (3, 0)], "doc_id bigint, quality int"))
    found = quality_pu.classify(docs.unionAll(odd), some, tasks=4).collect()
    assert len(found) == 605 and all(0 <= r.score <= 1 for r in found)
    empty = [r.score for r in found if r.doc_id == 1000] + [min(r.score for r in found if r.doc_id == 7)]
    assert len(set(r.score for r in found if r.doc_id in (1000,))) == 1 and len(empty) == 2
    assert quality_pu.classify(docs.limit(0), labels, tasks=4).count() == 0
    assert {r.score for r in quality_pu.classify(docs, labels.limit(0), tasks=4).collect()} == {0.5}
