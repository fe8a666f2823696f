"""Collocation mining: the perfect hash, sums in a tree, and the whole result against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gapwise.llm import collocations, sums
from gapwise.llm.perfect_hash import build

SCHEMA = "doc_id bigint, text string, lang string, source string, word string, f int, n bigint, ids string, `rank` int"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 30_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    table = build(keys)
    slots = table.find(keys)
    assert sorted(slots) == list(range(len(keys))) and (table.keys[slots] == keys).all()
    others = np.setdiff1d(keys + 1, keys)
    assert (table.find(others) == -1).all() and len(table.find(keys[:0])) == 0


@pytest.mark.parametrize(("tasks", "fan", "cap"), [(1, 2, None), (7, 2, None), (9, 3, 12), (5, 32, 250)])
def test_tree_sum(spark, monkeypatch, tasks, fan, cap):
    monkeypatch.setattr(sums, "SLICE_BYTES", 64)
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 5, 200).astype(np.int64) for _ in range(tasks)]
    for a in arrays:
        a[40:80] = 0
    rows = [tuple(map(lambda c: c[0].as_py(), b.columns)) for t, a in enumerate(arrays) for b in sums.sliced(a, t)]
    parts = spark.createDataFrame(rows, sums.PARTS)
    want = sum(arrays) if cap is None else np.minimum(sum(arrays), cap)
    assert (sums.tree_sum(parts, 200, np.int64, tasks, cap=cap, fan=fan) == want).all()
    bits = sums.tree_sum(parts, 200, np.int64, tasks, cap=cap, fan=fan, finish=lambda a: np.packbits(a >= 9))
    assert (bits == np.packbits(want >= 9)).all()


def plainly(rows, min_count, max_words, top, percent=100):
    f, total = defaultdict(Counter), Counter()
    for row in rows:
        lang, text = row[2] or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= min_count}
        inside = defaultdict(int)
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in often.items():
            if len(p) > 1 and not (inside[p] and 100 * inside[p] >= percent * a):
                score, k = min((1000 * a * total[lang] // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["the", "The", "OF", "and", "éa", "ß", "日本", "a-b", "x\x01", "longer-than-eight", "to", "be"]
    rows = []
    for i in range(260):
        text = "".join(rng.choice(words) + rng.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", ": ")) for _ in range(rng.randrange(40)))
        if i % 3 == 0:
            text += " one two three four five six seven! One two three four"
        rows.append((i, text, rng.choice(("en", "de", None, "und")), "s", "w", 1, 2, "i", 3))
    odd = [None, "", " \t", "...", "word", "!the", "same text same text same text", "same text same text same text", ("the of " * 30_000).strip()]
    return rows + [(1000 + k, t, "en", "s", "w", 1, 2, "i", 3) for k, t in enumerate(odd)] + [(None, "the of and to be", "en", "s", "w", 1, 2, "i", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def mined(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize("small", ["", "windows", "rounds", "shuffle", "shuffle later"])
def test_against_a_plain_count(docs, monkeypatch, small):
    if small == "windows":
        monkeypatch.setattr(collocations, "WINDOW", 7)
        monkeypatch.setattr(collocations, "ROW", 5)
        monkeypatch.setattr(collocations, "GROUP_BYTES", 300)
    if small == "rounds":
        monkeypatch.setattr(collocations, "LEAST_BINS", 1024)
        monkeypatch.setattr(collocations, "MAX_BINS", 8192)
    if small.startswith("shuffle"):
        monkeypatch.setattr(collocations, "MAX_KEYS", 3 if small == "shuffle" else 40)
    options = {"min_count": 12, "top": 40}
    assert mined(docs, **options) == plainly(corpus(), 12, 5, 40)


def test_covered_share_lengths_and_top(docs):
    assert mined(docs, min_count=15, max_words=3, covered_percent=60, top=7) == plainly(corpus(), 15, 3, 7, 60)
    assert mined(docs, min_count=15, max_words=2, top=3) == plainly(corpus(), 15, 2, 3)


def test_bins_only_sift(docs, monkeypatch):
    """Full bins let every phrase of frequent words through; the stored keys keep the counts apart."""
    monkeypatch.setattr(collocations, "_bins", lambda keys, row, size: np.zeros(len(keys), dtype=np.int64))
    assert mined(docs, min_count=12, top=40) == plainly(corpus(), 12, 5, 40)


def test_numbers_beyond_64_bits(spark):
    levels = [collocations.Level(build(np.array([(0 << 32) | 1])), np.array([3 * 10**12]))]
    known = collocations.Vocabulary(["en"], {"en": pa.array(["a", "b"], pa.large_string())}, {"en": 0}, np.array([5 * 10**12, 4 * 10**12]), {"en": 9 * 10**13})
    row = collocations._scored(spark.range(1), known, levels, 100, 1000).first()
    assert row.score == 1000 * 3 * 10**12 * 9 * 10**13 // (20 * 10**24) and (row.l, row.r) == (5 * 10**12, 4 * 10**12)


def test_nothing_frequent(spark, docs):
    assert mined(docs, min_count=10**6) == [] and mined(docs.limit(0)) == []
    one = spark.createDataFrame([(1, "a b", None, "s", "w", 1, 2, "i", 3)], SCHEMA)
    assert mined(one, min_count=1) == [("und", 1, "a b", 1, 1, 1, 2, 2000)]
    with pytest.raises(ValueError, match="max_words"):
        collocations.collocations(docs, max_words=1)
