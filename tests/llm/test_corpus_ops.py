"""Language ID, sharding, mixing, LM scoring, packing, Jaccard join, pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.llm import components, language_id, lm_scoring, mixing, ngram_join, packing, sharding
from gapwise.llm.common import look_up
from gapwise.llm.components import connected, stars
from gapwise.llm.ngram_trie import EliasFano, elias_fano, quantise, restore
from gapwise.llm.words import in_groups, word_hashes
from gapwise.llm.signature_tree import Groups, forest, similar

SCHEMA = "doc_id bigint, text string, lang string, source string, rate double, row string, `place` int, label int"
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein und ung ver ge lich keit ü ß".split(), "fr": "eau ou ai en ment é è que oi re".split(), "es": "ción ado os ar ñ que ll ente í ó".split()}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=160, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text_of(rng, lang, rng.randrange(5, 120)), lang, rng.choice("aaab") + str(i % 2), 1.0, "x", 3, 4))
    rows[3] = (3, None, "en", None, None, None, None, None)
    rows[5] = (5, "", None, "a0", None, None, None, None)
    rows[7] = (7, "12 34 !!", "en", "a0", None, None, None, None)
    rows[9] = (9, text_of(rng, "en", 30_000), "en", "b1", None, None, None, None)
    rows[11] = rows[10][:1] + rows[10][1:]
    rows[13] = (None, "the and er on", "en", "a1", None, None, None, None)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i, divisor):
    return zlib.crc32(("" if i is None else str(i)).encode()) % divisor


def test_language(docs, nothing):
    rows = language_id.identify(docs, per_language=200).collect()
    truth = {r[0]: r for r in corpus()}
    assert len(rows) == docs.count()
    right = total = 0
    for r in rows:
        assert r.held_out == (key(r.doc_id, 3) == 1) and 0 <= r.score <= 1
        t = truth[r.doc_id][1]
        if not any(map(str.isalpha, t or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out and truth[r.doc_id][2]:
            total, right = total + 1, right + (r.lang_pred == truth[r.doc_id][2])
    assert total > 30 and right / total > 0.95
    assert language_id.identify(nothing).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("lang_pred <> 'und'").count() == 0


def test_hierarchy_votes():
    model = language_id.Hierarchy({"f": ["a", "b", "c"], "g": ["d"]})
    unit = np.eye(4, dtype=np.float32)
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            if i < j:
                model.pairs[a, b] = (unit[i] - unit[j], 0.0)
    model.pairs["f", "g"] = (unit[:3].sum(0) - unit[3], 0.0)
    assert model.predict(unit)[0] == list("abcd")


def test_sharding(docs, nothing):
    rows = sharding.shard(docs, 5).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    assert {tuple(r) for r in rows} == {tuple(r) for r in sharding.shard(docs.repartition(3), 5).collect()}
    assert sharding.shard(nothing, 5).count() == 0


def test_sharding_balance_and_movement(spark):
    rng = random.Random(4)
    many = spark.createDataFrame([(i, "x" * rng.choice([3, 40, 200, 2000])) for i in range(6000)], "doc_id bigint, text string")
    a = {r.doc_id: r for r in sharding.shard(many, 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(many, 9).collect()}
    loads = Counter()
    for r in a.values():
        loads[r.shard] += r["size"]
    mean = sum(loads.values()) / 8
    assert max(loads.values()) < 1.01 * mean and min(loads.values()) > 0.97 * mean
    moved = sum(a[i].shard != b[i] for i in a) / len(a)
    assert moved < 0.4


def one_by_one(ring, rows, cap):
    """Bounded loads row by row: large classes first, each class first on its own shards, then clockwise. ``rows``: (at, size, ...)."""
    loads, where = [0] * ring.n_shards, {}
    segment = lambda r: (r[0] % (1 << 64)) >> (64 - ring.bits)

    def put(r, s):
        where[r], loads[s] = s, loads[s] + r[1]

    for kind in sorted({r[1].bit_length() for r in rows}, reverse=True):
        left = []
        for r in sorted((r for r in rows if r[1].bit_length() == kind), key=segment):
            own = ring.walk(segment(r))[0]
            put(r, own) if loads[own] + r[1] <= cap else left.append(r)
        for r in left:
            fit = [s for s in ring.walk(segment(r))[1:] if loads[s] + r[1] <= cap]
            put(r, fit[0] if fit else min(range(ring.n_shards), key=lambda s: (loads[s], s)))
    return where


def test_single_rows_are_placed_as_one_by_one(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(f"id{i}", "é" * rng.randrange(1, 900)) for i in range(90)], "doc_id string, text string")
    at = F.xxhash64(F.lit("ring-2"), "doc_id", F.crc32(F.col("text").cast("binary")))
    rows = [tuple(r) for r in docs.select(at, F.octet_length("text").cast("bigint") + 16, "doc_id").collect()]
    ring = sharding.Ring(6, 256, "ring-2")
    cap = -(-int(sum(r[1] for r in rows) * 1.0005) // 6)
    want = {r[2]: s for r, s in one_by_one(ring, rows, cap).items()}
    units = Counter((r[1].bit_length(), (r[0] % (1 << 64)) >> (64 - ring.bits)) for r in rows)
    assert max(units.values()) == 1
    assert {r.doc_id: r.shard for r in sharding.shard(docs, 6, vnodes=256).collect()} == want


def test_every_row_is_where_its_running_total_says(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i % 2500, "x" * rng.choice([3, 40, 41, 200, 2000])) for i in range(3000)], "doc_id bigint, text string").union(spark.createDataFrame([(None, None)] * 40, "doc_id bigint, text string"))
    at = F.xxhash64(F.lit("ring-2"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    rows = [tuple(r) for r in docs.select(at, F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint") + 16, F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "doc_id").collect()]
    ring = sharding.Ring(4, 8, "ring-2")
    members = defaultdict(list)
    for r in rows:
        members[r[1].bit_length(), (r[0] % (1 << 64)) >> (64 - ring.bits)].append(r)
    units = [(*k, sum(r[1] for r in v), len(v)) for k, v in members.items()]
    cap = -(-int(sum(r[1] for r in rows) * 1.0005) // 4)
    shares, want, loads = sharding.place_units(ring, units, cap), Counter(), Counter()
    for unit, part in members.items():
        assert shares[unit][-1][0] == sum(r[1] for r in part) and [h for h, _ in shares[unit]] == sorted({h for h, _ in shares[unit]})
        end = 0
        for r in sorted(part, key=lambda r: (*r[:3], str(r[3]))):
            end += r[1]
            s = next(s for high, s in shares[unit] if end <= high)
            want[r[3], r[1], r[2], s] += 1
            loads[s] += r[1]
    got = sharding.shard(docs, 4, vnodes=8).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == want
    assert max(loads.values()) <= cap + 20 and min(loads.values()) > 0.99 * cap
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_clashing_names(spark):
    names = ("at", "segment", "kind", "size", "shard", "slot", "end", "piece", "law", "place", "base", "p_kind")
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), *[F.lit(1).alias(n) for n in names])
    got = sharding.shard(docs, 3).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in sharding.shard(docs.select("doc_id", "text"), 3).collect()} and len(got) == 50


def inverted(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing(docs, nothing):
    import hashlib

    mass = Counter()
    for _, t, _, s, *_ in corpus():
        mass[s] += len(t or "") + 1
    rate = {s: sum(mass.values()) / len(mass) / m for s, m in mass.items()}
    got = Counter(r.row.doc_id for r in mixing.replicated(docs).collect())
    rare = [i for i, _, _, s, *_ in corpus() if rate[s] > 400]  # drawn in parts, see below
    for i in rare:
        assert abs(got.pop(i) - rate[None]) < 6 * math.sqrt(rate[None])
    want = Counter()
    for i, _, _, s, *_ in corpus():
        u = int(hashlib.md5(f"mix-1:{'null' if i is None else i}:0".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[i] += inverted(rate[s], u) if i not in rare else 0
    assert got == +want
    out = mixing.poisson_mix(docs, {"a0": 1.0})
    assert out.columns == docs.columns and {r.source for r in out.select("source").distinct().collect()} == {"a0"}
    assert mixing.poisson_mix(nothing).count() == 0


def test_large_rates_are_drawn_in_parts(spark):
    rows = [(i, "x" * 9, "s") for i in range(200)] + [(-1, "x" * 300_000, "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    n = mixing.replicated(df.where("source = 's'").unionByName(df.where("source = 'big'")), {"s": 3.0, "big": 1.0}, volume=2.0).where("row.source = 's'").count()
    expected = 0.75 * 2 * (200 * 10 + 300_001) / 10
    assert abs(n - expected) < 6 * math.sqrt(expected)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for values in (np.array([0]), np.array([7, 9]), np.unique(rng.integers(0, 9000, 4000)), np.unique(rng.integers(0, 1 << 62, 3000)), np.arange(5000)):
        e = EliasFano(**elias_fano(values.astype(np.int64)))
        assert (e.find(values) == np.arange(len(values))).all()
        probe = np.unique(np.concatenate([values - 1, values + 1, rng.integers(0, 1 << 62, 500)]))
        probe = probe[probe >= 0]
        assert ((e.find(probe) >= 0) == np.isin(probe, values)).all()
        low, high = np.zeros(len(probe), dtype=np.int64), np.full(len(probe), len(values) // 2)
        assert (e.access(np.arange(len(values))) == values).all()
        assert (e.successor(probe, low, high) == np.where(e.find(probe) < high, e.find(probe), -1)).all()
    many = np.sort(rng.integers(0, 900, 5000))
    assert (EliasFano(**elias_fano(many)).access(np.arange(5000)) == many).all()
    p = np.array([1.0, 0.3, 3e-5])
    assert np.abs(np.log10(restore(quantise(p)) / p)).max() <= 0.5 / 28 + 1e-9


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute_model(texts, discount=0.75):
    """The same interpolated trigram model with dictionaries; discounted probabilities and weights rounded alike."""
    grams = [Counter() for _ in range(3)]
    for t in texts:
        w = tokens(t)
        for k in range(3):
            grams[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    n, v = sum(grams[0].values()), len(grams[0])
    kinds = Counter(g[:-1] for level in grams[1:] for g in level)
    rounded = lambda x: float(restore(quantise(np.array([x])))[0])

    def score(text):
        w, total = tokens(text), 0.0
        for i in range(len(w)):
            p = (grams[0][(w[i],)] + 1) / (n + v + 1)
            for k in range(1, min(i, 2) + 1):
                context, g = tuple(w[i - k : i]), tuple(w[i - k : i + 1])
                if kinds[context]:
                    held = grams[k - 1][context]
                    p = p * rounded(discount * kinds[context] / held) + (rounded((grams[k][g] - discount) / held) if grams[k][g] else 0.0)
            total += math.log10(p)
        return total

    return n, v, grams[0], score


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["", " ", "a", "É Ab\tab\x0b\x00x\n", "x" * 500, "Q" * 70 + " " + "q" * 70, *("".join(rng.choice("aB \n\té\U0001f600") for _ in range(rng.randrange(40))) for _ in range(400))]
    for given, want in ((pa.array(texts), texts), (pa.array(["drop me", *texts]).slice(1, 90), texts[:90]), (pa.array([], pa.string()), []), (pa.array(["", ""]), ["", ""])):
        hashes, sizes = word_hashes(given)
        words = [tokens(t)[:-1] for t in want]
        assert sizes.tolist() == list(map(len, words))
        names = dict(zip((w for t in words for w in t), hashes.tolist(), strict=True))
        assert [names[w] for t in words for w in t] == hashes.tolist() and len(set(names.values())) == len(names)
        assert (hashes >= 0).all()
    batches = pa.Table.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "k"]).to_batches(max_chunksize=7)
    for limit in (1, 60, 10**9):
        tables = list(in_groups(iter(batches), limit))
        assert [k for t in tables for k in t.column("k").to_pylist()] == list(range(len(texts)))
        assert all(t.column("text").nbytes for t in tables) and (len(tables) == 1) == (limit == 10**9)


@pytest.mark.parametrize("chunk", [None, 40])
def test_lm(docs, nothing, monkeypatch, chunk):
    if chunk:  # so small that chunks end inside of pairs
        monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 3000)
    rows = {r.doc_id: r for r in lm_scoring.lm_score(docs).collect()}
    n, v, count, score = brute_model([t for i, t, *_ in corpus() if key(i, 7) != 2])
    for i, t, *_ in corpus():
        r, w = rows[i], tokens(t)
        assert r.held_out == (key(i, 7) == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[(x,)] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[(x,)] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(score(t), abs=1e-6 * len(w) + 1e-6), i
    assert lm_scoring.lm_score(nothing).count() == 0
    untrained = lm_scoring.lm_score(docs.where(F.col("doc_id").isin([i for i in range(200) if key(i, 7) == 2])))
    assert untrained.where("train_tokens <> 0 or n_known <> 0 or score <> 0").count() == 0


def test_lm_probabilities_add_up(spark):
    """Over all known words and one unknown, but for the rounding of codes."""
    docs = spark.createDataFrame([(i, f"a b {'c' if i % 3 else 'd'} a b {'e' * (i % 4 + 1)}") for i in range(60)], "doc_id bigint, text string")
    trie = lm_scoring.train(docs.select("text"))
    import pyarrow as pa

    vocabulary = ["a", "b", "c", "d", "e", "ee", "eee", "eeee", "unknown"]
    for context in ("a b", "b c", "x a", "q q", "b"):
        _, p, sizes = lm_scoring.scored(trie, pa.chunked_array([pa.array([f"{context} {w}" for w in vocabulary])]))
        ends = np.cumsum(sizes) - 1
        total = (10 ** p[ends - 1]).sum() + 10 ** lm_scoring.scored(trie, pa.chunked_array([pa.array([context])]))[1][-1]
        assert abs(total - 1) < 0.05, (context, total)


def test_lm_chunks_pass_by_files(spark, monkeypatch):
    """Counted chunks aren't rows of a frame, and files of words hold no more keys than chunks do."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(1, 20))) for i in range(200)], "doc_id bigint, text string")
    kept, whole = [], lm_scoring.staged
    monkeypatch.setattr(lm_scoring, "staged", lambda df, name: kept.append(df.schema) or whole(df, name))
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 40)
    trie = lm_scoring.train(docs.select("text"))
    assert len(trie.metas) > 10 and len(trie.level.metas) > 1
    assert not [f for schema in kept for f in schema if f.dataType.typeName() == "binary"]


def packed_well(rows, texts, encode, sequence=1024):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for s, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == sequence or s == max(by_seq)
    for i, t in texts:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


@pytest.mark.parametrize("weights", [None, {"a0": 2.0, "b1": 1.0}])
def test_packing(docs, nothing, weights):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, weights, window=4096).collect()
    packed_well(rows, [(i, t) for i, t, *_ in corpus()], lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    occurrences = Counter(i for i, *_ in corpus())
    assert all(total[r.doc_id] == r.doc_tokens * occurrences[r.doc_id] for r in rows)
    assert packing.pack(nothing).count() == 0


def test_final_pieces_hold_the_target(spark):
    rng = random.Random(6)
    rows = [(f"d{i}", text_of(rng, "en", rng.randrange(1, 300)), "big" if i % 5 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(6)
    pieces = packing.pack(docs, temper=0.5, window=2048).collect()
    given = Counter()
    for r in pieces:
        given[r.source] += r.length
    share = math.sqrt(given["small"]) / (math.sqrt(given["small"]) + math.sqrt(given["big"]))
    windows = int(given["small"] / share) // 2048
    assert windows > 5 and {r.doc_id for r in pieces} == {i for i, *_ in rows}
    for k in range(windows):
        got = sum(r.length for r in pieces if r.source == "small" and r.sequence_id // 2 <= k)
        assert abs(got - (k + 1) * 2048 * share) < 2
    assert not any(r.source == "small" for r in pieces if r.sequence_id // 2 > windows + 1)


def test_pieces_follow_from_the_rows_alone(spark, docs):
    rows = docs.unionAll(docs.where("doc_id < 20"))
    laid = [rows.coalesce(1), rows.repartition(3), rows.repartition(7, "lang"), rows.orderBy(F.desc("doc_id"))]
    found = [sorted(map(str, packing.pack(d, temper=0.5, window=2048).collect())) for d in laid]
    assert len(found[0]) > 160 and all(f == found[0] for f in found)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert sorted(map(str, packing.pack(rows, temper=0.5, window=2048).collect())) == found[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_packing_refuses_countless_sources(docs, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        packing.pack(docs)


def test_packing_knows_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext|", "é<|endoftext|>é 12", "", "the cat's  "]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rows = {r.doc_id: r for r in packing.pack(docs).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        assert (rows[i].doc_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), t


def test_windows_hold_the_target():
    totals, weights = [9_000_000, 4_000_000, 1_234_567, 0, 17], [0.5, 0.3, 0.2, 0.0, 0.0]
    spans = packing.plan_windows(totals, weights, 32768)
    assert sum(s.tokens for s in spans) == sum(totals) and len(spans) < 20
    first = spans[0]
    for i, share in enumerate((0.5, 0.3, 0.2)):
        for k in (1, 2, 17, 50):
            assert abs(first.given(i, k) - k * 32768 * share) < k * 2 + 2
    for i, total in enumerate(totals):
        assert sum(s.given(i, s.tokens // s.size) for s in spans) == total
        got = packing.pieces(spans, i, 0, total, 1024)
        assert sum(n for _, n, _ in got) == total
    places = sorted((at, n) for i, t in enumerate(totals) for _, n, at in packing.pieces(spans, i, 0, t, 1024))
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def shingles(text):
    w = tokens(text)[:-1]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    groups = Groups(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                groups.union(i, j)
    return [groups.find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_corpus(seed=6):
    rng = random.Random(seed)
    passage = text_of(rng, "en", 60)
    texts = [None, "", "one two", "one  TWO", "one two three"]
    for _ in range(12):
        base = text_of(rng, "fr", rng.randrange(40, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(99))
            texts.append(" ".join(copy))
    texts += [passage + " " + text_of(rng, "de", rng.randrange(5, 80)) for _ in range(30)]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:  # so that groups are cut into blocks and frequent tokens into parts
        for name, value in {"BLOCK_TOKENS": 400, "BLOCK_SETS": 3, "HOT_TOKEN": 2}.items():
            monkeypatch.setattr(ngram_join, name, value)
    texts = near_corpus()
    want, sizes = brute_components(texts)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, component_id string, node int").repartition(6)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want)


def test_jaccard_levels_are_files_of_a_bounded_size(spark, monkeypatch):
    """Frequent tokens and wanted rows are cut into files by their number, which changes no component."""
    levels, whole = [], ngram_join.write_level
    monkeypatch.setattr(ngram_join, "write_level", lambda *given: levels.append(whole(*given)) or levels[-1])
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 20)
    texts = near_corpus(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[0]
    assert len(levels) == 2 and all(len(level.metas) > 1 and max(m["n"] for m in level.metas) < 100 for level in levels)


def test_jaccard_edges(spark, nothing):
    assert ngram_join.jaccard_components(nothing).count() == 0
    only = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, "")], "doc_id bigint, text string")
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.jaccard_components(only).collect())
    assert rows == [(0, 0, 0), (0, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 40, rng.integers(5, 120)))
        for _ in range(rng.integers(1, 6)):
            keep = rng.random(len(base)) < 0.95
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 40, 2)])))
    for cut in (None, len(sets) // 2):
        one, two = (sets, None) if cut is None else (sets[:cut], sets[cut:])
        groups, brute = Groups(len(sets)), Groups(len(sets))
        for i, j in forest(one, two, 80):
            assert similar(sets[i], sets[j], 80)
            groups.union(i, j)
        for i in range(len(sets)):
            for j in range(i):
                if (cut is None or (j < cut <= i)) and similar(sets[i], sets[j], 80):
                    brute.union(i, j)
        assert [groups.find(i) for i in range(len(sets))] == [brute.find(i) for i in range(len(sets))]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    groups = Groups(200)
    for a, b in edges:
        groups.union(a, b)
    got = {r.vertex: r.label for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: groups.find(x) for e in edges for x in e}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_take_few_shuffles(spark, monkeypatch):
    """Five for a round, without one that only finds nothing to do (of plans: an aggregate is one, a join two); repeated edges and loops count for nothing."""
    plans, whole = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, name))
    star = [(7, k) for k in range(20)] * 2
    got = {r.vertex: r.label for r in connected(spark.createDataFrame(star, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(20)}
    assert sum(p.count("Aggregate [") + 2 * p.count("Join Inner") for p in plans) <= 9
    plans.clear()
    settled = connected(spark.createDataFrame([(0, k) for k in range(1, 20)], "a bigint, b bigint"))
    assert sorted((r.vertex, r.label) for r in settled.collect()) == [(k, 0) for k in range(20)]
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_stars_connect_what_edges_connect():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (30, 12), (400, 380), (50, 300)):
        a, b = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        want, got = Groups(7 * n), Groups(7 * n)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            want.union(i, j)
        child, root = stars(a, b)
        assert len(set(child.tolist())) == len(child) and not set(child.tolist()) & set(root.tolist())
        for i, j in zip(child.tolist(), root.tolist(), strict=True):
            got.union(i, j)
        assert [got.find(i) for i in range(7 * n)] == [want.find(i) for i in range(7 * n)]
    path = np.arange(5000)
    child, root = stars(path[1:], path[:-1])
    assert child.tolist() == path[1:].tolist() and not root.any()


def test_look_up_with_hot_keys(spark):
    rows = [(1, i) for i in range(60)] + [(k, k) for k in range(2, 20)] + [(None, 7), (99, 8)]
    df = spark.createDataFrame(rows, "key bigint, id bigint").repartition(4)
    table = spark.createDataFrame([(1, "a", 60)] + [(k, f"v{k}", 1) for k in range(2, 20)], "key bigint, value string, mass bigint")
    got = sorted((r.key or 0, r.id, r.value or "") for r in look_up(df, table, "key", "mass", parts=4).collect())
    value = {1: "a"} | {k: f"v{k}" for k in range(2, 20)}
    assert got == sorted((k or 0, i, value.get(k, "")) for k, i in rows)
    assert look_up(df.limit(0), table.limit(0), "key", "mass").count() == 0
