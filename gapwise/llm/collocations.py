"""Phrase collocation mining: frequent phrases counted by the slots of a minimal perfect hash, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import ascii_lower, load, staged, text_or_empty
from gapwise.llm.perfect_hash import PerfectHash, build
from gapwise.llm.sums import PARTS, sliced, tree_sum
from gapwise.llm.words import LOWER, U, _offsets, in_groups, mixed

UNKNOWN_LANG = "und"
#: Bytes between words, and those of them that also end a piece.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
GROUP_BYTES = 4 << 20
#: Ids in a row of the encoded texts, about, as Spark hands over 10,000 rows at once; ids looked at at once.
ROW, WINDOW = 512, 1 << 18
#: So many words, or phrases of one length, at most are broadcast (16 bytes each and a word's own bytes); beyond, all is counted by shuffles.
MAX_KEYS = 1 << 21
#: Bins of one round, one to four bytes each in either of two arrays; more are needed in several rounds.
MAX_BINS, LEAST_BINS = 1 << 26, 1 << 12


def _table(marks: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(marks)] = True
    return out


IS_BREAK, IS_BETWEEN = _table(BREAKS), _table(BREAKS + GAPS)


def cut_words(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """All words of ``texts`` (no nulls) with A-Z as a-z, the text of each, and whether it begins a piece."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = _offsets(texts)
    ends, low = ends - ends[0], ends[0]
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[low : low + ends[-1]]]
    n = len(raw)
    solid = ~IS_BETWEEN[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[ends] = True
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    start = np.flatnonzero(solid & (~before | edge[:-1])) if n else np.zeros(0, dtype=np.int64)
    stop = np.flatnonzero(solid & (~after | edge[1:])) + 1 if n else start
    marks = np.cumsum(IS_BREAK[raw], dtype=np.int32 if n < 1 << 31 else np.int64)
    of = np.searchsorted(ends, start, side="right") - 1
    first = np.ones(len(start), dtype=bool)
    first[1:] = (of[1:] != of[:-1]) | (marks[start[1:]] != marks[start[:-1]])
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw[solid]))
    return words, of, first


def _by_lang(group: pa.Table):
    """(langs, words, place of each occurrence's lang, of its word, whether it begins a piece) of a group."""
    words, of, first = cut_words(group.column("text"))
    kinds = words.dictionary_encode()
    langs = group.column("lang").combine_chunks().dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False)[of].astype(np.int64)
    return langs.dictionary, kinds.dictionary, lang, kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of ``docs`` (lang, text): each task adds up its own groups of texts before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, GROUP_BYTES):
            langs, words, lang, word, _ = _by_lang(group)
            pair, f = np.unique(lang * max(1, len(words)) + word, return_counts=True)
            columns = [langs.take(pa.array(pair // max(1, len(words)))), words.take(pa.array(pair % max(1, len(words)))).cast(pa.string()), pa.array(f, pa.int64())]
            yield from pa.table(dict(zip(("lang", "word", "f"), columns, strict=True))).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


@dataclass
class Vocabulary:
    """Frequent words by (lang, word); a word's id is its place. ``total`` has the words of each lang in all."""

    langs: list[str]
    words: dict[str, pa.Array]
    base: dict[str, int]
    counts: np.ndarray
    total: dict[str, int]

    @staticmethod
    def of(table: pa.Table, total: dict[str, int]) -> Vocabulary:
        table = table.sort_by([("lang", "ascending"), ("word", "ascending")])
        found = Vocabulary([], {}, {}, table.column("f").to_numpy().astype(np.int64), total)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        at = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            place = np.flatnonzero(at == k)
            found.langs.append(lang)
            found.base[lang] = int(place[0])
            found.words[lang] = table.column("word").combine_chunks().slice(int(place[0]), len(place)).cast(pa.large_string())
        return found


def encoded(docs: DataFrame, vocabulary) -> DataFrame:
    """(ids): the ids of frequent words in order as 32-bit numbers, rows cut where a phrase can't reach, by a -1."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for group in in_groups(batches, GROUP_BYTES):
            langs, words, lang, word, first = _by_lang(group)
            ids = np.full(len(word), -1, dtype=np.int64)
            for k, name in enumerate(langs.to_pylist()):
                if name not in known.base:
                    continue
                mine = np.flatnonzero(lang == k)
                used, inverse = np.unique(word[mine], return_inverse=True)
                at = pc.index_in(words.take(pa.array(used)), value_set=known.words[name]).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids[mine] = np.where(at < 0, -1, at + known.base[name])[inverse]
            if not len(ids):
                continue
            # A -1 before each piece; of several in a row one is enough.
            row = np.insert(ids, np.flatnonzero(first), -1)
            row = np.r_[row, -1]
            row = row[np.r_[row[0] >= 0, (row[1:] >= 0) | (row[:-1] >= 0)]].astype("<i4")
            gaps = np.flatnonzero(row < 0) + 1
            cuts = np.unique(gaps[np.minimum(np.searchsorted(gaps, np.arange(ROW, len(row) + ROW, ROW)), len(gaps) - 1)]) if len(gaps) else gaps
            lows = np.r_[0, cuts[:-1]] if len(cuts) else cuts
            parts = [row[a:b].tobytes() for a, b in zip(lows.tolist(), cuts.tolist(), strict=True) if b > a + 1]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["ids"])

    return docs.mapInArrow(encode, "ids binary")


@dataclass
class Level:
    """The frequent phrases of one length: key = slot of the phrase without its last word << 32 | slot without its first, both one length down."""

    hash: PerfectHash
    counts: np.ndarray


def adjacent(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbouring phrases are both frequent, and the key that the two make."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    return at, (slots[at] << 32) | slots[at + 1]


def phrases_at(ids: np.ndarray, hashes: list[PerfectHash]) -> np.ndarray:
    """The slot of the phrase of len(hashes) + 1 words that begins at each place, -1 where it isn't stored."""
    slots = ids
    for h in hashes:
        at, keys = adjacent(slots)
        slots = np.full(max(0, len(slots) - 1), -1, dtype=np.int64)
        slots[at] = h.find(keys)
    return slots


def windows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[np.ndarray]:
    """The ids of a batch in runs of WINDOW places, each with the words - 1 places after it; rows end in a -1."""
    for batch in batches:
        column = batch.column(0)
        ends = _offsets(column)
        ids = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].view("<i4")
        for low in range(0, len(ids), WINDOW):
            yield ids[low : low + WINDOW + words - 1].astype(np.int64)


def _bins(keys: np.ndarray, row: int, size: int) -> np.ndarray:
    return (mixed(keys.astype(U) ^ U((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[row])) & U(size - 1)).astype(np.int64)


def _in_round(keys: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    return keys if rounds == 1 else keys[mixed(keys.astype(U) ^ U(0x165667B19E3779F9)) % U(rounds) == turn]


class Miner:
    """Counts phrases length by length over the encoded texts. Phrases of one more word are asked for only where both shorter ones in them are frequent."""

    def __init__(self, ids: DataFrame, min_count: int):
        self.spark, self.min = ids.sparkSession, min_count
        self.tasks = max(1, self.spark.sparkContext.defaultParallelism)
        #: Each task sends whole arrays, so there are as many as run at once, however large the input.
        self.ids = ids.coalesce(self.tasks)
        self.levels: list[Level] = []

    def _scan(self, step, schema: str) -> DataFrame:
        words = len(self.levels) + 2
        hashes = self.spark.sparkContext.broadcast([level.hash for level in self.levels])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from step((adjacent(phrases_at(ids, hashes.value))[1] for ids in windows(batches, words)))

        return self.ids.mapInArrow(run, schema)

    def _crowded(self, size: int, turn: int, rounds: int) -> np.ndarray:
        """Two bit maps of ``size`` bins: those that min_count occurrences or more fell into. A frequent phrase is in such bins."""
        cap = self.min
        kind = np.uint8 if cap < 1 << 8 else np.uint16 if cap < 1 << 16 else np.uint32

        def step(keys_of: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(2 * size, dtype=kind)
            for keys in keys_of:
                keys, times = np.unique(_in_round(keys, turn, rounds), return_counts=True)
                for row in (0, 1):
                    at, inverse = np.unique(_bins(keys, row, size), return_inverse=True)
                    at += row * size
                    counts[at] = np.minimum(counts[at] + np.bincount(inverse, weights=times, minlength=len(at)).astype(np.int64), cap).astype(kind)
            yield from sliced(counts, TaskContext.get().partitionId())

        full = tree_sum(self._scan(step, PARTS), 2 * size, kind, self.tasks, cap=cap, finish=lambda a: np.packbits(a >= cap))
        return full.reshape(2, -1)

    def candidates(self, mass: int) -> np.ndarray | None:
        """The keys of all phrases that may be frequent; None if they are more than MAX_KEYS."""
        want = max(LEAST_BINS, 1 << int(np.ceil(np.log2(max(1, mass) / max(1, self.min / 3)))))
        rounds, size, found = -(-want // MAX_BINS), min(want, MAX_BINS), []
        for turn in range(rounds):
            crowded = self.spark.sparkContext.broadcast(self._crowded(size, turn, rounds))

            def step(keys_of: Iterator[np.ndarray], turn: int = turn, crowded=crowded) -> Iterator[pa.RecordBatch]:
                bits, seen = crowded.value, np.zeros(0, dtype=np.int64)
                for keys in keys_of:
                    keys = np.unique(_in_round(keys, turn, rounds))
                    for row in (0, 1):
                        at = _bins(keys, row, size)
                        keys = keys[(bits[row][at >> 3] >> (7 - (at & 7))) & 1 > 0]
                    new = np.setdiff1d(keys, seen, assume_unique=True)
                    if len(new):
                        seen = np.union1d(seen, new)
                        yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], names=["key"])

            some = staged(self._scan(step, "key bigint").distinct(), "phrase-candidates")
            if some.count() + sum(map(len, found)) > MAX_KEYS:
                return None
            found.append(some.toArrow().column("key").to_numpy().astype(np.int64))
        return np.concatenate(found)

    def count(self, keys: np.ndarray) -> int:
        """Count the phrases of ``keys`` and keep those that are frequent as the next level; the places that the level after it may look at."""
        table = build(keys)
        shared, size = self.spark.sparkContext.broadcast(table), len(table) + 1
        words, hashes = len(self.levels) + 2, self.spark.sparkContext.broadcast([level.hash for level in self.levels])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(size, dtype=np.int64)
            for ids in windows(batches, words):
                slots = phrases_at(ids, [*hashes.value, shared.value])
                hit = slots[slots >= 0]
                counts[:-1] += np.bincount(hit, minlength=size - 1)
                counts[-1] += len(adjacent(slots)[0])
            yield from sliced(counts, TaskContext.get().partitionId())

        counts = tree_sum(self.ids.mapInArrow(run, PARTS), size, np.int64, self.tasks)
        often = np.flatnonzero(counts[:-1] >= self.min)
        kept = build(table.keys[often])
        placed = np.zeros(len(kept), dtype=np.int64)
        placed[kept.find(table.keys[often])] = counts[often]
        self.levels.append(Level(kept, placed))
        return int(counts[-1])


def covered(levels: list[Level], percent: int) -> list[np.ndarray]:
    """Per level, whether a phrase lies in a longer one that occurs (percent / 100) times as often. As counts only fall with length, one word more tells."""
    out = [np.zeros(len(level.counts), dtype=bool) for level in levels]
    for k in range(1, len(levels)):
        for part in (levels[k].hash.keys >> 32, levels[k].hash.keys & 0xFFFFFFFF):
            out[k - 1][part[100 * levels[k].counts >= percent * levels[k - 1].counts[part]]] = True
    return out


def _scored(docs: DataFrame, vocabulary: Vocabulary, levels: list[Level], percent: int, scale: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that nothing covers: each task reads the counts of its slots and of their parts."""
    spark = docs.sparkSession
    open_ = [np.flatnonzero(~c) for c in covered(levels, percent)]
    shared = spark.sparkContext.broadcast((vocabulary, levels, open_))
    starts = np.cumsum([0, *map(len, open_)])
    schema = "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, levels, open_ = shared.value
        bases = np.array([vocabulary.base[x] for x in vocabulary.langs])
        counts = [vocabulary.counts, *[level.counts for level in levels]]

        def part(slots: np.ndarray, words: int, low: int, high: int) -> np.ndarray:
            """The slots, at their own level, of words [low, high) of phrases of ``words`` words."""
            for k in range(words, high, -1):
                slots = levels[k - 2].hash.keys[slots] >> 32
            for k in range(high, high - low, -1):
                slots = levels[k - 2].hash.keys[slots] & 0xFFFFFFFF
            return slots

        for batch in batches:
            numbers = batch["id"].to_numpy()
            at = np.searchsorted(starts, numbers, side="right") - 1
            for level in np.unique(at):
                slots, words = open_[level][numbers[at == level] - starts[level]], int(level) + 2
                a = counts[words - 1][slots].tolist()
                lang = np.searchsorted(bases, part(slots, words, 0, 1), side="right") - 1
                names = [vocabulary.langs[i] for i in lang]
                n = [vocabulary.total[x] for x in names]
                best = [None] * len(slots)
                for k in range(1, words):
                    l, r = counts[k - 1][part(slots, words, 0, k)].tolist(), counts[words - k - 1][part(slots, words, k, words)].tolist()
                    for i, (x, y) in enumerate(zip(l, r, strict=True)):
                        value = scale * a[i] * n[i] // (x * y)
                        if best[i] is None or value < best[i][0]:
                            best[i] = (value, x, y)
                spelt = [[vocabulary.words[x][int(w) - vocabulary.base[x]].as_py() for x, w in zip(names, part(slots, words, p, p + 1), strict=True)] for p in range(words)]
                yield pd.DataFrame({"lang": names, "phrase": list(map(" ".join, zip(*spelt, strict=True))), "a": a, "l": [b[1] for b in best], "r": [b[2] for b in best], "n": n, "score": [b[0] for b in best]})

    return spark.range(int(starts[-1])).mapInPandas(score, schema)


def counted_by_shuffle(docs: DataFrame, min_count: int, max_words: int) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of all frequent phrases of 1 to ``max_words`` words, (lang, n)): every phrase is a row."""
    pieces = docs.select("lang", F.explode(F.split(ascii_lower(F.col("text")), "[.,;:!?\\x0A-\\x0D]", -1)).alias("piece"))
    words = pieces.select("lang", F.filter(F.split("piece", "[\\x20\\x09]+", -1), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    total = words.groupBy("lang").agg(F.sum(F.size("w")).cast("bigint").alias("n"))
    sized = words.select("lang", "w", F.explode(F.array(*[F.lit(k) for k in range(1, max_words + 1)])).alias("k")).where(F.size("w") >= F.col("k"))
    spelt = sized.select("lang", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("phrase"))
    return spelt.groupBy("lang", "k", "phrase").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= min_count), total


def _scored_by_shuffle(docs: DataFrame, min_count: int, max_words: int, percent: int, scale: int) -> DataFrame:
    """As ``_scored``, by joins: for more words or phrases than may be broadcast."""
    counted, total = counted_by_shuffle(docs, min_count, max_words)
    f = staged(counted, "phrase-counts")
    drop = lambda c, front: F.expr(f"array_join({'slice(split(phrase, " ", -1), 2, k - 1)' if front else 'slice(split(phrase, " ", -1), 1, k - 1)'}, ' ')").alias(c)
    longer = f.where("k > 2").select("lang", F.col("f").alias("g"), F.explode(F.array(drop("x", True), drop("x", False))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("g").alias("g"))
    long_ = f.where("k > 1").join(longer, ["lang", "phrase"], "left").where(F.col("g").isNull() | (100 * F.col("g") < percent * F.col("f")))
    cut = long_.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("transform(sequence(1, k - 1), c -> struct(c, array_join(slice(split(phrase, ' ', -1), 1, c), ' ') AS x, array_join(slice(split(phrase, ' ', -1), c + 1, k - c), ' ') AS y))")).alias("s"))
    side = lambda c, n: f.select(F.col("lang"), F.col("phrase").alias(c), F.col("f").alias(n))
    both = cut.select("lang", "phrase", "a", "s.c", "s.x", "s.y").join(side("x", "l"), ["lang", "x"]).join(side("y", "r"), ["lang", "y"]).join(total, "lang")
    exact: Column = F.expr(f"(cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) * {scale}BD) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    least = both.groupBy("lang", "phrase").agg(F.min(F.struct(exact.alias("score"), "c", "l", "r", "a", "n")).alias("m"))
    return least.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def collocations(docs: DataFrame, *, min_count: int = 100, max_words: int = 5, top: int = 2000, covered_percent: int = 100, scale: int = 1000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The first ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to ``max_words`` words of one piece of a text, at least ``min_count`` times in all texts of its lang; its score
    is the least floor(scale * a * n / (l * r)) over its cuts into two parts that occur l and r times. Phrases inside a
    longer one that occurs at least ``covered_percent`` percent as often are left out.

    Words are counted by a shuffle. Frequent ones get ids, the texts become ids once, and each length then takes three
    scans of these: bins of all pairs of frequent shorter phrases that overlap, added up in a tree; the distinct pairs whose
    bins are crowded, which hold all frequent phrases; and their counts, by slot of a minimal perfect hash that keeps the
    pair itself, so that nothing else is counted with it. A pair of slots names a phrase exactly. Only tables of at most
    MAX_KEYS words or pairs are broadcast; where there are more, phrases are rows of a shuffle, with the same result.
    Defined results: a null text counts as empty; a null lang is ``und``; repeated rows count as often as they occur; ties in
    score go by count, then by the phrase's bytes; without a frequent phrase, as in an empty table, the result is empty;
    other columns are ignored, whatever their names.
    """
    if min_count < 1 or max_words < 2:
        raise ValueError("min_count must be at least 1 and max_words at least 2")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), text_or_empty(text_col).alias("text"))
    found = _mined(rows, min_count, max_words, covered_percent, scale)
    if found is None:
        found = _scored_by_shuffle(rows, min_count, max_words, covered_percent, scale)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _mined(rows: DataFrame, min_count: int, max_words: int, percent: int, scale: int) -> DataFrame | None:
    counts = staged(word_counts(rows), "phrase-words")
    often = counts.where(F.col("f") >= min_count)
    if often.count() > MAX_KEYS:
        return None
    # Only langs with a frequent word matter, and they are no more than these.
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"), F.max("f").alias("most")).where(F.col("most") >= min_count)
    vocabulary = Vocabulary.of(often.toArrow(), {r.lang: r.n for r in total.collect()})
    ids = staged(encoded(rows, rows.sparkSession.sparkContext.broadcast(vocabulary)), "phrase-ids")
    miner, mass = Miner(ids, min_count), sum(vocabulary.total.values())
    while len(miner.levels) < max_words - 1 and mass >= min_count:
        keys = miner.candidates(mass)
        if keys is None:
            return None
        mass = miner.count(keys)
    return _scored(rows, vocabulary, miner.levels, percent, scale)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), spelt AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM spelt GROUP BY lang, k, phrase HAVING count(*) >= 100
), inside AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, f AS g
  FROM (SELECT lang, k, w, f, j, unnest(range(1, k - j + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS j) WHERE j < k)
), kept AS (
  SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = f.lang AND inside.phrase = f.phrase AND 100 * inside.g >= 100 * f.f)
), cuts AS (
  SELECT kept.lang, kept.phrase, kept.f AS a, c, x.f AS l, y.f AS r, n, ((1000::HUGEINT * kept.f::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM kept JOIN (SELECT unnest(range(1, 5)) AS c) ON c < k
  JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(kept.w[1:c], ' ')
  JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(kept.w[c + 1:], ' ')
  JOIN total ON total.lang = kept.lang
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least
) WHERE rank <= 2000
"""
