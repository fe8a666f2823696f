"""Scoring texts by an n-gram language model of the corpus, held in an Elias-Fano trie."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import load, shared_dir, staged, text_or_empty
from gapwise.llm.language_id import remainder
from gapwise.llm.ngram_trie import Chunk, Level, Trie, elias_fano, named, open_sections, quantise, write_sections
from gapwise.llm.words import in_groups, word_hashes

#: The end of a text, as a token that no word is: the hash of words has 63 bits and is not negative.
END = -1
DISCOUNT = 0.75
#: Texts are handled in groups of so many bytes, to bound a worker's memory.
GROUP_BYTES = 6_000_000
#: Groups that are scored are smaller, as looking up takes more memory than counting.
SCORED_BYTES = 4_000_000
#: A chunk of the trie holds the triples of about so many tokens; so many triples are sampled to cut chunks of like size.
CHUNK_TOKENS, SAMPLE = 2_000_000, 200_000


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token of all texts, with one end after each text's words; and the number of each text's tokens."""
    hashes, sizes = word_hashes(texts)
    return np.insert(hashes, np.cumsum(sizes), END), sizes + 1


def write_level(rows: DataFrame, size: int, folder: str, name: str) -> Level:
    """Sort the ``size`` rows of (key, n) by range, write chunks of about CHUNK_TOKENS keys, and open the table."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        part = pd.concat(parts) if parts else None
        if part is None or part.empty:
            return
        keys, n = part["key"].to_numpy(), part["n"].to_numpy()
        sections = named("keys", elias_fano(keys)) | {"counts": n.astype("<u4" if n.max() < 1 << 32 else "<u8")}
        meta = {"first": int(keys[0]), "n": len(keys)} | write_sections(folder, f"{name}-{TaskContext.get().partitionId()}", sections)
        yield pd.DataFrame({"meta": [json.dumps(meta)]})

    ranged = rows.select("key", "n").repartitionByRange(max(1, -(-size // CHUNK_TOKENS)), "key").sortWithinPartitions("key")
    metas = sorted((json.loads(r.meta) for r in ranged.mapInPandas(write, "meta string").collect()), key=lambda m: m["first"])
    base = 0
    for meta in metas:
        meta["base"] = base
        base += meta["n"]
    return Level(metas)


def triples(words: Level, base: int, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (pair, third) of the texts in order, and how often each occurs.

    Words are numbered from 1. A pair is first * base + second; third is 0 where the text ends with the pair.
    """
    hashes, sizes = tokens(texts)
    distinct, place = np.unique(hashes, return_inverse=True)
    word = (words.find(distinct, in_order=True) + 1)[place]
    last = np.cumsum(sizes) - 1
    pair = word[:-1] * base + word[1:]
    third = np.append(word[2:], 0)
    third[last[last > 0] - 1] = 0
    inside = np.ones(len(pair), dtype=bool)
    inside[last[:-1]] = False
    known, rank = np.unique(pair[inside], return_inverse=True)
    both, n = np.unique(rank * base + third[inside], return_counts=True)
    return known[both // base], both % base, n


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes | np.ndarray, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, codec="zstd"), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(n)


def write_packed(folder: str, name: str, columns: dict[str, np.ndarray]) -> dict:
    """Write sorted columns of one length as their differences, packed, into a file of the shared folder."""
    n = len(next(iter(columns.values())))
    return {"rows": n} | write_sections(folder, name, {k: np.frombuffer(packed(np.diff(x, prepend=0)), dtype=np.uint8) for k, x in columns.items()})


def read_packed(meta: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.cumsum(unpacked(data, meta["rows"])) for data in open_sections(meta).values())


def _boundaries(docs: DataFrame, words: Level, base: int, n_tokens: int) -> list[tuple[int, int]]:
    """(pair, third) at which chunks begin, from a sample of about SAMPLE triples; they decide how even chunks are, nothing else."""
    parts = -(-n_tokens // CHUNK_TOKENS)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, GROUP_BYTES):
            pair, third, _ = triples(words, base, table.column("text"))
            chosen = (pair * 31 + third) % 10 == 0
            yield pa.RecordBatch.from_arrays([pa.array(pair[chosen]), pa.array(third[chosen])], ["pair", "third"])

    if parts < 2:
        return []
    rows = docs.sample(min(1.0, 10 * SAMPLE / n_tokens), 1).mapInArrow(sampled, "pair bigint, third bigint").distinct().toPandas()
    rows = rows.sort_values(["pair", "third"])
    at = [len(rows) * k // parts for k in range(1, parts)]
    return list(dict.fromkeys(rows.iloc[at].itertuples(index=False, name=None))) if len(rows) else []


def train(docs: DataFrame) -> Trie:
    """Count the n-grams of all texts in ``docs`` (text) and build the trie.

    The words are counted first; their order by hash numbers them. A second pass counts triples: each group of
    texts sends every distinct one once, to the chunk whose range holds it, so that neither a frequent word nor a
    frequent pair meets in one task. A chunk tells pairs and single contexts as well; those cut by its ends are
    put right by what the neighbours say of theirs. Counted chunks lie in the shared folder until then: rows of
    their size would fill the executors' heaps.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lm-{np.random.SeedSequence().entropy:x}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, GROUP_BYTES):
            keys, n = np.unique(tokens(table.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    counted = staged(docs.mapInArrow(unigrams, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    n_words, n_tokens = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    words, base = write_level(counted, n_words, folder, "words"), n_words + 1
    if not n_tokens:
        return Trie(0, 0, words)
    bounds = _boundaries(docs, words, base, n_tokens)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, GROUP_BYTES):
            pair, third, n = triples(words, base, table.column("text"))
            cuts = [0]
            for p, t in bounds:
                low, high = np.searchsorted(pair, [p, p + 1]).tolist()
                cuts.append(low + int(np.searchsorted(third[low:high], t)))
            filled = [(k, low, high) for k, (low, high) in enumerate(zip(cuts, [*cuts[1:], len(pair)], strict=True)) if low < high]
            columns = [[packed(np.diff(x[low:high], prepend=0)) for _, low, high in filled] for x in (pair, third, n)]
            arrays = [pa.array([k for k, _, _ in filled], pa.int32()), pa.array([h - low for _, low, h in filled], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "rows", "pair", "third", "n"])

    def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def column(name: str) -> np.ndarray:
            return np.concatenate([np.cumsum(unpacked(data.as_buffer(), rows)) for data, rows in zip(table.column(name), table.column("rows").to_pylist(), strict=True)])

        known, rank = np.unique(column("pair"), return_inverse=True)
        key = rank * base + column("third")
        del rank
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(column("n")[order], begins)
        del order
        rank, third = np.divmod(key[begins], base)
        return known[rank], third, n

    def edges(pair: np.ndarray, third: np.ndarray, n: np.ndarray) -> dict[str, int]:
        """Of the first and the last pair and their first words: occurrences, and how many words follow."""
        out = {"rows": len(pair), "from_third": int(third[0]), "to_third": int(third[-1])}
        for name, p in (("from", int(pair[0])), ("to", int(pair[-1]))):
            low, high = np.searchsorted(pair, [p, p + 1])
            left, right = np.searchsorted(pair, [p // base * base, (p // base + 1) * base])
            out |= {f"{name}_pair": p, f"{name}_n": int(n[low:high].sum()), f"{name}_kinds": int((third[low:high] > 0).sum()), f"{name}_seconds": len(np.unique(pair[left:right]))}
        return out

    def reduced(table: pa.Table) -> pa.Table:
        pair, third, n = summed(table)
        row = {"chunk": table.column("chunk")[0].as_py()} | edges(pair, third, n)
        row["meta"] = json.dumps(write_packed(folder, f"counts-{row['chunk']}", {"pair": pair, "third": third, "n": n}))
        return pa.Table.from_pylist([row], schema=chunk_schema)

    names = ["rows", "from_third", "to_third", *[f"{end}_{k}" for end in ("from", "to") for k in ("pair", "n", "kinds", "seconds")]]
    chunk_schema = pa.schema([("chunk", pa.int32()), *[(k, pa.int64()) for k in names], ("meta", pa.string())])
    parted = docs.mapInArrow(counts, "chunk int, rows bigint, pair binary, third binary, n binary")
    ddl = "chunk int, " + ", ".join(f"{k} bigint" for k in names) + ", meta string"
    ends = sorted(parted.groupBy("chunk").applyInArrow(reduced, ddl).collect(), key=lambda r: r.chunk)
    given = [(r.chunk, r.meta, *fixed) for r, *fixed in zip(ends, *corrected(ends, base), strict=True)]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pair, third, n = read_packed(json.loads(row["meta"]))
                codes = probabilities(words, base, pair, third, n, row["pairs"], row["firsts"])
                del n
                meta = {"pair": int(pair[0]), "third": int(third[0]), "word": int(pair[0] // base)}
                meta |= write_sections(folder, f"grams-{row['chunk']}", Chunk.sections(pair, third, base, codes))
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(meta)])], ["meta"])

    rows = spark.createDataFrame(given, "chunk int, meta string, pairs array<array<bigint>>, firsts array<array<bigint>>")
    written = rows.repartition(len(given)).mapInArrow(write, "meta string").collect()
    metas = sorted((json.loads(r.meta) for r in written), key=lambda m: (m["pair"], m["third"]))
    return Trie(n_words, n_tokens, words, metas)


def corrected(ends: list, base: int) -> tuple[list, list]:
    """For each chunk what holds of its first and last pair, (pair, occurrences, kinds of thirds), and of their first words, (word, kinds of seconds)."""
    n: dict[int, list[int]] = {}
    seconds: dict[int, int] = {}
    before = None
    for r in ends:
        for end in ("from", "to") if r.from_pair != r.to_pair else ("from",):
            held = n.setdefault(r[f"{end}_pair"], [0, 0])
            held[0] += r[f"{end}_n"]
            held[1] += r[f"{end}_kinds"]
        for end in ("from", "to") if r.from_pair // base != r.to_pair // base else ("from",):
            again = end == "from" and r.from_pair == before  # counted with the chunk before
            word = r[f"{end}_pair"] // base
            seconds[word] = seconds.get(word, 0) + r[f"{end}_seconds"] - again
        before = r.to_pair
    pairs = [[[p, *n[p]] for p in sorted({r.from_pair, r.to_pair})] for r in ends]
    return pairs, [[[w, seconds[w]] for w in sorted({r.from_pair // base, r.to_pair // base})] for r in ends]


def probabilities(words: Level, base: int, pair: np.ndarray, third: np.ndarray, n: np.ndarray, pairs: list, firsts: list) -> dict[str, np.ndarray]:
    """Codes of a chunk: absolute discounting, interpolated. A context spreads what it takes from its successors over the shorter context."""
    begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    held = pair[begins]
    total, kinds = np.add.reduceat(n, begins), np.add.reduceat((third > 0).astype(np.int64), begins)
    for p, occurrences, k in pairs:
        at = np.searchsorted(held, p)
        total[at], kinds[at] = occurrences, k
    first = held // base
    span = np.arange(first[0], first[-1] + 1)
    count = words.take("counts", span - 1)
    seconds = np.diff(np.searchsorted(first, np.append(span, span[-1] + 1)))
    for w, k in firsts:
        seconds[w - span[0]] = k
    share = lambda k, of: np.where(k > 0, DISCOUNT * np.maximum(k, 1) / np.maximum(of, 1), 1.0)
    real = third > 0
    return {
        "g1": quantise(share(seconds, count)),
        "d2": quantise((total - DISCOUNT) / count[first - span[0]]),
        "g2": quantise(share(kinds, total)),
        "d3": quantise((n - DISCOUNT)[real] / np.repeat(total, np.diff(np.append(begins, len(pair))))[real]),
    }


def scored(trie: Trie, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its training count and the model's log10 probability; and each text's number of tokens. Equal n-grams are looked up once."""
    hashes, sizes = tokens(texts)
    starts = np.cumsum(sizes) - sizes
    distinct, place = np.unique(hashes, return_inverse=True)
    del hashes
    at = trie.level.find(distinct, in_order=True)
    count = trie.level.take("counts", at)
    p = ((count + 1.0) / (trie.tokens + trie.words + 1.0))[place]
    word = (at + 1)[place]
    weight = np.ones(len(distinct))
    held = np.flatnonzero(at >= 0)
    held = held[np.argsort(at[held])]
    weight[held] = trie.weights(at[held] + 1)

    # ``second`` are tokens with one before them in the text, ``after`` those with two.
    mask = np.ones(len(p), dtype=bool)
    mask[starts] = False
    second = np.flatnonzero(mask)
    mask[starts[sizes > 1] + 1] = False
    after = np.flatnonzero(mask)
    del mask
    pair = np.where((word[second - 1] > 0) & (word[second] > 0), word[second - 1] * (trie.words + 1) + word[second], 0)
    pairs, which = np.unique(pair, return_inverse=True)
    del pair
    d2, g2 = trie.pair_codes(pairs)
    p[second] = d2[which] + weight[place[second - 1]] * p[second]

    of_pair = np.zeros(len(p), dtype=np.int64)
    of_pair[second] = which
    context = of_pair[after - 1]
    del of_pair, which, second
    keys, back = np.unique(context * (trie.words + 1) + word[after], return_inverse=True)
    del word
    context_of, third = np.divmod(keys, trie.words + 1)
    del keys
    known = np.flatnonzero((third > 0) & (d2[context_of] > 0))
    d3 = np.zeros(len(third))
    d3[known] = trie.third_codes(pairs, context_of[known], third[known])
    p[after] = d3[back] + g2[context] * p[after]
    return count[place], np.log10(p), sizes


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """n_tokens, n_known, base_score and score of each row of ``docs`` (text and other columns)."""
    others = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, SCORED_BYTES):
            counts, p, sizes = scored(trie, table.column("text"))
            starts = np.cumsum(sizes) - sizes
            base = np.log10((counts + 1.0) / (trie.tokens + trie.words + 1.0))
            sums = [sizes, np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(p, starts)]
            kept = table.select([f.name for f in others])
            for name, values in zip(("n_tokens", "n_known", "base_score", "score"), sums, strict=True):
                kept = kept.append_column(name, pa.array(values))
            yield from kept.to_batches()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(run, f"{kept}, n_tokens bigint, n_known bigint, base_score double, score double")


def lm_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose remainder modulo 7 isn't 2 and scores all. base_score is the add-one unigram
    log10 probability; score that of a trigram model with interpolated absolute discounting over all n-grams, whose
    discounted probabilities and weights are rounded to 1/28 of a decade. Words of more than 8 bytes are told apart
    by 63 bits of a hash. Defined results: a null text is empty, that is, one end token; with nothing to learn from every
    token has probability 1; repeated rows count as often as they occur; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("\0null")).alias("doc_id"),
        (remainder(id_col, 7) == 2).alias("held_out"),
        text_or_empty(text_col).alias("text"),
    )
    trie = train(rows.where(~F.col("held_out")).select("text"))
    out = score(rows, trie)
    identity = F.when(F.col("doc_id") != "\0null", F.col("doc_id")).cast(docs.schema[id_col].dataType)
    return out.select(identity.alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(trie.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op6_elias_fano_lm(spark, sf_dir: str) -> DataFrame:
    return lm_score(load(spark, sf_dir, "documents"))
