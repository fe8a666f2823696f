"""Exact Jaccard join on word shingles: prefix candidates, then signature trees."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import load, look_up, shared_dir, staged, text_or_empty
from gapwise.llm.components import connected, stars
from gapwise.llm.lm_scoring import write_level
from gapwise.llm.ngram_trie import Level
from gapwise.llm.signature_tree import SignatureTree, possible, bitmap, forest, traverse
from gapwise.llm.words import word_hashes

#: Texts are handled in groups of so many characters.
GROUP_CHARS = 8_000_000
#: Token sets of so many tokens together are joined in one piece; larger candidate groups are cut up.
BLOCK_TOKENS = 4_000_000
#: Signatures of so many sets are compared in one piece; a set counts once more for each BLOCK_STEP tokens.
BLOCK_SETS, BLOCK_STEP = 8192, 2048
#: A signature has so many bits for each token, rounded up to a power of two.
BITS_PER_TOKEN, LEAST_BITS, MOST_BITS = 4, 512, 1 << 17
MAX_BROADCAST = 50_000
#: A token known in more texts is dealt to parts of so many, so that no task has to hold all its sets.
HOT_TOKEN = 2000

MIX = np.uint64(0x9E3779B97F4A7C15)


def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        group = batch["text"].str.len().cumsum() // GROUP_CHARS
        for _, part in batch.groupby(group, sort=False):
            yield part


def shingle_sets(texts: pd.Series, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text; of fewer words the whole sequence is one shingle."""
    h, sizes = word_hashes(pa.array(texts, pa.large_string()))
    h, starts = h.astype(np.uint64), np.cumsum(sizes) - sizes

    def codes(at: np.ndarray, size: int) -> np.ndarray:
        """The hashes of ``size`` words from each of these places on."""
        code = np.full(len(at), np.uint64(size))
        for k in range(size):
            code = (code ^ (code >> np.uint64(31))) * MIX + h[at + k]
        code = (code ^ (code >> np.uint64(29))) * MIX
        return ((code ^ (code >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)

    every = codes(np.arange(max(0, len(h) - width + 1)), width)
    out = [np.unique(every[s : s + n - width + 1]) if n >= width else np.zeros(0, dtype=np.int64) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    for size in range(1, width):
        rows = np.flatnonzero(sizes == size)
        for k, code in zip(rows.tolist(), codes(starts[rows], size).tolist(), strict=True):
            out[k] = np.array([code], dtype=np.int64)
    return out


def node_of(tokens: np.ndarray) -> int:
    """A set's name: 63 bits of a hash of its tokens; -1 for the empty set, which is linked with nothing."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1 if len(tokens) else -1


def signature(tokens: np.ndarray) -> bytes:
    """The bitmap of a set; longer for larger sets, so that it parts long texts as well as short ones."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_TOKEN * max(1, len(tokens)) - 1).bit_length()))
    return bitmap(tokens, bits).tobytes()


def unified(signatures: Iterable[bytes], width: int) -> np.ndarray:
    """Signatures as rows of ``width`` bytes; shorter ones are repeated, which only adds to the bits they may share."""
    return np.frombuffer(b"".join(s * (width // len(s)) for s in signatures), dtype=np.uint64).reshape(-1, width // 8)


def _census(rows: DataFrame, width: int) -> DataFrame:
    """One pass for two results: (doc, key = node, n, signature) of each row, and (key = token, n) of tokens in several texts of a group.

    ``hashed`` names a row in both passes over the texts; it is null in rows about tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups(batches):
            sets = shingle_sets(part["text"], width)
            signatures = [signature(s) for s in sets]
            yield pd.DataFrame({"hashed": part["hashed"].astype("Int64"), "doc": part["doc"].astype("Int64"), "key": [node_of(s) for s in sets], "n": [len(s) for s in sets], "signature": signatures})
            token, count = np.unique(np.concatenate(sets), return_counts=True)
            often = count >= 2
            none = pd.array([None] * int(often.sum()), dtype="Int64")
            yield pd.DataFrame({"hashed": none, "doc": none, "key": token[often], "n": count[often], "signature": None})

    return rows.mapInPandas(run, "hashed bigint, doc bigint, key bigint, n bigint, signature binary")


def _prefixes(rows: DataFrame, width: int, percent: int, common: Level) -> DataFrame:
    """(token, part, node): of each set the tokens of its prefix; a token known as frequent is dealt to several parts.

    In any order of tokens that all sets share, two similar sets share a token within their first
    n - ceil(n * percent / 100) + 1. The order here is by known frequency, so that passages in many texts come
    last and rarely make candidates.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups(batches):
            sets = {node_of(s): s for s in shingle_sets(part["text"], width) if len(s)}
            if not sets:
                continue
            tokens = np.concatenate(list(sets.values()))
            sizes = np.array([len(s) for s in sets.values()])
            count = common.take("counts", common.find(tokens)) if common.metas else np.zeros(len(tokens), dtype=np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((tokens, count, owner))
            rank = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = rank < np.repeat(sizes - (sizes * percent + 99) // 100 + 1, sizes)
            node = np.array(list(sets), dtype=np.int64)[owner[first]]
            known = count[order][first]
            deal = np.where(known >= HOT_TOKEN, node % (known // HOT_TOKEN + 1), -1)
            yield pd.DataFrame({"token": tokens[order][first], "part": deal, "node": node})

    return rows.select("text").mapInPandas(run, "token bigint, part bigint, node bigint")


def _leaders(prefixes: DataFrame) -> DataFrame:
    """(label, node): each node with the least node, the leader, of every token that several nodes share.

    Near copies share thousands of tokens, but few leaders, so that their signatures meet a few times only. The
    prefixes are shuffled once, by token and part; parts of a frequent token agree on a leader afterwards.
    """
    whole = Window.partitionBy("token", "part")
    ends = prefixes.withColumns({"low": F.min("node").over(whole), "high": F.max("node").over(whole)})
    frequent = F.col("part") >= 0
    ends = ends.where(frequent | (F.col("low") < F.col("high")))
    ends = ends.select(F.when(frequent, F.col("token")).otherwise(F.col("low")).alias("label"), "part", "node").distinct()
    shared = staged(ends, "join-shared")
    hot = shared.where("part >= 0")
    least = hot.groupBy("label", "part").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    least = least.groupBy("label").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("part").alias("parts")).where("low < high")
    least = least.select(F.col("label").alias("of"), "low", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("at"))
    led = hot.join(least, (F.col("label") == F.col("of")) & (F.col("part") == F.col("at"))).select(F.col("low").alias("label"), "node")
    return shared.where("part < 0").select("label", "node").unionByName(led).distinct()


def _tasks(members: DataFrame, slim: DataFrame, weight: str, limit: int, percent: int) -> DataFrame:
    """The members (label, node, n, ...) with task and side: which joins each takes part in. ``slim`` has the same rows and the weight.

    A group whose ``weight`` sums up to ``limit`` is one join with itself. A larger one is cut by size class,
    which similar sets share or have next to each other, and each class by a hash; every block is joined with
    itself and with each other that may hold similar sets. Only the blocks of large groups are joined to
    the members; there are no more of those than limits in the whole input, and up to MAX_BROADCAST are
    broadcast, so that no member moves.
    """
    place = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    sized = members.withColumn("class", place)
    classes = slim.groupBy("label", place.alias("class")).agg(F.sum(weight).alias("mass"))
    large = classes.groupBy("label").agg(F.sum("mass").alias("total")).where(F.col("total") > limit)
    blocks = classes.join(large, "label").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("mass") / limit).cast("int")))).alias("m"))
    blocks = staged(blocks.withColumnRenamed("label", "of"), "join-blocks")
    joined = sized.join(F.broadcast(blocks) if blocks.count() <= MAX_BROADCAST else blocks, F.col("label") == F.col("of"), "left")
    sub = "pmod(xxhash64(node), m[class])"
    none = "cast(array() as array<struct<task: bigint, side: int>>)"
    cut = F.expr(f"""
        flatten(array(
          transform(sequence(0, m[class] - 1), x -> named_struct('task', xxhash64(label, class, least({sub}, x), class, greatest({sub}, x)), 'side', cast(if({sub} <= x, 0, 1) as int))),
          if(m[class + 1] is null, {none}, transform(sequence(0, m[class + 1] - 1), y -> named_struct('task', xxhash64(label, class, {sub}, class + 1, y), 'side', 0))),
          if(m[class - 1] is null, {none}, transform(sequence(0, m[class - 1] - 1), y -> named_struct('task', xxhash64(label, class - 1, y, class, {sub}), 'side', 1)))
        ))""")
    whole = F.expr("array(named_struct('task', xxhash64(label), 'side', 0))")
    return joined.select(*members.columns, F.explode(F.when(F.col("of").isNull(), whole).otherwise(cut)).alias("t")).select(*members.columns, "t.task", "t.side")


def _whole_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of batches sorted by task, cut so that no task is torn apart; repeated nodes once."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        rows = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
        if rows is None or rows.empty:
            continue
        task = rows["task"].to_numpy()
        cut = len(rows) if batch is None else int(np.searchsorted(task, task[-1], side="left"))
        rest, rows = rows.iloc[cut:], rows.iloc[:cut].drop_duplicates(["task", "side", "node"])
        if len(rows):
            task = rows["task"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            yield rows, starts, np.append(starts[1:], len(task))


def _by_signature(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect what the pairs do that bitmaps and sizes leave possible, as few as that takes in a task's batch.

    The few sets of a small task are compared at once with those of all other small tasks; larger ones by trees,
    one for each length of signature. Lengths of similar sets differ by less than 200 / percent times.
    """

    def tree(signatures: np.ndarray, width: int, sizes: np.ndarray, excess: np.ndarray, rows: np.ndarray) -> SignatureTree:
        words = unified(signatures[rows], width)
        order = np.lexsort((words[:, -1], words[:, 0], sizes[rows]))
        return SignatureTree.build(order, words[order], sizes[rows][order], excess[rows][order])

    def small(signatures: np.ndarray, widths: np.ndarray, sizes: np.ndarray, excess: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        near = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        x, y = x[near], y[near]
        width = np.maximum(widths[x], widths[y])
        for w in np.unique(width).tolist():
            same = np.flatnonzero(width == w)
            for at in np.array_split(same, len(same) * w // 64_000_000 + 1):
                here = np.arange(len(at))
                layers = [(unified(signatures[k], w), sizes[k], sizes[k], excess[k]) for k in (x[at], y[at])]
                ok = possible(*layers, here, here, percent)
                yield np.stack([x[at][ok], y[at][ok]], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _whole_tasks(batches):
            signatures, sizes, side, node = rows["signature"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy(), rows["node"].to_numpy()
            widths = np.fromiter(map(len, signatures), dtype=np.int64, count=len(rows))
            excess = sizes.copy()
            for w in np.unique(widths).tolist():
                same = np.flatnonzero(widths == w)
                excess[same] -= np.bitwise_count(unified(signatures[same], w)).sum(axis=1, dtype=np.int64)
            size, whole = ends - starts, np.add.reduceat(side, starts) == 0
            pairs = [np.zeros((0, 2), dtype=np.int64)]
            for few in (2, 3, 4):
                at = starts[(size == few) & whole]
                for i, j in itertools.combinations(range(few), 2):
                    pairs += small(signatures, widths, sizes, excess, at + i, at + j)
            for k in np.flatnonzero((size > 4) | (~whole & (size > 1))):
                span = np.arange(starts[k], ends[k])
                left = {w: span[(side[span] == 0) & (widths[span] == w)] for w in np.unique(widths[span]).tolist()}
                right = left if whole[k] else {w: span[(side[span] == 1) & (widths[span] == w)] for w in left}
                for v, w in itertools.product(left, right):
                    x, y = left[v], right[w]
                    if not len(x) or not len(y) or percent * max(v, w) >= 200 * min(v, w) or (whole[k] and v > w):
                        continue
                    one = tree(signatures, max(v, w), sizes, excess, x)
                    alone = whole[k] and v == w
                    found = traverse(one, None if alone else tree(signatures, max(v, w), sizes, excess, y), percent)
                    pairs.append((x if alone else np.concatenate([x, y]))[np.array(found, dtype=np.int64).reshape(-1, 2)])
            pairs = node[np.concatenate(pairs)]
            yield pd.DataFrame(dict(zip("ab", stars(pairs[:, 0], pairs[:, 1]), strict=True)))

    given = tasks.select("task", "side", "node", "n", "signature")
    return given.repartition("task").sortWithinPartitions("task").mapInPandas(run, "a bigint, b bigint")


def _by_tokens(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect all that exact links connect within each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, ends in _whole_tasks(batches):
            side, node = rows["side"].to_numpy(), rows["node"].to_numpy()
            sets = [np.frombuffer(t, dtype=np.int64) for t in rows["tokens"]]
            out = [np.zeros((0, 2), dtype=np.int64)]
            for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
                left, right = ([k for k in range(low, high) if side[k] == s] for s in (0, 1))
                if left and len(left) + len(right) > 1 and (right or not side[low:high].any()):
                    found = forest([sets[k] for k in left], [sets[k] for k in right] or None, percent)
                    out.append(node[np.array(left + right)[np.array(found, dtype=np.int64).reshape(-1, 2)]])
            pairs = np.concatenate(out)
            yield pd.DataFrame(dict(zip("ab", stars(pairs[:, 0], pairs[:, 1]), strict=True)))

    given = tasks.select("task", "side", "node", "tokens")
    return given.repartition("task").sortWithinPartitions("task").mapInPandas(run, "a bigint, b bigint")


def _sets_of(rows: DataFrame, width: int, wanted: Level) -> DataFrame:
    """(label, node, n, tokens) of the rows whose name is in ``wanted``, which holds labels as its counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            label = wanted.take("counts", wanted.find(batch["hashed"].to_numpy()))
            batch = batch.assign(label=label)[label > 0]
            for part in groups(iter([batch])) if len(batch) else ():
                sets = shingle_sets(part["text"], width)
                yield pd.DataFrame({"label": part["label"].to_numpy(), "node": [node_of(s) for s in sets], "n": [len(s) for s in sets], "tokens": [s.tobytes() for s in sets]})

    return rows.select("hashed", "text").mapInPandas(run, "label bigint, node bigint, n bigint, tokens binary")


def _components(placed: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc, n, component_id) of each row: from the least ids of the nodes to those of the labels, and back down.

    A third of the rows may share a node, and a third of the nodes a label; neither meets in one task.
    """
    names = nodes.select("node", "least", "copies")
    labelled = staged(names.join(linked, names["node"] == linked["vertex"]).select("node", "label", "least"), "join-labelled")
    whole = labelled.groupBy("label").agg(F.min("least").alias("of_all"), F.count(F.lit(1)).alias("members"))
    found = look_up(labelled.select("node", "label"), whole, "label", "members").select("node", "of_all")
    found = names.join(found, "node", "left").select("node", "copies", F.coalesce("of_all", "least").alias("component_id"))
    of_texts = look_up(placed.where("node >= 0"), staged(found, "join-found"), "node", "copies")
    return of_texts.select("doc", "n", "component_id").unionByName(placed.where("node < 0").select("doc", "n", F.col("doc").alias("component_id")))


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more are
    linked; component_id is the smallest id that links reach. Exact but for hashing: shingles and sets are told
    apart by 63 bits. Rows with equal sets become one node. Nodes that share a prefix token meet as signatures, with
    the leader of that token; what a dual traversal of signature trees can't part stays connected. Each of the groups so connected meets
    again, now with token sets, and the same traversal compares exactly. Blocks are bounded in size, and no step
    emits all pairs of a group. Defined results: ids must be integers; a null or empty
    text has no shingle and is linked with nothing; null ids are reported but don't name a component unless all
    its ids are null; repeated rows are reported as often as they occur; an empty table gives an empty result;
    other columns are ignored.
    """
    folder = f"{shared_dir(docs.sparkSession)}/join-{np.random.SeedSequence().entropy:x}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), text_or_empty(text_col).alias("text"))
    rows = rows.select(F.shiftrightunsigned(F.xxhash64("doc", "text"), 1).alias("hashed"), "doc", "text")

    census = staged(_census(rows, width), "join-census")
    placed = census.where("hashed is not null").select("doc", F.col("key").alias("node"), "n")
    frequent = staged(census.where("hashed is null").groupBy("key").agg(F.sum("n").alias("n")), "join-frequent")
    common = write_level(frequent, frequent.count(), folder, "tokens")
    leaders = _leaders(_prefixes(rows, width, percent, common))

    first = F.min(F.struct("hashed", "n", "signature")).alias("s")
    nodes = census.where("hashed is not null and key >= 0").groupBy(F.col("key").alias("node"))
    nodes = nodes.agg(first, F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(nodes.select("node", "s.*", "least", "copies"), "join-nodes")
    weight = (1 + F.floor(F.col("n") / BLOCK_STEP)).alias("weight")
    met = staged(leaders.join(nodes.select("node", "n"), "node").select("label", "node", "n", weight), "join-met")
    tasks = _tasks(met, met, "weight", BLOCK_SETS, percent).select("node", "task", "side")
    refined = connected(_by_signature(tasks.join(nodes, "node"), percent))

    kept = staged(nodes.join(refined, nodes["node"] == refined["vertex"]).select("label", "node", "n", "hashed"), "join-kept")
    wanted = kept.groupBy(F.col("hashed").alias("key")).agg(F.max("label").alias("n"))
    keys = write_level(wanted, kept.count(), folder, "wanted")
    linked = connected(_by_tokens(_tasks(_sets_of(rows, width, keys), kept, "n", BLOCK_TOKENS, percent), percent))

    return _components(placed, nodes, linked).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns."""
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(stays["__keep"]), "left_semi")


def op10_signature_tree_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), ranked AS (
  SELECT doc_id, n, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, token) AS place
  FROM (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM each)
), pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
  FROM ranked a JOIN ranked b ON a.token = b.token AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  WHERE a.place <= a.n - (a.n * 80 + 99) // 100 + 1 AND b.place <= b.n - (b.n * 80 + 99) // 100 + 1
), links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = sets.doc_id) AS component_id FROM sets
"""
