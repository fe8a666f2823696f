"""Packing token streams into sequences at target source proportions, by deficit round-robin."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import load, staged, text_or_empty

END_ID = 0
#: The driver plans with one total per source, so there may be so many; a source is a corpus or a site, not a page.
MAX_SOURCES = 100_000
#: So many queue starts (one per source and partition) are broadcast; more are joined.
MAX_BROADCAST = 200_000


@dataclass(frozen=True)
class Span:
    """Windows [first, first + count) in which each source i gets (k*size*upto[i])//total - (k*size*upto[i-1])//total tokens by the k-th window.

    ``before`` are the tokens that each source gave to earlier spans, ``at`` is the first token position.
    """

    at: int
    tokens: int
    size: int
    upto: tuple[int, ...]
    before: tuple[int, ...]

    def given(self, source: int, k: int) -> int:
        """Tokens of the source in the first k windows of the span."""
        total = self.upto[-1]
        low = self.upto[source - 1] if source else 0
        return (k * self.size * self.upto[source]) // total - (k * self.size * low) // total

    def start(self, source: int, k: int) -> int:
        """Where the source's tokens begin in the span's k-th window."""
        total, low = self.upto[-1], self.upto[source - 1] if source else 0
        return ((k + 1) * self.size * low) // total - (k * self.size * low) // total


def plan_windows(totals: list[int], weights: list[float], window: int) -> list[Span]:
    """The windows in order, as few spans of equal proportions.

    Within a span the tokens given to a source after k windows differ from its share by less than one: the
    deficit that rounding leaves in one window is carried to the next. A span ends before a source would
    run short; the window in which it does is a span of its own, filled with what is left of that source and
    the others' shares; then the others go on without it.
    """
    scale = 1 << 20
    left, given, spans, at = list(totals), [0] * len(totals), [], 0

    def cumulated(parts: list[int]) -> tuple[int, ...]:
        return tuple(int(x) for x in np.cumsum(np.array(parts, dtype=object)))

    def emit(count: int, size: int, upto: tuple[int, ...]) -> None:
        nonlocal at
        span = Span(at, count * size, size, upto, tuple(given))
        for i in range(len(left)):
            n = span.given(i, count)
            left[i] -= n
            given[i] += n
        spans.append(span)
        at += count * size

    while sum(left):
        live = [max(1, round(w * scale)) if n else 0 for w, n in zip(weights, left, strict=True)]
        upto = cumulated(live)
        probe = Span(at, 0, window, upto, tuple(given))
        low, high = 0, sum(left) // window + 1
        while low < high:  # the most windows that no source falls short in
            mid = (low + high + 1) // 2
            low, high = (mid, high) if all(probe.given(i, mid) <= left[i] for i in range(len(left))) else (low, mid - 1)
        if low:
            emit(low, window, upto)
            continue
        size, need, take = min(window, sum(left)), min(window, sum(left)), [0] * len(left)
        while need:  # rounds: each source gives its share of what is missing, as far as it can
            open_ = [i for i in range(len(left)) if take[i] < left[i]]
            share = sum(live[i] for i in open_)
            for i in open_:
                take[i] += min(left[i] - take[i], max(1, need * live[i] // share), size - sum(take))
            need = size - sum(take)
        emit(1, size, cumulated(take))
    return spans


def pieces(spans: list[Span], source: int, first: int, n: int, sequence: int) -> list[tuple[int, int, int]]:
    """(start in the document, length, position) of a document that holds tokens [first, first + n) of its source."""
    befores, out, at, end = [s.before[source] for s in spans], [], first, first + n
    while at < end:
        span = spans[bisect_right(befores, at) - 1]
        offset, count = at - span.before[source], span.tokens // span.size
        low, high = 0, count - 1
        while low < high:  # the window that holds this token
            mid = (low + high) // 2
            low, high = (low, mid) if span.given(source, mid + 1) > offset else (mid + 1, high)
        within = offset - span.given(source, low)
        room = span.given(source, low + 1) - offset
        position = span.at + low * span.size + span.start(source, low) + within
        take = min(end - at, room, sequence - position % sequence)
        out.append((at - first, take, position))
        at += take
    return out


def load_encoder(name: str):
    """The ids of the public byte-level BPE. Its ranks file gives the ids of its JSON file, several times faster.

    The tokens that the JSON file adds are matched in the text before it is cut, as the tokenizers library does.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    with open(public_tokenizers.path(name).removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def tokenized(docs: DataFrame, *, id_col: str, source_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """id, source, a, b, c, part, before, doc_tokens and the ids as little-endian 32-bit numbers.

    Documents are ordered by hashes of the id (a) and the text (b); c only tells rows apart that are alike in both, so that
    many repeats of one row still spread. ``before`` counts the tokens of the source's documents earlier in ``part``, a
    range of that order.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, upto = load_encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = [np.array([*encoder.encode(t, allowed_special="all"), END_ID], dtype="<u4") for t in batch.pop("text")]
            before = []
            for source, one in zip(batch["source"], ids, strict=True):
                before.append(upto.get(source, 0))
                upto[source] = before[-1] + len(one)
            yield batch.assign(part=part, before=before, doc_tokens=[len(i) for i in ids], ids=[i.tobytes() for i in ids])

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("\0null")).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0null")).alias("source"),
        F.xxhash64(F.lit("queue"), F.col(id_col).cast("string")).alias("a"),
        F.xxhash64(text_or_empty(text_col)).alias("b"),
        F.monotonically_increasing_id().alias("c"),
        text_or_empty(text_col).alias("text"),
    )
    ordered = rows.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c")
    return ordered.mapInPandas(encode, "id string, source string, a bigint, b bigint, c bigint, part int, before bigint, doc_tokens bigint, ids binary")


def pack(docs: DataFrame, weights: Mapping[str, float] | None = None, *, temper: float = 1.0, sequence: int = 1024, window: int = 32 * 1024, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Each source is a queue of its documents' tokens. Windows of ``window`` tokens take from each queue its
    target share; sequences are the consecutive ``sequence`` tokens of the windows, so all but the last
    are full. Without ``weights`` the target is each source's share of all tokens to the power of ``temper``: at 1 every window is
    mixed alike to the end, at less small sources get more. A source that runs out leaves its share to the others, and
    a source without a weight comes last.

    The plan is arithmetic on queue positions, so no task has to wait for another's deficit and no token is shuffled: a
    queue follows a hash of the id, texts are dealt to ranges of that hash, and a document's position is its source's sum
    over earlier ranges plus a running total in its own. So the pieces are the same however the rows lay and
    wherever ranges begin. Tokens are computed once and kept in the shared folder. The driver sees one total per source; more than MAX_SOURCES are refused. Defined
    results: a null text is the end id alone; a null source is a source of its own; a null id stays null;
    repeated rows are packed as often as they occur; ids may be of any type that can be a string; an empty table gives an
    empty result; other columns are ignored.
    """
    ids = staged(tokenized(docs, id_col=id_col, source_col=source_col, text_col=text_col, vocabulary=vocabulary), "pack-ids")
    sums = ids.groupBy(F.col("source").alias("of"), F.col("part").alias("at")).agg(F.sum("doc_tokens").alias("n"), F.min(F.struct("a", "b", "c")).alias("begins"))
    earlier = Window.partitionBy("of").orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(sums.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("begins"), "pack-queues")
    found = starts.groupBy("of").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("starts")).orderBy("of").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    names, totals = [r.of for r in found], [r.n for r in found]
    shares = [n**temper if weights is None else float(weights.get(name, 0.0)) for name, n in zip(names, totals, strict=True)]
    scale, numbers = sum(shares) or 1.0, {name: k for k, name in enumerate(names)}
    spans = plan_windows(totals, [s / scale for s in shares], window)
    if sum(r.starts for r in found) <= MAX_BROADCAST:
        starts = F.broadcast(starts)
    placed = ids.join(starts, (F.col("source") == F.col("of")) & (F.col("part") == F.col("at")))
    placed = placed.select("id", "source", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("first"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, s, n, ids_, first in batch.itertuples(index=False, name=None):
                for start, length, position in pieces(spans, numbers[s], first, n, sequence):
                    crc = zlib.crc32(memoryview(ids_)[4 * start : 4 * (start + length)])
                    rows.append((d, start, length, crc, n, position // sequence, position % sequence, s))
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    schema = "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    real = lambda c: F.when(F.col(c) != "\0null", F.col(c))
    out = placed.mapInPandas(cut, schema).withColumns({"doc_id": real("id").cast(docs.schema[id_col].dataType), "source": real("source")})
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op8_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """Targets are the square roots of the sources' shares, so that small sources run out before the end."""
    return pack(load(spark, sf_dir, "documents"), temper=0.5)
