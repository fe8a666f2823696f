"""Ward clustering of many weighted points in rounds, nearest partners sought on the executors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Distances that the driver takes itself in a round; of more, tasks take them.
LOCAL_PAIRS = 1 << 22
#: Bytes of centroids that a broadcast holds; more are sent in blocks, one job each.
BLOCK_BYTES = 32 << 20
#: Distances that a task holds at a time.
HELD_PAIRS = 1 << 20


def increase(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Squared Ward distances of two sets of centroids, cut to 36 bits, so that rounding doesn't part ties."""
    na, nb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    square = na + nb - 2 * (a @ b.T)
    square[square < 1e-12 * (na + nb)] = 0.0
    square *= 2 * wa[:, None] * wb[None, :] / (wa[:, None] + wb[None, :])
    part, power = np.frexp(square)
    return np.ldexp(np.round(part * 2.0**36), power - 36)


def nearest(ids: np.ndarray, c: np.ndarray, w: np.ndarray, block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The partner of least distance in the block for each cluster, the smaller id in ties, and the distance."""
    others, oc, ow = block
    partner, best = np.full(len(ids), -1, dtype=np.int64), np.full(len(ids), np.inf)
    step = max(1, HELD_PAIRS // max(1, len(others)))
    for at in range(0, len(ids), step):
        mine = slice(at, at + step)
        d = increase(c[mine], w[mine], oc, ow)
        d[ids[mine][:, None] == others[None, :]] = np.inf
        j = d.argmin(axis=1)
        best[mine] = d[np.arange(len(j)), j]
        partner[mine] = np.where(np.isfinite(best[mine]), others[j], -1)
    return partner, best


def _on_executors(spark: SparkSession, ids: np.ndarray, c: np.ndarray, w: np.ndarray, block: tuple) -> tuple[np.ndarray, np.ndarray]:
    tasks = min(len(ids), max(spark.sparkContext.defaultParallelism, len(ids) * len(block[0]) // (1 << 28)))
    sent, p = spark.sparkContext.broadcast(block), c.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.asarray(batch.column("c").flatten()).reshape(batch.num_rows, p)
            found = nearest(batch.column("i").to_numpy(), mine, batch.column("w").to_numpy(), sent.value)
            yield pa.record_batch({"i": batch.column("i"), "j": found[0], "d": found[1]})

    rows = pa.table({"i": ids, "w": w, "c": pa.FixedSizeListArray.from_arrays(c.ravel(), p).cast(pa.list_(pa.float64()))})
    try:
        found = spark.createDataFrame(rows).repartition(int(tasks)).mapInArrow(search, "i bigint, j bigint, d double").toArrow().sort_by("i")
    finally:
        sent.unpersist()
    return found.column("j").to_numpy(), found.column("d").to_numpy()


def ward(spark: SparkSession, x: np.ndarray, weights: Sequence[float]) -> list[tuple[int, int, float]]:
    """(a, b, height) of each merge, from the leaves up; a cluster goes by its smallest point.

    All pairs that are each other's nearest are merged at once: a merged cluster is never nearer to a third one than its
    nearer part, so the tree is that of merging the nearest pair again and again, ties going to the smallest ids. Only
    clusters whose partner was merged are asked again. The driver holds one centroid per point, memory linear in the
    points; distances are made in blocks and never kept.
    """
    sums, w = np.array(x, dtype=float), np.array(weights, dtype=float)
    sums *= w[:, None]
    active = np.ones(len(w), dtype=bool)
    partner, best = np.full(len(w), -1, dtype=np.int64), np.full(len(w), np.inf)
    stale, merges = np.arange(len(w)), []
    width = max(1, BLOCK_BYTES // (8 * max(1, sums.shape[1])))
    while active.sum() > 1:
        others = np.flatnonzero(active)
        c = sums[stale] / w[stale][:, None]
        partner[stale], best[stale] = -1, np.inf
        for at in range(0, len(others), width):
            part = others[at : at + width]
            block = (part, sums[part] / w[part][:, None], w[part])
            far = len(stale) * len(part) > LOCAL_PAIRS and sums.shape[1]
            j, d = _on_executors(spark, stale, c, w[stale], block) if far else nearest(stale, c, w[stale], block)
            nearer = d < best[stale]
            partner[stale[nearer]], best[stale[nearer]] = j[nearer], d[nearer]
        mutual = others[(partner[partner[others]] == others) & (others < partner[others])]
        if not len(mutual):
            # Rounding on both sides of a cut may leave no pair that agrees: the least one is merged.
            a = others[np.argmin(best[others])]
            mutual, partner[partner[a]] = np.array([a]), a
        a = np.minimum(mutual, partner[mutual])
        b = np.maximum(mutual, partner[mutual])
        merges += zip(a.tolist(), b.tolist(), np.sqrt(best[mutual]).tolist(), strict=True)
        sums[a] += sums[b]
        w[a] += w[b]
        active[b] = False
        touched = np.zeros(len(w), dtype=bool)
        touched[a] = touched[b] = True
        others = np.flatnonzero(active)
        stale = others[touched[others] | touched[partner[others]]]
    return merges


def leaf_order(n: int, merges: Sequence[tuple[int, int, float]]) -> list[int]:
    """The points along the tree, the part with the smaller point first."""
    head, tail, after = list(range(n)), list(range(n)), [-1] * n
    for a, b, _ in merges:
        after[tail[a]], tail[a] = head[b], tail[b]
    out, at = [], 0
    while n and at >= 0:
        out.append(at)
        at = after[at]
    return out
