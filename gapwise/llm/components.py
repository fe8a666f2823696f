"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import staged


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges that connect what these edges connect: from each vertex to the least of its component, without loops."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while (apart := root[x] != root[y]).any():
        x, y = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    hung = np.flatnonzero(root != np.arange(len(names)))
    return names[hung], names[root[hung]]


def connected(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """vertex, label: the least vertex of its component, for every vertex of ``edges`` (a, b; repeated ones and loops count for nothing).

    Alternates large-star and small-star steps until every vertex hangs on the least of its component: each step
    hangs neighbours on a smaller vertex, and the number of steps grows with the logarithm of the longest path.
    Each edge becomes one edge in either step, so that repeated ones needn't be sought. Vertices and edges of each
    round are written to the shared folder.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "cc-edges")
    for _ in range(max_rounds):
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("other")), F.struct(F.col("v").alias("vertex"), F.col("u").alias("other")))).alias("e")).select("e.*")
        least = ends.groupBy("vertex").agg(F.min("other").alias("low"), F.max("other").alias("high"), F.max(F.when(F.col("other") < F.col("vertex"), F.col("other"))).alias("below"))
        # A vertex that hangs on another is settled if it hangs on no third and nothing hangs on it.
        unsettled = (F.col("low") < F.col("vertex")) & ((F.col("high") > F.col("vertex")) | (F.col("below") > F.col("low")))
        least = staged(least.select("vertex", F.least("vertex", "low").alias("label"), unsettled.alias("unsettled")), "cc-vertices")
        if not least.agg(F.max("unsettled")).first()[0]:
            return least.select("vertex", "label")
        large = now.join(least, now["v"] == least["vertex"]).select("u", F.col("label").alias("v"))
        found = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(found, large["u"] == found["x"])
        now = staged(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), "cc-edges")
    raise RuntimeError("the components did not settle")
