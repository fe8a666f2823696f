"""Exact order statistics and modes of many columns in bounded memory.

A task never holds the distinct values of a column: ranks are found by histograms of an interval that narrows from scan to scan,
modes by counts per value that Spark can spill. All columns share each scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of one histogram; so few values of an interval are fetched instead of counted once more.
BINS, FEW = 4096, 4096
_MOST = 1.7976931348623157e308


@dataclass
class _Target:
    """The value of rank k (from 0) of column i lies in [low, high], with ``below`` values under and ``n`` values in it."""

    i: int
    k: int
    low: float
    high: float
    below: int
    n: int


def _bin(v: Column, low: float, high: float) -> Column:
    """A number that never falls as v grows; infinities have bins of their own."""
    a, b = max(low, -_MOST), min(high, _MOST)
    # Halves where the width overflows; it is never 0 otherwise, so that the two ends part.
    half = 1.0 if b - a <= _MOST else 0.5
    width = b * half - a * half
    inner = F.least(F.floor((v * half - F.lit(a * half)) / F.lit(width) * BINS), F.lit(BINS - 1)).cast("int") if width > 0 else F.lit(0)
    return F.when(v == float("-inf"), -1).when(v == float("inf"), BINS).otherwise(inner)


def order_statistics(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[int]]]) -> dict[str, dict[int, tuple[float, int, int]]]:
    """For each entry (a double column, null where missing; ranks from 0), by rank: the value, how many lie below it and how many equal it.

    One scan finds the ends of all columns; each further one counts, for all open intervals at once, BINS bins with their own
    least and largest value, and goes on in the bin that holds the rank. A rank beyond the column is left out.
    """
    names = list(wanted)
    if not names:
        return {}
    rows = df.select(*[F.nanvl(wanted[c][0], F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(names)])
    ends = rows.agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("l", F.min), ("h", F.max), ("n", F.count))]).first()
    targets = [_Target(i, k, ends[f"l{i}"], ends[f"h{i}"], 0, ends[f"n{i}"]) for i, c in enumerate(names) for k in wanted[c][1] if 0 <= k < ends[f"n{i}"]]
    while open_ := [t for t in targets if t.low < t.high]:
        spans = sorted({(t.i, t.low, t.high, t.n) for t in open_})
        small = [s for s in spans if s[3] <= FEW]
        inside = lambda s: (F.col(f"v{s[0]}") >= F.lit(s[1])) & (F.col(f"v{s[0]}") <= F.lit(s[2]))
        cells = [F.when(inside(s), F.struct(F.lit(j).alias("j"), (_bin(F.col(f"v{s[0]}"), s[1], s[2]) if s not in small else F.lit(0)).alias("b"), F.col(f"v{s[0]}").alias("v"))) for j, s in enumerate(spans)]
        seen = rows.select(F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("c.*")
        few = [j for j, s in enumerate(spans) if s in small]
        # A fetched value is a bin of its own.
        value = F.when(F.col("j").isin(few), F.col("v")) if few else F.lit(None).cast("double")
        counted = seen.groupBy("j", "b", value.alias("own")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        bins: dict[tuple, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r.j, r.b, r.low)):
            bins.setdefault(spans[r.j], []).append(r)
        for t in open_:
            for r in bins[t.i, t.low, t.high, t.n]:
                if t.k < t.below + r.n:
                    t.low, t.high, t.n = r.low, r.high, r.n
                    break
                t.below += r.n
    out: dict[str, dict] = {c: {} for c in names}
    for t in targets:
        out[names[t.i]][t.k] = (t.low, t.below, t.n)
    return out


def medians(df: DataFrame, values: Mapping[str, tuple[Column, int]]) -> dict[str, float]:
    """The median of each double column, whose count of values is given: the mean of the two in the middle."""
    found = order_statistics(df, {c: (v, sorted({(n - 1) // 2, n // 2})) for c, (v, n) in values.items() if n})
    return {c: 0.5 * ranks[min(ranks)][0] + 0.5 * ranks[max(ranks)][0] for c, ranks in found.items()}


def modes(df: DataFrame, values: Mapping[str, tuple[Column, str]]) -> dict[str, object]:
    """The most frequent value of each column (with its type's name), the smallest of tied ones; columns without a value are left out.

    Values are counted by a shuffle of (column, value), combined before it; columns of one type share a scan.
    """
    out: dict[str, object] = {}
    for kind in sorted({k for _, k in values.values()}):
        names = [c for c, (_, k) in values.items() if k == kind]
        cells = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), values[c][0].alias("v")) for i, c in enumerate(names)]), lambda x: x["v"].isNotNull())
        counts = df.select(F.explode(cells).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m"))
        out |= {names[r.i]: r.m.v for r in best.collect()}
    return out

