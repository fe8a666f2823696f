"""Exact nearest neighbours without meeting all pairs.

Recipients with the same values ask once. Recipients that miss the same features form a group, for which donors are reduced
to the features that it has: of donors then equal only the first ids can be neighbours. The donors of a group lie in boxes,
the leaves of a tree of cuts by a feature's value or by whether it is missing. A recipient first looks into the boxes that may
be nearest to it; the k-th distance found there is a radius, and only boxes whose least possible distance is within it are
looked into besides. The bound holds with missing values on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a box, about. Boxes are broadcast, so there are no more than MAX_BOXES, about: of more rows each holds more.
BLOCK, MAX_BOXES = 512, 8192
#: Recipients that meet a box in one task, about.
ASKED = 4096
#: The commonest sets of missing features form groups of their own, all others one of whole donors.
GROUPS = 32
#: Sampled donors of a box, about, and numbers in the whole sample at most: they place the cuts.
SAMPLED, SAMPLE = 16, 1 << 22
#: Numbers in an array of differences at most.
CELLS = 1 << 22


@dataclass(frozen=True)
class Euclidean:
    """sqrt(p / p_observed * sum of squared differences) over the features that both rows have; none without any."""

    alone = np.inf

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ia, ib = ~np.isnan(a), ~np.isnan(b)
        both = ia.astype(float) @ ib.T.astype(float)
        x, y = np.where(ia, a, 0.0), np.where(ib, b, 0.0)
        total = np.zeros_like(both)
        for j in range(a.shape[1]):
            d = x[:, j, None] - y[None, :, j]
            total += d * d * (ia[:, j, None] & ib[None, :, j])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.sqrt(np.where(both > 0, a.shape[1] * total / both, np.nan))

    def parts(self, gap: np.ndarray) -> np.ndarray:
        return gap * gap

    def whole(self, mean: np.ndarray, p: int) -> np.ndarray:
        return np.sqrt(p * mean)


@dataclass(frozen=True)
class Gower:
    """Mean of |difference| / range (or inequality where the range is 0) over the features that both rows have; 1 without any."""

    ranges: tuple[float, ...]
    alone = 1.0

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total, both = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        for j, r in enumerate(self.ranges):
            x, y = a[:, j, None], b[None, :, j]
            ok = ~np.isnan(x) & ~np.isnan(y)
            part = np.abs(x - y) / r if r > 0 else (x != y).astype(float)
            total += np.where(ok, part, 0.0)
            both += ok
        return np.where(both > 0, total / np.maximum(both, 1), 1.0)

    def parts(self, gap: np.ndarray) -> np.ndarray:
        r = np.array(self.ranges)
        return np.where(r > 0, gap / np.where(r > 0, r, 1.0), (gap > 0).astype(float))

    def whole(self, mean: np.ndarray, p: int) -> np.ndarray:
        return mean


@dataclass(frozen=True)
class Boxes:
    """Per box and feature: the least and largest observed value, and whether all or some rows have one; and rows per box."""

    low: np.ndarray
    high: np.ndarray
    always: np.ndarray
    ever: np.ndarray
    rows: np.ndarray

    def bounds(self, a: np.ndarray, metric) -> np.ndarray:
        """The least distance that any row of each box can have to each row of ``a``; inf where none can have one.

        A row's distance is a mean over the features it shares with ``a``: those that all rows of the box have, and any of the
        others. The smallest of these others are let in as long as they lower the mean.
        """
        p, out = a.shape[1], np.empty((len(a), len(self.rows)))
        step = max(1, CELLS // max(1, len(self.rows) * p))
        for at in range(0, len(a), step):
            x = a[at : at + step, None, :]
            seen = ~np.isnan(x)
            part = metric.parts(np.maximum(0.0, np.maximum(self.low - x, x - self.high)))
            sure, open_ = seen & self.always, seen & self.ever & ~self.always
            total, n = np.where(sure, part, 0.0).sum(axis=2), sure.sum(axis=2)
            most = int(open_.sum(axis=2).max(initial=0))
            extra = np.sort(np.where(open_, part, np.inf), axis=2) if most else None
            with np.errstate(invalid="ignore", divide="ignore"):
                least = np.where(n > 0, total / n, np.inf)
                for t in range(most):
                    total = total + extra[:, :, t]
                    least = np.minimum(least, total / (n + t + 1))
                found = np.where(np.isfinite(least), metric.whole(least, p), np.inf)
            if np.isfinite(metric.alone):
                found = np.where(n == 0, np.minimum(found, metric.alone), found)
            out[at : at + step] = found
        # Rounding must not hide a neighbour.
        return out * (1 - 1e-9)

    def of(self, at: np.ndarray) -> Boxes:
        return Boxes(self.low[at], self.high[at], self.always[at], self.ever[at], self.rows[at])


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=float).reshape(len(x), -1 if len(x) else 0)


@dataclass(frozen=True)
class Tree:
    """Cuts: rows whose ``feature`` is at most ``cut`` go to the node ``low``, others (missing ones too) to ``high``; leaves have the feature -1 and a box."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    box: np.ndarray

    @staticmethod
    def grown(x: np.ndarray, size: int, metric, first_box: int) -> Tree:
        """Leaves of at most ``size`` rows of ``x``, as far as the rows differ; boxes are numbered from ``first_box``."""
        nodes, todo, boxes = [[-1, 0.0, 0, 0, -1]], [(0, np.arange(len(x)))], first_box
        while todo:
            at, rows = todo.pop()
            some = x[rows]
            j, t = Tree._cut(some, metric) if len(rows) > size else (-1, 0.0)
            if j < 0:
                nodes[at][4], boxes = boxes, boxes + 1
                continue
            left = some[:, j] <= t
            nodes[at][:4] = j, t, len(nodes), len(nodes) + 1
            todo += [(len(nodes), rows[left]), (len(nodes) + 1, rows[~left])]
            nodes += [[-1, 0.0, 0, 0, -1], [-1, 0.0, 0, 0, -1]]
        feature, cut, low, high, box = zip(*nodes, strict=True)
        return Tree(np.array(feature), np.array(cut, dtype=float), np.array(low), np.array(high), np.array(box, dtype=np.int64))

    @staticmethod
    def _cut(x: np.ndarray, metric) -> tuple[int, float]:
        """Missing from observed first, the most even such cut; then the middle of the feature that spreads distances most; -1 if all rows are equal."""
        gone = np.isnan(x).sum(axis=0)
        even = np.minimum(gone, len(x) - gone)
        if even.any():
            return int(np.argmax(even)), np.inf
        filled = np.where(gone > 0, 0.0, x)
        spread = metric.parts(filled.max(axis=0) - filled.min(axis=0))
        j = int(np.argmax(spread))
        if not spread[j] > 0:
            return -1, 0.0
        v = np.sort(filled[:, j])
        t = v[(len(v) - 1) // 2]
        return j, float(t if t < v[-1] else v[np.searchsorted(v, t) - 1])

    def boxes(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(self.feature[at] >= 0)).size:
            node = at[inner]
            left = x[inner, self.feature[node]] <= self.cut[node]
            at[inner] = np.where(left, self.low[node], self.high[node])
        return self.box[at]


def _seen(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.packbits(~np.isnan(x), axis=1)]


def _groups(classes: DataFrame) -> tuple[list[list[bool]], bool]:
    """The features that the recipients of each group have, and whether there are others besides."""
    shape = F.transform("__x", lambda v: ~F.isnan(v)).alias("shape")
    rows = classes.select(shape).groupBy("shape").count().orderBy(F.desc("count"), "shape").limit(GROUPS + 1).collect()
    return [list(r["shape"]) for r in rows[:GROUPS]], len(rows) > GROUPS


def _reduced(donors: DataFrame, groups: list[list[bool]], others: bool, enough: int, metric) -> DataFrame:
    """__g, __id, __x: for each group the donors' values of its features, and of equal donors the first ``enough`` ids."""
    nan = F.lit(float("nan"))
    views = [F.struct(F.lit(g).alias("__g"), F.array(*[F.get("__x", F.lit(j)) if has else nan for j, has in enumerate(shape)]).alias("__x")) for g, shape in enumerate(groups)]
    if others:
        views.append(F.struct(F.lit(len(groups)).alias("__g"), F.col("__x")))
    rows = donors.select("__id", F.inline(F.array(*views)))
    if np.isinf(metric.alone):
        rows = rows.where(F.exists("__x", lambda v: ~F.isnan(v)))
    order = Window.partitionBy("__g", "__x").orderBy("__id")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= enough).drop("__n")


def in_boxes(reduced: DataFrame, metric, p: int) -> tuple[DataFrame, dict[int, Tree]]:
    """The donors with __box, a leaf of their group's tree; trees are grown on the driver from a sample that a hash of the id takes."""
    counts = {r["__g"]: r["count"] for r in reduced.groupBy("__g").count().collect()}
    total = sum(counts.values())
    size = max(BLOCK, -(-total // MAX_BOXES))
    share = min(1.0, SAMPLED / size, SAMPLE / max(1, total * p))
    hashed = F.pmod(F.xxhash64(F.lit("sampled"), "__id", "__g"), F.lit(1 << 30))
    rows = reduced.where(hashed < int(share * (1 << 30))).select("__g", "__x").orderBy("__g", "__x").toPandas()
    trees, boxes, leaf = {}, 0, max(1, round(size * share))
    for g in sorted(counts):
        x = _matrix(rows.loc[rows["__g"] == g, "__x"])
        trees[g] = Tree.grown(x, leaf, metric, boxes)
        boxes = int(trees[g].box.max()) + 1
    shared = reduced.sparkSession.sparkContext.broadcast(trees)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, g, box = _matrix(batch["__x"]), batch["__g"].to_numpy(), np.zeros(len(batch), dtype=np.int64)
            for k, tree in shared.value.items():
                box[g == k] = tree.boxes(x[g == k])
            yield batch.assign(__box=box)

    kind = reduced.schema["__id"].dataType.simpleString()
    return reduced.select("__g", "__id", "__x").mapInPandas(dealt, f"__g int, __id {kind}, __x array<double>, __box bigint"), trees


def boxes_of(celled: DataFrame, p: int) -> tuple[list[int], Boxes]:
    """The boxes' numbers and extents: one aggregate, at most a few times MAX_BOXES rows."""
    value = lambda j: F.nanvl(F.get("__x", F.lit(j)), F.lit(None).cast("double"))
    stats = [f(value(j)).alias(f"{name}{j}") for j in range(p) for name, f in (("l", F.min), ("h", F.max), ("n", F.count))]
    rows = celled.groupBy("__box").agg(F.count(F.lit(1)).alias("n"), *stats).orderBy("__box").collect()
    table = lambda name: np.array([[r[f"{name}{j}"] for j in range(p)] for r in rows], dtype=float).reshape(len(rows), p)
    n, seen = np.array([r["n"] for r in rows]), table("n")
    low, high = np.where(seen > 0, table("l"), 0.0), np.where(seen > 0, table("h"), 0.0)
    return [r["__box"] for r in rows], Boxes(low, high, seen == n[:, None], seen > 0, n)


def _met(asked: DataFrame, celled: DataFrame, counts: DataFrame, k: int, metric, compared) -> DataFrame:
    """__rid, __did, __dist: the best k of each recipient in each box it asks; many recipients of one box are dealt to several tasks."""
    dealt = counts.select(F.col("__box").alias("__at"), F.ceil(F.col("n") / ASKED).cast("int").alias("__parts"))
    left = asked.join(F.broadcast(dealt), asked["__box"] == dealt["__at"]).withColumn("__part", F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int")).drop("__at", "__parts")
    right = celled.join(F.broadcast(dealt), celled["__box"] == dealt["__at"]).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__at", "__parts", "__g")
    kind = asked.schema["__id"].dataType.simpleString()

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"__rid": left["__id"].iloc[:0], "__did": left["__id"].iloc[:0], "__dist": np.zeros(0)})]
        right = right.sort_values("__id", kind="stable")
        ids, b = right["__id"].to_numpy(), _matrix(right["__x"])
        step, last = max(1, CELLS // max(1, 4 * len(ids))), min(k, len(ids)) - 1
        for at in range(0, len(left) if len(ids) else 0, step):
            part = left.iloc[at : at + step]
            d = metric.between(_matrix(part["__x"]), b)
            d[np.isnan(d)] = np.inf
            # All donors up to the k-th distance, ties included; then the first k by distance and place, that is, by id.
            r, c = np.nonzero((d <= np.partition(d, last, axis=1)[:, last, None]) & np.isfinite(d))
            v = d[r, c]
            order = np.lexsort((c, v, r))
            r, c, v = r[order], c[order], v[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"__rid": part["__id"].to_numpy()[r[first]], "__did": ids[c[first]], "__dist": v[first]}))
        if compared is not None:
            compared.add(len(left) * len(right))
        return pd.concat(out[1:] or out)

    cells = ["__box", "__part"]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(best, f"__rid {kind}, __did {kind}, __dist double")


def nearest(recipients: DataFrame, donors: DataFrame, k: int, metric, *, exclude_self: bool = True, compared=None, keep=lambda df: df) -> DataFrame:
    """__rid, __did, __dist, __rank of the k nearest donors of each recipient; ties by donor id.

    Both frames hold __id (the same orderable type, unique) and __x (array<double>, NaN where missing). ``compared`` is an
    accumulator that counts the pairs whose distance is computed; ``keep`` cuts the lineage of what is read twice.
    """
    first_row = donors.select(F.size("__x").alias("p")).first()
    kind = recipients.schema["__id"].dataType.simpleString()
    if first_row is None:
        return recipients.select(F.col("__id").alias("__rid"), F.col("__id").alias("__did"), F.lit(0.0).alias("__dist"), F.lit(1).alias("__rank")).where(F.lit(False))
    p = first_row.p
    # With itself left out, a row needs one more row to find k others.
    enough = k + int(exclude_self)
    # Recipients with the same values are one, under the first of their ids.
    classes = keep(recipients.groupBy("__x").agg(F.min("__id").alias("__id")).select("__id", "__x"))
    groups, others_too = _groups(classes)
    celled, trees = in_boxes(keep(_reduced(donors.select("__id", "__x"), groups, others_too, enough, metric)), metric, p)
    celled = keep(celled)
    numbers, boxes = boxes_of(celled, p)
    numbers = np.array(numbers, dtype=np.int64)
    held = {g: np.flatnonzero(np.isin(numbers, tree.box[tree.box >= 0])) for g, tree in trees.items()}
    known_shapes = dict(zip(_seen(np.where(np.array(groups, dtype=bool).reshape(len(groups), p), 0.0, np.nan)), range(len(groups)), strict=True))
    shared = donors.sparkSession.sparkContext.broadcast((numbers, {g: (at, boxes.of(at)) for g, at in held.items()}, known_shapes))

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, Boxes, np.ndarray]]:
        """Recipients of one group, its boxes' numbers, the boxes, and the bounds."""
        numbers, held, shapes = shared.value
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.iloc[at : at + 2048]
                x = _matrix(some["__x"])
                g = np.array([shapes.get(shape, len(shapes)) for shape in _seen(x)])
                for one in np.unique(g):
                    if one in held:
                        mine, own = held[one]
                        yield some[g == one], numbers[mine], own, own.bounds(x[g == one], metric)

    def asks(some: pd.DataFrame, numbers: np.ndarray, r: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"__id": some["__id"].to_numpy()[r], "__x": some["__x"].to_numpy()[r], "__box": numbers[c]})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, numbers, own, bound in grouped(batches):
            order = np.argsort(bound, axis=1, kind="stable")
            before = np.cumsum(own.rows[order], axis=1) - own.rows[order]
            r, c = np.nonzero((before < enough) & np.isfinite(np.take_along_axis(bound, order, axis=1)))
            yield asks(some, numbers, r, order[r, c])

    asked = keep(classes.repartition("__id").mapInPandas(first, f"__id {kind}, __x array<double>, __box bigint"))
    ranked = Window.partitionBy("__rid").orderBy("__dist", "__did")
    top = lambda found: found.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= enough)
    near = keep(_met(asked, celled, asked.groupBy("__box").agg(F.count(F.lit(1)).alias("n")), enough, metric, compared))
    reach = top(near).groupBy("__rid").agg(F.max("__dist").alias("__reach"), F.count(F.lit(1)).alias("__found"))
    # A null reach leaves everything open: fewer neighbours than wanted were found.
    radius = F.when(F.col("__found") == enough, F.col("__reach"))
    known = asked.groupBy("__id").agg(F.collect_list("__box").alias("__done"))
    rest = classes.join(known, "__id").join(reach.select(F.col("__rid").alias("__id"), radius.alias("__radius")), "__id", "left")

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, numbers, _, bound in grouped(batches):
            radius = some["__radius"].to_numpy(dtype=float)
            open_ = np.isfinite(bound) & ~(bound > np.where(np.isnan(radius), np.inf, radius)[:, None])
            for i, done in enumerate(some["__done"]):
                open_[i, np.searchsorted(numbers, np.asarray(done, dtype=np.int64))] = False
            yield asks(some, numbers, *np.nonzero(open_))

    more = keep(rest.mapInPandas(others, f"__id {kind}, __x array<double>, __box bigint"))
    far = _met(more, celled, more.groupBy("__box").agg(F.count(F.lit(1)).alias("n")), enough, metric, compared)
    lists = top(near.unionByName(far)).groupBy("__rid").agg(F.sort_array(F.collect_list(F.struct("__dist", "__did"))).alias("__list"))
    of_class = classes.join(lists, classes["__id"] == lists["__rid"]).select(F.col("__x").alias("__like"), "__list")
    rows = recipients.join(of_class, recipients["__x"] == of_class["__like"]).select(F.col("__id").alias("__rid"), "__list")
    if exclude_self:
        rows = rows.select("__rid", F.filter("__list", lambda s: s["__did"] != F.col("__rid")).alias("__list"))
    placed = rows.select("__rid", F.posexplode(F.slice("__list", 1, k)).alias("__at", "__one"))
    return placed.select("__rid", F.col("__one.__did").alias("__did"), F.col("__one.__dist").alias("__dist"), (F.col("__at") + 1).alias("__rank"))


def vector(columns: list[Column]) -> Column:
    """Columns of doubles as one array, NaN where missing."""
    return F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in columns])
