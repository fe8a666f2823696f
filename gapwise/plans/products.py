"""Cross products of many columns: matrices added up by tasks, then cell by cell."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20


def cross_products(df: DataFrame, x: Sequence[Column], weight: Column | None = None, by: Column | None = None) -> dict:
    """{group: (rows, X'WX)} of the columns ``x``, nulls as 0; the only key is None without ``by``.

    The plan is of one size however many columns there are. A task multiplies batch by batch and passes on one triangle per
    group; the cells of these are summed by a grouping with partial sums, so no group of rows meets in one place. The driver
    takes p^2 / 2 numbers per group.
    """
    p = len(x)
    upper = np.triu_indices(p)
    rows = df.select(
        (by if by is not None else F.lit(0)).alias("g"),
        (weight.cast("double") if weight is not None else F.lit(1.0)).alias("w"),
        F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in x]).alias("x"),
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list] = {}

        def passed() -> pa.RecordBatch:
            names = pa.array(list(held), kind)
            sums = [np.append(m[upper], float(n)) for n, m in held.values()]
            held.clear()
            return pa.record_batch({"g": names, "s": pa.array(sums, pa.list_(pa.float64()))})

        kind = None
        for batch in batches:
            kind = batch.column("g").type
            codes = batch.column("g").dictionary_encode(null_encoding="encode")
            of, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            values = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, p)
            weights = batch.column("w").to_numpy(zero_copy_only=False)
            for i, name in enumerate(names):
                mine = slice(None) if len(names) == 1 else of == i
                z = values[mine]
                old = held.setdefault(name, [0, np.zeros((p, p))])
                old[0] += len(z)
                old[1] += (z * weights[mine][:, None]).T @ z
            if len(held) * 8 * p * p > HELD_BYTES:
                yield passed()
        if held:
            yield passed()

    kind = rows.schema["g"].dataType.simpleString()
    sums = rows.mapInArrow(partial, f"g {kind}, s array<double>")
    cells = sums.select("g", F.posexplode("s").alias("cell", "v")).groupBy("g", "cell").agg(F.sum("v").alias("v")).toArrow()
    groups, at, values = cells.column("g").to_pylist(), cells.column("cell").to_numpy(), cells.column("v").to_numpy()
    flat: dict[object, np.ndarray] = {}
    for g, i, v in zip(groups, at, values, strict=True):
        flat.setdefault(g, np.zeros(len(upper[0]) + 1))[i] = v
    out = {}
    for g, s in flat.items():
        m = np.zeros((p, p))
        m[upper] = s[:-1]
        out[None if by is None else g] = (int(s[-1]), m + np.triu(m, 1).T)
    return out
