"""Sums of arrays that tasks have counted, added up in a tree on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a task sends for each slice of its array.
PARTS = "slice int, task int, part binary"
SLICE_BYTES = 1 << 18


def sliced(array: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    """The rows of PARTS that hold ``array``; slices of zeros alone are left out."""
    step = SLICE_BYTES // array.itemsize
    for k in range(0, len(array), step):
        some = array[k : k + step]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([task], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["slice", "task", "part"])


def tree_sum(parts: DataFrame, size: int, dtype, tasks: int, *, cap: int | None = None, finish: Callable[[np.ndarray], np.ndarray] = lambda a: a, fan: int = 32) -> np.ndarray:
    """The sum of the arrays of ``size`` numbers that ``tasks`` tasks have sent as PARTS, at most ``cap`` in each place.

    Each step adds up to ``fan`` slices, so a task holds as many at once and the last step has one row per slice. ``finish`` is
    applied to each slice before it leaves for the driver and must give one item per number, or per eight of them.
    """
    kind = np.dtype(dtype)

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(p.as_buffer(), dtype=kind).astype(np.int64) for p in table.column("part")), np.int64(0))
        total = (total if cap is None else np.minimum(total, cap)).astype(kind)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    def once(tables):
        for batch in tables:
            done = [finish(np.frombuffer(p.as_buffer(), dtype=kind)).tobytes() for p in batch.column("part")]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("task"), pa.array(done, pa.binary())], names=["slice", "task", "part"])

    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("slice", "task").applyInArrow(added, PARTS)
        tasks = -(-tasks // fan)
        if tasks <= 1:
            break
    step, blank = SLICE_BYTES // kind.itemsize, {}
    found = {r.slice: r.part for r in parts.mapInArrow(once, PARTS).collect()}
    out = []
    for k in range(-(-size // step)):
        n = min(step, size - k * step)
        if k not in found and n not in blank:
            blank[n] = finish(np.zeros(n, dtype=kind)).tobytes()
        out.append(found.get(k, blank.get(n)))
    result_kind = finish(np.zeros(8, dtype=kind)).dtype
    return np.frombuffer(b"".join(out), dtype=result_kind)
