"""Missingness of a stream: per-window counts that append once the watermark has passed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapwise.functions import nullity


def windowed_missing(stream: DataFrame, time_col: str, *, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", columns: Sequence[str] | None = None, missing_values: Iterable[object] | None = None) -> DataFrame:
    """start, end, variable, n_rows, n_miss, pct_miss per event-time window; works on batches too.

    Rows later than ``delay`` are left out of a stream's closed windows. State: two counters per column and open window.
    """
    columns = [c for c in columns or stream.columns if c != time_col]
    timed = stream.withColumn(time_col, nullity.column(time_col).cast("timestamp"))
    rows = timed.withWatermark(time_col, delay).groupBy(F.window(time_col, window, slide).alias("w"))
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(nullity.miss(stream, c, missing_values)).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("n_miss")) for i, c in enumerate(columns)])
    out = wide.select("w.start", "w.end", F.col("n").alias("n_rows"), F.explode(cells).alias("c"))
    return out.select("start", "end", "c.variable", "n_rows", "c.n_miss", nullity.percent(F.col("c.n_miss"), F.col("n_rows")).alias("pct_miss"))


def fill_stream(stream: DataFrame, values: dict[str, object]) -> DataFrame:
    """Apply learned fill values to a stream: a stateless projection."""
    from gapwise.operators.fill import apply_fill

    return apply_fill(stream, values)


def write_parquet(df: DataFrame, path: str, checkpoint: str, *, trigger: str | None = None) -> StreamingQuery:
    """Append to Parquet exactly once; all that is there is read and the query ends, unless a trigger time is given."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
