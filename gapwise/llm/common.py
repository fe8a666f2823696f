"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs on one machine, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gapwise-"))
    return context.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so that later jobs neither recompute ``df`` nor lose it with an executor,
    and keeps column pruning, unlike ``checkpoint()``.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def look_up(rows: DataFrame, table: DataFrame, key: str, mass: str, *, parts: int = 256) -> DataFrame:
    """``rows`` with the columns that ``table`` has for their ``key``; nulls where it has none.

    ``table`` has every key once, with the number of its rows as ``mass``. Fewer than ``parts`` keys can hold more
    than one in ``parts`` of all rows: these are broadcast, so that their rows stay where they are; the others
    meet in a shuffle.
    """
    hot = F.col(mass) * parts > rows.count()
    known = F.broadcast(table.where(hot))
    cold = rows.join(known.select(key), key, "left_anti")
    return rows.join(known, key).unionByName(cold.join(table.where(~hot), key, "left"))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; an empty array without any."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(values: Column, block: int = 64) -> Column:
    """Inclusive running sums of an array, in two levels so that long arrays stay cheap."""

    def running(items: Column, start: Column) -> Column:
        grown = F.aggregate(items, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(grown, F.lit(2), F.greatest(F.size(grown) - 1, F.lit(0)))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        offsets = F.concat(F.array(F.lit(0).cast("bigint")), running(sums, F.lit(0).cast("bigint")))
        return let(offsets, lambda o: F.flatten(F.transform(blocks, lambda b, i: running(b, F.get(o, i)))))

    longs = values.cast("array<bigint>")
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
        lambda i: F.slice(longs, i * block + 1, F.lit(block)),
    )
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(let(cut, of_blocks))


def find_spans(text: Column, pattern: Column | str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>.

    Offsets are code points, the end exclusive; ``value`` is the group. The pieces between matches come
    from split(), which finds the same matches as regexp_extract_all().
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def of_matches(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = let(
            pieces,
            lambda p: F.transform(found, lambda m, i: F.length(F.get(p, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))),
        )
        values = F.regexp_extract_all(text, pattern, F.lit(group)) if group else found
        return let(
            F.struct(prefix_sums(steps).alias("at"), values.alias("value")),
            lambda s: F.transform(
                found,
                lambda m, i: F.struct(
                    F.get(s["at"], i).alias("start"),
                    (F.get(s["at"], i) + F.length(m)).alias("end"),
                    F.get(s["value"], i).alias("value"),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), of_matches)
