"""Exact deduplication: a 128-bit content hash groups the rows, a byte comparison splits collisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import SPACE_CLASS, load, text_or_empty


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_fn: Callable[[Column], Column], carry: list[Column]) -> DataFrame:
    body = F.regexp_replace(text_or_empty(text_col), f"{SPACE_CLASS}+", " ")
    rows = docs.select(F.col(id_col).alias("__id"), body.alias("__body"), *carry)
    return rows.withColumns({"__hash": hash_fn(F.col("__body")), "__sha": F.unhex(F.sha2("__body", 256))})


def text_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per distinct normalised text: __hash, __sha, keep_id, group_size.

    Rows meet by the 128-bit hash; the text is a grouping key beside it, so the aggregate compares bytes
    within each hash and a collision gives two classes. Copies are combined before the shuffle: one text
    held by a third of all rows is sent once by each task. The SHA-256 names a class from then on, so
    that the texts needn't be shuffled again.
    """
    keyed = _keyed(docs, id_col, text_col, hash_fn, [])
    classes = keyed.groupBy("__hash", "__body").agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return classes.select("__hash", F.unhex(F.sha2("__body", 256)).alias("__sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_fn: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space. The smallest
    id of a class stays. Defined results: a null text counts as empty; a class whose ids are all null has
    keep_id null and its rows stay; a null id beside others never stays; rows that repeat an id with the
    same text are one document, reported as often as they occur with the same verdict; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    keyed = _keyed(docs, id_col, text_col, hash_fn, []).drop("__body")
    joined = keyed.join(text_classes(docs, id_col=id_col, text_col=text_col, hash_fn=hash_fn), ["__hash", "__sha"])
    return joined.select(
        F.col("__id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    packed = _keyed(docs, id_col, text_col, F.md5, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")]).drop("__body")
    classes = text_classes(docs, id_col=id_col, text_col=text_col)
    # Only ids that stay reach the join, so each text is moved at most once.
    stays = classes.withColumnRenamed("keep_id", "__keep").drop("group_size")
    joined = packed.join(stays, (packed["__hash"] == stays["__hash"]) & (packed["__sha"] == stays["__sha"]) & packed["__id"].eqNullSafe(stays["__keep"]), "left_semi")
    return joined.select("__row.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


SQL = r"""
WITH normalised AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM normalised
"""
