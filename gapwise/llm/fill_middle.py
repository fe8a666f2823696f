"""Fill-in-middle transformation: texts cut at two drawn unit boundaries and put into another order."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import load, text_or_empty

#: What a cut may lie between: runs of ASCII letters, and every other code point.
UNITS = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = regex.compile("<[PSM]>")
SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def draws(seed: str, name: str) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that the seed and the document's name decide."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def rearranged(text: str, h: tuple[int, ...], plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix code points, middle code points, output) of one text.

    The ends of all units are held as four bytes each, so a cut is one lookup and the text is sliced, never split.
    """
    ends = array("I", (m.end() for m in UNITS.finditer(text)))
    n = len(ends)
    if not n or h[2] % 100 >= 100 - plain_percent or SENTINELS.search(text):
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    low, high = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < spm_percent:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``rearranged`` was given. Parts hold no sentinel, and none can arise where parts meet."""
    if form == "plain":
        return output
    (outer, inner) = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    front, _, middle = output[len(outer) :].partition(MIDDLE)
    one, _, two = front.partition(inner)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def transform(seed: str, plain_percent: int, spm_percent: int, keep_output: bool) -> Callable[[Column, Column], Column]:
    """The Arrow-batched function (id as text, text) -> SCHEMA; without ``keep_output`` only the digests leave Python."""

    @F.pandas_udf(SCHEMA)
    def apply(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for name, text in zip(names, texts, strict=True):
            n, form, low, middle, output = rearranged(text, draws(seed, name), plain_percent, spm_percent)
            rows.append((n, form, low, middle, output if keep_output else None, _sha256(output), _sha256(restored(output, form))))
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(7)]
        kinds = ("int64", "object", "Int64", "Int64", "object", "object", "object")
        return pd.DataFrame({c.split()[0]: pd.Series(v, dtype=kind) for c, v, kind in zip(SCHEMA.split(", "), columns, kinds, strict=True)})

    return apply


def fill_in_middle(docs: DataFrame, *, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, keep_output: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    A text is cut at two unit boundaries that a SHA-256 of the seed and the id draws; ``output`` has its parts in the
    order prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind sentinels, or is the text itself (plain).
    No row moves: this is one projection in Arrow batches, and a task holds one batch and the offsets of one text.
    Defined results: a null text counts as empty and is plain; a text that holds a sentinel is plain, so that every
    output can be told apart and restored; a null id draws as the empty name; rows that repeat an id and text get the
    same output; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    done = transform(seed, plain_percent, spm_percent, keep_output)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", done("name", "text").alias("r")).select("doc_id", "r.*")


def restore(outputs: DataFrame, *, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``outputs`` with the rebuilt ``text``; null where the output is."""

    @F.pandas_udf("string")
    def apply(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(o, f) for o, f in zip(output, form, strict=True)], dtype="object")

    return outputs.withColumn("text", apply(F.col(output_col), F.col(form_col)))


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    """The digests prove the output and its restoration; the texts themselves stay in the tasks."""
    return fill_in_middle(load(spark, sf_dir, "documents"), keep_output=False).drop("output")


SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS c4
  FROM hashed
), cut AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR c3 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[1:least(c1, c2)], ''), '') AS prefix,
         coalesce(array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS middle,
         coalesce(array_to_string(units[greatest(c1, c2) + 1:], ''), '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
