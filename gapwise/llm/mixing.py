"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import load, staged, text_or_empty

#: Means above this are drawn as sums of equal parts, so that exp(-mean) doesn't underflow.
PART = 500
#: The rates of so many sources at most are broadcast (about 7 kB each); more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 2000


def _uniform(seed: str, *parts: Column) -> Column:
    """52 bits of an MD5 over the seed and the parts, as a double in [0, 1)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, *, source_col: str = "source", text_col: str = "text", volume: float = 1.0) -> DataFrame:
    """One row per source: __source, rate, parts, cdf.

    A document's mass is its code points plus one. ``rate`` is the source's target mass over its mass, so
    it is the mean number of times a document of the source occurs; ``cdf`` holds the Poisson distribution
    function of ``rate / parts``. Sources without a weight in ``weights`` get none; without ``weights`` all
    sources weigh the same.
    """
    mass = (F.length(text_or_empty(text_col)) + 1).cast("bigint")
    stats = staged(docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(mass).alias("mass")), "mix")
    if weights is None:
        stats = stats.withColumn("weight", F.lit(1.0))
    else:
        table = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(table, "__s string, weight double")
        stats = stats.join(given, stats["__source"].eqNullSafe(given["__s"]), "left").drop("__s").fillna(0.0, ["weight"])
    total = stats.agg(F.sum("mass"), F.sum("weight")).first()
    all_mass, all_weight = float(total[0] or 0), float(total[1] or 0) or 1.0
    rate = F.col("weight") / F.lit(all_weight) * F.lit(all_mass * volume) / F.col("mass")
    return (
        stats.select("__source", rate.alias("rate"))
        .withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
        .withColumn("mean", F.col("rate") / F.col("parts"))
        .withColumn(
            "cdf",
            F.expr(
                """aggregate(sequence(1, cast(ceil(mean + 12 * sqrt(mean) + 30) as int)),
                     named_struct('p', exp(-mean), 'sums', array(exp(-mean))),
                     (a, k) -> named_struct('p', a.p * mean / k, 'sums', concat(a.sums, array(element_at(a.sums, -1) + a.p * mean / k))),
                     a -> a.sums)"""
            ),
        )
        .drop("mean")
    )


def replicated(docs: DataFrame, weights: Mapping[str, float] | None = None, *, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", volume: float = 1.0) -> DataFrame:
    """(row, rate, copy, place): each row of ``docs``, as a struct, as often as its draw says; shuffled globally.

    Copies go to partitions by the hash of place, a hash of the seed, the id and the copy, and are sorted by it there.
    """
    rates = source_rates(docs, weights, source_col=source_col, text_col=text_col, volume=volume)
    if rates.count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("of"))
    joined = rows.join(rates, rows["of"].eqNullSafe(rates["__source"]))
    draw = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1),
        F.lit(0),
        lambda total, part: total + F.size(F.filter("cdf", lambda c: c <= _uniform(seed, F.col("id"), part))),
    )
    one = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    counted = joined.withColumn("u", _uniform(seed, F.col("id"), F.lit(0))).withColumn("n", F.when(F.col("parts") == 1, one).otherwise(draw))
    copies = counted.select("row", "id", "rate", F.explode(F.expr("if(n > 0, sequence(0, n - 1), cast(array() as array<int>))")).alias("copy"))
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce("id", F.lit("null")), F.col("copy").cast("string")))
    placed = copies.select("row", "rate", "copy", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("place"))
    return placed.repartition("place").sortWithinPartitions("place")


def poisson_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs``, each as often as its draw says, in a global shuffle.

    A document's count inverts the Poisson distribution of its source's rate at a uniform that only the
    seed and the id decide: the same on every run and under any partitioning. Defined results: a null text
    has mass 1; a null source is a source of its own; rows that repeat an id draw the same count; null ids
    share one draw; an empty table gives an empty result; all columns of ``docs`` are kept, whatever their
    names.
    """
    return replicated(docs, weights, **options).select("row.*")


def op4_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """All sources at equal weights: doc_id, source, rate, copy, shuffle_key."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = replicated(docs)
    return mixed.select("row.doc_id", "row.source", F.round("rate", 9).alias("rate"), "copy", F.col("place").alias("shuffle_key"))


SQL = r"""
WITH mass AS (
  SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS m FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM mass)::DOUBLE * (SELECT sum(m) FROM mass) / m AS rate FROM mass
), terms AS (
  SELECT source, rate, k,
         sum(exp(-rate) * CASE WHEN k = 0 THEN 1.0 ELSE list_product(list_transform(range(1, k + 1), lambda j: rate / j)) END)
           OVER (PARTITION BY source ORDER BY k) AS upto
  FROM rates, (SELECT unnest(range(0, 200)) AS k)
), draws AS (
  SELECT doc_id, source, ('0x' || substr(md5('mix-1:' || doc_id || ':0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents
), counts AS (
  SELECT d.doc_id, d.source, t.rate, count(*) FILTER (WHERE t.upto <= d.u) AS n
  FROM draws d JOIN terms t ON t.source IS NOT DISTINCT FROM d.source WHERE t.k <= t.rate + 30 + 12 * sqrt(t.rate)
  GROUP BY ALL
)
SELECT doc_id, source, round(rate, 9) AS rate, copy::INTEGER AS copy,
       ('0x' || substr(md5('mix-1/' || doc_id || '/' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT doc_id, source, rate, unnest(range(0, n)) AS copy FROM counts)
"""
