"""License scans: ordered signature rules behind keyword prefilters, with containment suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import LOWER, UPPER, find_spans, let, load, text_or_empty
from gapwise.llm.license_rules import Signature, signatures

#: Fixed phrases and their labels: found where their words stand consecutively.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


#: Letters and digits stay, in lower case; any other ASCII character separates words.
OTHERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Keywords that end within a word, by all words they may end with; of any other the longest word counts.
OPEN_ENDS = {
    " gpl": ["gpl", "gplv2", "gplv3"],
    " lgpl": ["lgpl", "lgplv2", "lgplv3"],
    " agpl": ["agpl", "agplv3"],
    " beer": ["beer", "beerware"],
}


def trigger_words(rule: Signature) -> list[str]:
    """Words of which every text that the rule matches holds one, as it contains the keyword."""
    return OPEN_ENDS.get(rule.keyword) or [max(rule.keyword.split(), key=len)]


def _rules() -> Column:
    fields = lambda k, r: F.struct(
        F.lit(k).alias("rank"), F.lit(r.label).alias("label"), F.array(*[F.lit(w) for w in trigger_words(r)]).alias("words"), F.lit(r.keyword).alias("keyword"),
        F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"),
    )
    return F.array(*[fields(k, r) for k, r in enumerate(signatures())])


def _detections(joined: Column, present: Column) -> Column:
    """All matches of the rules whose keyword occurs, by start and then the widest and the strongest first; ``present`` are the trigger words found."""
    hits = F.transform(
        F.filter(F.filter(_rules(), lambda r: F.arrays_overlap(r["words"], present)), lambda r: F.contains(joined, r["keyword"])),
        lambda r: F.transform(
            find_spans(joined, r["pattern"]),
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("minus_end"), r["priority"].alias("priority"),
                r["rank"].alias("rank"), r["label"].alias("label"), r["score"].alias("score"),
            ),
        ),
    )
    return F.sort_array(F.flatten(hits))


def _kept(cluster: Column) -> Column:
    """Of detections that hang together: from the strongest on, each stays unless it overlaps a stronger one that stays or lies in an equal one that stays."""
    ranked = F.sort_array(F.transform(cluster, lambda d: F.struct(*[d[c].alias(c) for c in ("priority", "start", "minus_end", "rank", "label", "score")])))

    def step(kept: Column, d: Column) -> Column:
        felled = F.exists(
            kept,
            lambda k: ((k["priority"] < d["priority"]) & (k["start"] < -d["minus_end"]) & (d["start"] < -k["minus_end"]))
            | ((k["priority"] == d["priority"]) & (k["start"] <= d["start"]) & (k["minus_end"] <= d["minus_end"])),
        )
        return F.when(felled, kept).otherwise(F.concat(kept, F.array(d)))

    return F.when(F.size(cluster) < 2, ranked).otherwise(let(ranked, lambda r: F.aggregate(r, F.slice(r, F.lit(1), F.lit(0)), step)))


def _resolved(detections: Column) -> Column:
    """Labels and the best score of what is left.

    One sweep in order of start cuts the detections where none is open any more; only those between two cuts can overlap, so
    each such cluster is resolved by itself.
    """
    none = F.slice(detections, F.lit(1), F.lit(0))
    start = F.struct(none.alias("open"), F.lit(0).cast("bigint").alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def settled(acc: Column, closed: Column, open_: Column, end: Column) -> Column:
        of = lambda kept: F.struct(
            open_.alias("open"), end.alias("end"), F.array_union(acc["labels"], F.transform(kept, lambda x: x["label"])).alias("labels"),
            F.greatest(acc["score"], F.coalesce(F.array_max(F.transform(kept, lambda x: x["score"])), F.lit(0.0))).alias("score"),
        )
        return let(_kept(closed), of)

    def step(acc: Column, d: Column) -> Column:
        grown = F.struct(F.concat(acc["open"], F.array(d)).alias("open"), F.greatest(acc["end"], -d["minus_end"]).alias("end"), acc["labels"].alias("labels"), acc["score"].alias("score"))
        return F.when(d["start"] < acc["end"], grown).otherwise(settled(acc, acc["open"], F.array(d), -d["minus_end"]))

    return F.aggregate(detections, start, step, lambda acc: let(settled(acc, acc["open"], none, F.lit(0).cast("bigint")), lambda x: F.struct(x["labels"], x["score"])))


def _places(joined: Column, phrase: str) -> Column:
    """The first and last start of a phrase in words, and the number of its places.

    ``joined`` holds the words with one space before, between and after them. A place's start is the
    number of spaces up to it.
    """
    spaces = lambda text: F.length(text) - F.length(F.translate(text, " ", ""))
    pieces = F.split(joined, f"(?<= ){phrase}(?= )", -1)
    of = lambda p: F.struct(
        (F.size(p) - 1).cast("bigint").alias("n"),
        F.when(F.size(p) > 1, spaces(F.get(p, F.lit(0))) - 1).cast("bigint").alias("first"),
        F.when(F.size(p) > 1, spaces(joined) - spaces(F.element_at(p, -1)) - len(phrase.split(" "))).cast("bigint").alias("last"),
    )
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"))
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), let(pieces, of)).otherwise(none)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The text's words (digits, letters, anything beyond ASCII) are joined by single spaces, so that rules
    needn't know punctuation or line breaks. Everything happens within a row, without a shuffle; a rule
    runs only where its keyword occurs, which every text that it matches contains. score is the best of the surviving rules, at least 0.8
    with a base phrase, 0 without any label. Defined results: a null text is empty; a repeated row is
    scanned as often as it occurs; an empty table gives an empty result; other columns are ignored.
    """
    text = F.btrim(F.translate(text_or_empty(text_col), UPPER + OTHERS, LOWER + " " * len(OTHERS)))
    words = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " +"))
    triggers = F.array(*[F.lit(w) for w in sorted({w for r in signatures() for w in trigger_words(r)})])
    given = F.struct(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("joined"), F.size("words").cast("bigint").alias("n_words"), F.array_intersect("words", triggers).alias("present"))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).select("doc_id", given.alias("g"))

    def scanned(g: Column) -> Column:
        joined = g["joined"]
        places = F.array(*[_places(joined, phrase) for phrase, _ in PHRASES])
        nothing = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
        found = F.when(F.size(g["present"]) > 0, _resolved(_detections(joined, g["present"]))).otherwise(nothing)
        return F.struct(g["n_words"].alias("n_words"), places.alias("places"), found.alias("found"))

    labels = F.array(*[F.lit(label) for _, label in PHRASES])
    base = F.filter(F.transform("m.places", lambda p, i: F.when(p["n"] > 0, F.get(labels, i))), lambda x: x.isNotNull())
    joined_sorted = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    out = rows.select("doc_id", let(F.col("g"), scanned).alias("m")).withColumn("base", base)
    return out.select(
        "doc_id",
        "m.n_words",
        F.aggregate("m.places", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("m.places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("m.places", lambda p: p["last"])).alias("last_word"),
        joined_sorted(F.col("base")).alias("base_labels"),
        joined_sorted(F.concat("base", "m.found.labels")).alias("labels"),
        F.greatest("m.found.score", F.when(F.size("base") > 0, 0.8).otherwise(0.0)).alias("score"),
    )


def op5_license_rules(spark, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))
