"""Quality rules: a decision list learned by sequential covering, applied as one conditional expression.

Everything on the main path is a DataFrame operation. The driver sees one row per grow step, the best condition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import SPACE_CHARS, UPPER, let, load, split_words, staged, text_or_empty

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
#: One translation leaves a mark for each symbol, digit and capital and drops the other ASCII characters.
MARKS = {SYMBOLS: "#", DIGITS: "0", UPPER: "A"}
DROPPED = "".join(sorted({chr(c) for c in range(1, 128)} - set("".join(MARKS))))
FEATURES = (
    "n_words", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio",
    "distinct_ratio", "digit_ratio", "upper_ratio", "line_words", "stop_ratio",
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are compared by 64-bit hashes within one text: for a text of a million words the chance of
    one collision is below 1e-7.
    """

    def of_hashes(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("at"))
        covered = F.aggregate(
            starts,
            first,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(windows, of_hashes))


def measured(docs: DataFrame, *, text_col: str = "text") -> Column:
    """A struct of the base counts and what the features need, from the whole text."""
    text = text_or_empty(text_col)
    marks = F.translate(text, "".join(MARKS) + DROPPED, "".join(mark * len(chars) for chars, mark in MARKS.items()))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    n = lambda c: c.cast("bigint")
    of = lambda x, chars: n(F.length(x) - F.length(F.translate(x, MARKS[chars], "")))
    counted = let(marks, lambda x: F.struct(of(x, SYMBOLS).alias("n_symbols"), of(x, DIGITS).alias("n_digits"), of(x, UPPER).alias("n_upper")))
    lined = let(lines, lambda x: F.struct(n(F.size(x)).alias("n_lines"), n(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    worded = let(
        split_words(text),
        lambda w: F.struct(
            n(F.size(w)).alias("n_words"),
            n(F.length(F.array_join(w, ""))).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            n(F.size(F.array_distinct(w))).alias("n_distinct"),
            n(F.size(F.filter(w, lambda x: F.length(x) <= 3))).alias("n_short"),
        ),
    )
    places = {
        "w": ("n_words", "word_chars", "n_repeat_words", "n_distinct", "n_short"),
        "c": ("n_symbols", "n_digits", "n_upper"),
        "l": ("n_lines", "n_dup_lines"),
    }
    side_by_side = lambda m: F.struct(*[m[part][name].alias(name) for part, names in places.items() for name in names])
    return let(F.struct(worded.alias("w"), counted.alias("c"), lined.alias("l")), side_by_side)


def derived(m: Column) -> dict[str, Column]:
    """FEATURES and base_failed from the fields of ``measured``."""
    part = lambda a, b: m[a] / F.greatest(m[b], F.lit(1))
    return {
        "n_words": m["n_words"],
        "mean_word_chars": part("word_chars", "n_words"),
        "symbol_ratio": part("n_symbols", "word_chars"),
        "dup_line_ratio": part("n_dup_lines", "n_lines"),
        "repeat_ratio": part("n_repeat_words", "n_words"),
        "distinct_ratio": part("n_distinct", "n_words"),
        "digit_ratio": part("n_digits", "word_chars"),
        "upper_ratio": part("n_upper", "word_chars"),
        "line_words": part("n_words", "n_lines"),
        "stop_ratio": part("n_short", "n_words"),
        "base_failed": (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"]),
    }


@dataclass
class Rule:
    """A conjunction of (feature, operator, threshold); documents that meet it are rejected."""

    conditions: list[tuple[str, str, float]]
    precision: float

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        test = F.lit(True)
        for name, op, bound in self.conditions:
            test = test & (of(name) >= bound if op == ">=" else of(name) < bound)
        return test

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {b:.6g}" for n, op, b in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does. ``of`` gives a feature by name."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(of), k) if out is None else out.when(rule.column(of), k)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join(f"{k}: reject if {r} (precision {r.precision:.3f})" for k, r in enumerate(self.rules, 1))


def _best(rows: DataFrame, min_support: int) -> tuple[str, str, float] | None:
    """The condition (feature, operator, threshold) of the largest information gain on ``rows`` (FEATURES, bad).

    Every place between two values of a feature is a candidate threshold: running sums of bad and good rows
    along each feature's distinct values give both sides of all of them in one job.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).cast("double").alias("v")) for k, c in enumerate(FEATURES)])
    counts = rows.select("bad", F.explode(cells).alias("x")).groupBy("x.f", "x.v").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    along, whole = Window.partitionBy("f").orderBy("v"), Window.partitionBy("f")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_below": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in "pn"} | {f"{c}_all": F.sum(c).over(whole) for c in "pn"}
    cut = counts.withColumns(sums | {"bound": (F.col("v") + F.lag("v").over(along)) / 2}).where(F.col("bound").isNotNull())
    sides = [
        F.struct(F.lit(">=").alias("op"), (F.col("p_all") - F.col("p_below")).alias("p"), (F.col("n_all") - F.col("n_below")).alias("n")),
        F.struct(F.lit("<").alias("op"), F.col("p_below").alias("p"), F.col("n_below").alias("n")),
    ]
    tried = cut.select("f", "bound", "p_all", "n_all", F.explode(F.array(*sides)).alias("s")).where(F.col("s.p") >= max(1, min_support))
    share = lambda p, n: F.log2(p / (p + n))
    gain = F.col("s.p") * (share(F.col("s.p"), F.col("s.n")) - share(F.col("p_all"), F.col("n_all")))
    best = tried.select(F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), F.col("s.op").alias("op"), (-F.col("bound")).alias("bound")).alias("x"))
    top = best.where("x.gain > 1e-9").agg(F.max("x").alias("x")).first()["x"]
    return None if top is None else (FEATURES[-top.f], top.op, -top.bound)


def learn(labelled: DataFrame, *, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.9, min_support: int = 2) -> DecisionList:
    """Sequential covering over ``labelled`` (FEATURES, bad boolean, prune boolean).

    Each rule grows on the rows without ``prune`` by the condition of the largest information gain, is cut
    back to the prefix that is best on the rows with ``prune``, and joins the list if there it covers
    ``min_support`` rows at ``min_precision``. Rows that a rule covers are set aside for the next, so that
    thresholds are sought anew for each rule. One aggregate job per condition scans the labelled rows.
    """
    found = DecisionList()
    for _ in range(max_rules):
        left = labelled.where(found.column() == 0)
        rule = Rule([], 0.0)
        while len(rule.conditions) < max_conditions:
            best = _best(left.where(rule.column() & ~F.col("prune")), min_support)
            if best is None:
                break
            rule.conditions.append(best)
        if not rule.conditions:
            break
        prefixes = [Rule(rule.conditions[: k + 1], 0.0) for k in range(len(rule.conditions))]
        held = left.where("prune").agg(
            *[F.count_if(r.column() & (F.col("bad") == bad)).alias(f"c{k}_{int(bad)}") for k, r in enumerate(prefixes) for bad in (True, False)]
        ).first()
        for k, r in enumerate(prefixes):
            p, n = held[f"c{k}_1"], held[f"c{k}_0"]
            r.precision = p / (p + n) if p >= min_support else 0.0
        chosen = max(prefixes, key=lambda r: r.precision)
        if chosen.precision < min_precision:
            break
        found.rules.append(chosen)
    return found


def sampled_labels(labels: DataFrame, sample: int, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(__id, bad, prune) of about ``sample`` labelled ids, chosen by a hash over all; an id labelled twice is bad if any label says so."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) <= 0).alias("bad"))
    share = F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1 << 30)) / float(1 << 30)
    return one.where(share * max(1, one.count()) < sample).withColumn("prune", F.pmod(F.xxhash64(F.lit("prune"), "__id"), F.lit(3)) == 0)


def quality_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), measured(docs, text_col=text_col).alias("m"))
    return rows.select("doc_id", "m.*", *[c.alias(k) for k, c in derived(F.col("m")).items() if k != "n_words"])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DecisionList:
    """Learn from the sampled labels whose texts pass the base rules; an id is learned from once, however often it occurs.

    The sampled labels are broadcast, as ``sample`` bounds them; only the texts they name are measured and none is
    shuffled.
    """
    chosen = sampled_labels(labels, sample, id_col=id_col, label_col=label_col)
    known = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    known = known.select("__id", "bad", "prune", measured(known, text_col="__text").alias("m"))
    features = F.struct(*[c.alias(k) for k, c in derived(F.col("m")).items()], "bad", "prune")
    once = known.groupBy("__id").agg(F.min(features).alias("r")).select("r.*").where(~F.col("base_failed"))
    return learn(staged(once, "quality-train"), **options)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, base counts, base_failed, kept, rule (0 if no learned rule fires).

    Learns from about ``sample`` labelled ids (see ``fit``), chosen by a hash over all labels, and judges every row.
    Defined results: a null text has no words and fails the base rules; without labels only the base rules
    decide; labels of unknown or null ids are ignored; a repeated row is judged as often as it occurs;
    an empty table gives an empty result; other columns are ignored.
    """
    rules = fit(docs, labels, id_col=id_col, text_col=text_col, **options)

    def judged(m: Column) -> Column:
        found = F.struct(*[c.alias(k) for k, c in derived(m).items()])
        verdict = let(found, lambda f: F.struct(f["base_failed"].alias("base_failed"), rules.column(lambda name: f[name]).alias("rule")))
        return F.struct(m.alias("m"), verdict.alias("v"))

    out = docs.select(F.col(id_col).alias("doc_id"), let(measured(docs, text_col=text_col), judged).alias("r"))
    return out.select(
        "doc_id", "r.m.n_words", "r.m.word_chars", "r.m.n_symbols", "r.m.n_dup_lines", "r.m.n_repeat_words", "r.v.base_failed",
        (~F.col("r.v.base_failed") & (F.col("r.v.rule") == 0)).alias("kept"), "r.v.rule",
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns; the verdict measures each text once."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col, **options)

    def good(m: Column) -> Column:
        found = F.struct(*[c.alias(k) for k, c in derived(m).items()])
        return let(found, lambda f: ~f["base_failed"] & (rules.column(lambda name: f[name]) == 0))

    return docs.where(let(measured(docs, text_col=text_col), good))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
