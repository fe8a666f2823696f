"""Secret scans: candidates by pattern, told apart by how many owners hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import find_spans, load, look_up, staged, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (keyword prefilter, pattern, group of the value, least length of the value); base kinds first.
BASE = {
    "assign": (r"(?i)passw|secret|token|api_?key", ASSIGN, 2, 6),
    "access": (r"AKIA", r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24}", r"[0-9a-f]+", 0, 24),
}
MORE = {
    "forge": (r"gh[pousr]_", r"\bgh[pousr]_[A-Za-z0-9]+", 0, 24),
    "jwt": (r"eyJ", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?", 0, 24),
    "chat": (r"xox[abprs]-", r"\bxox[abprs]-[A-Za-z0-9-]+", 0, 16),
    "payment": (r"[rs]k_(?:live|test)_", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]+", 0, 20),
    "cloud": (r"AIza", r"\bAIza[A-Za-z0-9_-]+", 0, 39),
    "pem": (r"-----BEGIN ", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 27),
    "bearer": (r"(?i)bearer ", r"(?i)\bbearer\x20+([A-Za-z0-9._~+/-]+)", 1, 16),
    "login": (r"://[^\s/:@]+:[^\s/:@]+@", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/:@]+)@", 1, 6),
}
KINDS = (*BASE, *MORE)


def _candidates(text: Column, kinds: dict) -> Column:
    """array<struct<start, rank, end, value>>: matches long enough, of all kinds; regexes run only behind their keyword."""
    empty = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, value: string>>")

    def of_kind(kind: str, keyword: str, pattern: str, group: int, least: int) -> Column:
        spans = F.filter(find_spans(text, pattern, group), lambda s: F.length(s["value"]) >= least)
        rank = F.lit(KINDS.index(kind))
        shaped = F.transform(spans, lambda s: F.struct(s["start"], rank.alias("rank"), s["end"], F.md5(s["value"]).alias("value")))
        return F.when(text.rlike(keyword), shaped).otherwise(empty)

    return F.concat(*[of_kind(kind, *spec) for kind, spec in kinds.items()])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Spans are kind:start:end in code points, the end exclusive. The base kinds are always reported. A
    candidate of another kind is added if its value is live-looking: held by at most ``max_owners``
    distinct owners and ``max_repositories`` repositories over the whole corpus; values that many hold are
    copied examples. n_live and n_copied count all candidates of a document by that verdict. Owners are counted per value
    hash after (value, owner, repository) rows are made distinct, with partial aggregates before each
    shuffle, so a value in a third of all documents costs one row per task. Defined results: a null text is
    empty; a null owner or repository, or a null in either's parts, counts as a value of its own; each row is reported separately, repeated
    or not; an empty table gives an empty result; other columns are ignored.
    """
    repository = F.col("source") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    text = text_or_empty(text_col)
    slim = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.struct(owner.alias("name")).alias("owner"),
            F.struct(repository.alias("name")).alias("repository"),
            _candidates(text, BASE).alias("base"),
            _candidates(text, MORE).alias("more"),
        ),
        "secrets",
    )
    each = slim.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("s")).withColumn("value", F.col("s.value"))
    held = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"))
    verdicts = (
        held.groupBy("value")
        .agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.sum("rows").alias("rows"))
        .select("value", "rows", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live"))
    )
    judged = look_up(each, staged(verdicts, "secret-verdicts"), "value", "rows")
    added = F.filter(F.collect_list(F.when(F.col("live") & (F.col("s.rank") >= len(BASE)), F.col("s"))), lambda s: s.isNotNull())
    by_row = judged.groupBy(F.col("row").alias("found")).agg(
        added.alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("bigint")
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, value: string>>")
    return slim.join(by_row, slim["row"] == by_row["found"], "left").select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", F.coalesce("added", none))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def op7_secret_owners(spark, sf_dir: str) -> DataFrame:
    """Repositories of ``documents`` are (source, lang), owners are sources."""
    docs = load(spark, sf_dir, "documents")
    return secret_scan(docs, repository=F.struct("source", "lang"), owner=F.col("source"))


def _sql() -> str:
    """The query in SQL: places of matches from the lengths of the pieces between them."""
    kinds = ", ".join(
        f"({rank}, '{kind}', '{pattern.replace(chr(39), chr(39) * 2)}', {group}, {least})"
        for rank, (kind, (_, pattern, group, least)) in enumerate((BASE | MORE).items())
    )
    return f"""
WITH kinds(rank, kind, pattern, grp, least) AS (VALUES {kinds}),
hits AS (
  SELECT doc_id, source, lang, rank, kind, least, regexp_extract_all(coalesce(text, ''), pattern, 0) AS m, string_split_regex(coalesce(text, ''), pattern) AS p,
         CASE grp WHEN 0 THEN regexp_extract_all(coalesce(text, ''), pattern, 0) WHEN 1 THEN regexp_extract_all(coalesce(text, ''), pattern, 1) ELSE regexp_extract_all(coalesce(text, ''), pattern, 2) END AS v
  FROM documents, kinds WHERE regexp_matches(coalesce(text, ''), pattern)
), spans AS (
  SELECT doc_id, source, lang, rank, kind, m[i] AS hit, v[i] AS value,
         list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits) WHERE length(v[i]) >= least
), verdicts AS (
  SELECT value, count(DISTINCT {{'s': source}}) <= 1 AND count(DISTINCT {{'s': source, 'l': lang}}) <= 3 AS live FROM spans GROUP BY 1
), judged AS (
  SELECT spans.*, live, kind || ':' || s || ':' || (s + length(hit)) AS name FROM spans JOIN verdicts USING (value)
), per AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
         coalesce(string_agg(name, ',' ORDER BY s, rank) FILTER (WHERE rank <= 2), '') AS base, coalesce(string_agg(name, ',' ORDER BY s, rank) FILTER (WHERE rank <= 2 OR live), '') AS spans,
         count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied
  FROM judged GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""


SQL = _sql()
