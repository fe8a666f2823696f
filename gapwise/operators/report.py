"""A report page from aggregates: overview, totals, worst rows, test of the mechanism, interpretation."""

from __future__ import annotations

import html
import os
from collections.abc import Iterable
from string import Template

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.errors import ConfigurationError, InsufficientDataError
from gapwise.functions import nullity
from gapwise.operators.mcar import mcar_test
from gapwise.operators.summary import miss_case_summary, miss_var_summary

Values = Iterable[object] | None

LABELS = {
    "en": {"title": "Missing data report", "overview": "Variables", "totals": "Totals", "rows": "Rows with most missing values", "test": "Little's test", "dir": "ltr", "none": "not available"},
    "de": {"title": "Bericht zu fehlenden Daten", "overview": "Variablen", "totals": "Summen", "rows": "Zeilen mit den meisten Lücken", "test": "Test nach Little", "dir": "ltr", "none": "nicht verfügbar"},
    "fa": {"title": "گزارش داده‌های گمشده", "overview": "متغیرها", "totals": "مجموع", "rows": "ردیف‌های با بیشترین گمشدگی", "test": "آزمون لیتل", "dir": "rtl", "none": "در دسترس نیست"},
}

PAGE = Template("""<!DOCTYPE html>
<html lang="$lang" dir="$dir"><head><meta charset="utf-8"><title>$title</title>
<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3em .6em}</style></head>
<body><h1>$title</h1>
<h2>$totals_label</h2>$totals
<h2>$overview_label</h2>$chart$overview
<h2>$rows_label</h2>$rows
<h2>$test_label</h2><p>$mechanism</p><p>$advice</p></body></html>
""")


def severity(pct):
    """none, low (<5 %), moderate (<20 %) or high."""
    return F.when(pct == 0, "none").when(pct < 5, "low").when(pct < 20, "moderate").otherwise("high")


def report_overview(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """variable, n_miss, pct_miss, severity."""
    return miss_var_summary(df, missing_values).withColumn("severity", severity(F.col("pct_miss")))


def report_totals(df: DataFrame, missing_values: Values = None) -> DataFrame:
    """n_rows, n_cols, n_miss, pct_miss, n_incomplete_rows: one aggregate."""
    n = nullity.row_count(nullity.flags(df, missing_values).values())
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(n), F.lit(0)).alias("n_miss"), F.count_if(n > 0).alias("n_incomplete_rows"))
    cells = F.col("n_rows") * len(df.columns)
    return totals.select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), "n_miss", nullity.percent(F.col("n_miss"), cells).alias("pct_miss"), "n_incomplete_rows")


def report_worst_rows(df: DataFrame, row_id: str, top: int = 10, missing_values: Values = None) -> DataFrame:
    """case, n_miss, pct_miss of the ``top`` rows that miss most, ties by id."""
    return miss_case_summary(df, row_id, missing_values).where("n_miss > 0").orderBy(F.desc("n_miss"), "case").limit(top)


def interpretation(p_value: float | None, overall_pct: float) -> tuple[str, str]:
    """What the test says about the mechanism, and what to do at this share of missing values."""
    if p_value is None or p_value != p_value:
        mechanism = "Unknown: the test could not be run."
    elif p_value > 0.05:
        mechanism = "MCAR not rejected: missingness may be completely at random."
    else:
        mechanism = "MCAR rejected: missingness depends on the data."
    if overall_pct < 5:
        advice = "Few values are missing; complete cases or simple fills will hardly matter."
    elif overall_pct < 20:
        advice = "A moderate share is missing; use multiple imputation or donors."
    else:
        advice = "A large share is missing; impute with care and check how results depend on it."
    return mechanism, advice


def _table(rows: list, names: list[str]) -> str:
    cell = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def bar_svg(rows: list[tuple[str, float]]) -> str:
    """Bars of per cent as inline SVG."""
    lines = [
        f'<text x="0" y="{20 * i + 14}">{html.escape(n)}</text><rect x="180" y="{20 * i + 3}" width="{3 * p:.1f}" height="14" fill="#46a"/>'
        for i, (n, p) in enumerate(rows)
    ]
    return f'<svg width="500" height="{20 * len(rows) + 4}" font-size="12">{"".join(lines)}</svg>'


def create_report(df: DataFrame, row_id: str, output_path: str = "missing_data_report.html", missing_values: Values = None, language: str = "en") -> str:
    """Write the page and return its absolute path. Only aggregates and the ten worst rows reach the driver."""
    labels = LABELS.get(language, LABELS["en"])
    body = nullity.canonical(df, missing_values).persist()
    try:
        data = body.drop(row_id)
        overview = [tuple(r) for r in report_overview(data).collect()]
        totals = report_totals(data).first()
        worst = [tuple(r) for r in report_worst_rows(body, row_id).collect()]
        p_value = None
        try:
            usable = [v for v, _, p, _ in overview if p < 100]
            p_value = mcar_test(data.select(*[nullity.column(c) for c in usable])).first()["p_value"]
        except (ConfigurationError, InsufficientDataError, RuntimeError, np.linalg.LinAlgError):
            pass
    finally:
        body.unpersist()
    mechanism, advice = interpretation(p_value, totals["pct_miss"])
    page = PAGE.substitute(
        lang=language if language in LABELS else "en", dir=labels["dir"], title=labels["title"], totals_label=labels["totals"], overview_label=labels["overview"],
        rows_label=labels["rows"], test_label=labels["test"], totals=_table([tuple(totals)], list(totals.asDict())), chart=bar_svg([(v, p) for v, _, p, _ in overview]),
        overview=_table(overview, ["variable", "n_miss", "pct_miss", "severity"]), rows=_table(worst, ["case", "n_miss", "pct_miss"]),
        mechanism=html.escape(mechanism) + (f" (p = {p_value:.4g})" if p_value is not None else ""), advice=html.escape(advice),
    )
    path = os.path.abspath(output_path)
    with open(path, "w", encoding="utf-8") as out:
        out.write(page)
    return path
