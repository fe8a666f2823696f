"""The registered corpus queries: SQL where there is one, and the pipeline stage by stage."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from gapwise.llm import catalog, exact_dedup, lm_scoring, ngram_join, quality_rules
from gapwise.llm.common import staged
from support import SF, duck, duck_rows, spark_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(duck(), catalog.ORACLES[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.quality(docs, labels).where("kept").collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF).cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality rules":
            assert ids == kept
        elif name == "exact dedup":
            assert ids == {r.doc_id for r in exact_dedup.exact_dedup(now).where("kept").collect()}
        elif name == "n-gram Jaccard join":
            assert ids == {r.component_id for r in ngram_join.jaccard_components(now).collect()}
            assert out.count() == len(ids)
        elif name.startswith("mixing"):
            assert ids <= {r.doc_id for r in now.select("doc_id").collect()}
        else:
            assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).where("n % d <> 0").count() == 0
            assert ids == {r.doc_id for r in now.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == docs.columns
        now = out
    assert corpus_pipeline.run(spark, SF).count() == now.count()


def test_join_stage_after_dedup(spark, monkeypatch):
    """One row of each family stays, also where frequent tokens fill several files."""
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 20)
    words = [f"w{i}" for i in range(120)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in (3, 60, 119)]
    rows = [(1, near[0]), (2, near[0]), (3, near[1]), (4, near[2]), (5, " ".join(words[::-1])), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string").repartition(2)
    now = staged(corpus_pipeline.exact_dedup(spark, docs, SF), "stage-test")
    out = corpus_pipeline.ngram_jaccard_join(spark, now, SF)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 5, 6]


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, m int, row int, rate double, size int, part int, before bigint, label string"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [(None, None), (None, prose), (1, None), (2, ""), (3, prose), (3, prose), (4, prose + " more"), (5, " \n"), (6, "x" * 100_000), (7, prose * 300)]
    docs = spark.createDataFrame([(i, t, None, None if k % 3 else "s", None, 1, 2, 0.5, 3, 4, 5, "y") for k, (i, t) in enumerate(rows)], ODD)
    out = stage(spark, docs, SF)
    if stage is not corpus_pipeline.packing:
        assert out.columns == docs.columns
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids <= {None, *range(1, 8)}
    if stage is corpus_pipeline.quality_rules:
        assert ids == {None, 3, 4} or ids == {None, 3, 4, 7}
    if stage in (corpus_pipeline.exact_dedup, corpus_pipeline.packing):
        assert {1, 3, 4, 6, 7} <= ids
    if stage is corpus_pipeline.ngram_jaccard_join:
        assert {1, 2, 5, 6, 3} <= ids and 4 not in ids
    assert stage(spark, docs.limit(0), SF).count() == 0
