"""The fill-in-middle transformation: against a plain version, and restored."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gapwise.llm import fill_middle

SCHEMA = "doc_id bigint, text string, n int, form string, output string, r string"


def plainly(doc_id, text):
    """(n, form, prefix, middle, output) as the definition has it."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(3)
    texts = [None, "", "a", "<P>", "x <S> y", "<P", "<<M>>", "<", "ab<", "<<<S", "éü\n\x00 Z\t", "\U0001f600" * 7, "日本 go語" * 50, "word " * 40_000, "same", "same"]
    texts += ["".join(rng.choice("ab <>PSM.é\n") for _ in range(rng.randrange(30))) for _ in range(400)]
    return [(i, t, 1, "f", "o", "r") for i, t in enumerate(texts)] + [(None, "no id here", 1, "f", "o", "r"), (15, "same", 1, "f", "o", "r"), (2**40, "far id", 1, "f", "o", "r")]


def test_against_the_definition(spark):
    given = rows()
    done = fill_middle.fill_in_middle(spark.createDataFrame(given, SCHEMA).repartition(3))
    found = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.output_sha256, r.restored_sha256) for r in done.collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(r[0], plainly(r[0], r[1]), r[1] or "") for r in given]
    assert found == sorted((str(i), n, form, str(p), str(m), out, sha(out), sha(text)) for i, (n, form, p, m, out), text in expected)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_restoring_and_digests(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    done = fill_middle.fill_in_middle(docs, seed="other", plain_percent=0, spm_percent=50)
    back = fill_middle.restore(done).select(F.col("doc_id").alias("i"), F.col("text").alias("back"))
    joined = docs.join(back, docs["doc_id"].eqNullSafe(back["i"])).where("coalesce(text, '') <> back")
    assert joined.isEmpty()
    digests = fill_middle.fill_in_middle(docs, seed="other", plain_percent=0, spm_percent=50, keep_output=False)
    assert digests.where("output is not null").isEmpty()
    assert sorted(map(str, digests.drop("output").collect())) == sorted(map(str, done.drop("output").collect()))


def test_no_rows_and_other_ids(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    named = spark.createDataFrame([("k1", "a text")], "key string, body string")
    assert fill_middle.fill_in_middle(named, id_col="key", text_col="body").first().restored_sha256 == hashlib.sha256(b"a text").hexdigest()


def test_nothing_is_shuffled(spark):
    plan = fill_middle.fill_in_middle(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
