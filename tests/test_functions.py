import re

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import lexical
from tessera.streaming import delta


def test_terms(spark):
    cases = {"RetryPolicy": ["retry", "policy", "retrypolicy"], "HTTPClient": ["http", "client", "httpclient"], "v2 a.rs": ["v2", "rs"], "q t 9": [], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.terms(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases


def test_refresh_equals_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    change = spark.createDataFrame([("b", "9"), ("c", None), ("d", "4")], "path string, digest string")
    assert sorted(map(tuple, delta.refresh(old, change).collect())) == [("a", "1"), ("b", "9"), ("d", "4")]


def test_line_starts(spark):
    df = spark.createDataFrame([("ab\nc\n",), ("",)], "t string").select(X.line_starts(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [[0, 3, 5], [0]]


def test_term_counts(spark):
    """Rows of a key are one document, whatever partitions they come from; counting holds no table of words."""
    rows = [(1, "aB parseHTTPServer x1 x1"), (2, None), (1, "parse ab"), (3, ""), (None, "Zug zug"), (1, "__ é"), (4, "a 10 abc_DEf")]
    got = X.term_counts(spark.createDataFrame(rows, "k int, t string").repartition(4), "k", "t")
    want = {}
    for k, t in rows:
        for w in re.findall("[A-Za-z0-9_]+", t or ""):
            ps = re.findall(X.PART, w)
            for p in [p.lower() for p in ps if len(p) > 1] + ["".join(ps).lower()] * (len(ps) > 1):
                want[k, p] = want.get((k, p), 0) + 1
    assert {(r.k, r.term): r.tf for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan


def test_scoring_tasks_grow_with_postings(spark, monkeypatch):
    """Postings are scored in tasks of some number of rows each, with the same result."""
    docs = spark.createDataFrame([(k, f"common word{k % 7} word{k % 3}") for k in range(60)], "k long, t string")
    asked = spark.createDataFrame([(q, f"common word{q}") for q in range(4)], "q long, t string")
    post = lexical.postings(docs, "k", "t")
    want = lexical.bm25(post, asked, "k", "q", "t", 5).collect()
    monkeypatch.setattr(lexical, "ROWS", 10)
    got = lexical.bm25(post, asked, "k", "q", "t", 5)
    assert "k#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and max(map(int, re.findall(r"RepartitionByExpression \[k#[^\]]*\], (\d+)", plan))) >= 12
    assert sorted(got.collect()) == sorted(want)
