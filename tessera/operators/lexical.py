"""BM25 over term counts: many queries in one plan, over stored or fresh postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import term_counts
from tessera.operators.staging import stage

K1, B = 1.2, 0.75
#: Query terms up to this many rows are broadcast to the postings.
BROADCAST = 200_000
#: Matching postings that one task scores.
ROWS = 250_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    return term_counts(docs, key, text)


def lengths(post: DataFrame, key: str) -> DataFrame:
    return post.groupBy(key).agg(F.sum("tf").alias("dl"))


def stats(length: DataFrame) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def ranked(post: DataFrame, length: DataFrame, stat: DataFrame, queries: DataFrame, key: str, query: str, query_text: str, limit: int) -> DataFrame:
    """(query, key, score_micro, rank): the best ``limit`` documents of each query, ties by key.

    Contributions are rounded to millionths before they are summed, so the order of a shuffle cannot change a score.
    Few query terms are broadcast, so that postings are filtered where they lie and a term of most documents is no hot key; only
    matching postings move, each with its document, and scores are summed there."""
    asked = stage(term_counts(queries, query, query_text).select(query, "term"))
    small = asked.count() <= BROADCAST
    hint = F.broadcast if small else (lambda x: x)
    near = stage(post.join(hint(asked.select("term").distinct()), "term", "left_semi"))
    df = near.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stat.select("n", "avgdl")))  # one row
    idf = df.select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # As many tasks as the postings need, so that a task's memory does not grow with them.
    parts = max(1, -(-near.count() // ROWS))
    # What a posting adds is the same for every query that asks for its term: worked out once, before queries multiply it.  The
    # postings stay dealt by document, so the sums need no further shuffle where query terms are broadcast.
    adds = near.join(hint(idf), "term").repartition(parts, key).join(length.repartition(parts, key).hint("merge"), key).select(key, "term", F.round(F.col("idf") * part * 1e6).cast("long").alias("adds"))
    scored = adds.join(hint(asked), "term").groupBy(query, key).agg(F.sum("adds").alias("score_micro"))
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score_micro"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def bm25(post: DataFrame, queries: DataFrame, key: str, query: str, query_text: str, limit: int) -> DataFrame:
    """:func:`ranked` over postings that are counted once and staged."""
    post = stage(post)
    length = stage(lengths(post, key))
    return ranked(post, length, stats(length), queries, key, query, query_text, limit)
