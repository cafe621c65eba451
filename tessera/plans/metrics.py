"""Retrieval quality: recall and reciprocal rank of ranked results against gold pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, gold: DataFrame, query: str, key: str, at: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """For each query with gold: hits among the first n of all gold, and the rank of the first hit."""
    hit = gold.join(ranked, [query, key], "left")
    return hit.groupBy(query).agg(F.count("*").alias("gold"), *[F.sum(F.when(F.col("rank") <= n, 1).otherwise(0)).alias(f"hits_{n}") for n in at], F.min("rank").alias("first_rank"))
