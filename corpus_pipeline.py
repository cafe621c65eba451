"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame, which is written and read again as
the next one's documents.  All but the last return the columns of their documents.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, piece_bpe, quality, suffix_dedup
from tessera.llm.shared import stage

#: Repeated strings of this many bytes go: shorter than a passage of 50 words.
REPEAT_BYTES = 200


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; learnt on their labelled rows."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group linked by Jaccard >= 0.8 of five-word shingles."""
    return jaccard_join.deduplicate(docs, 5, Fraction(4, 5))


def _packed(docs: DataFrame) -> DataFrame:
    """All columns but the text in one struct, so that no result takes the place of a column of its name."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_doc"), "text")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of ``REPEAT_BYTES`` that stand elsewhere too; characters of which a part was cut are dropped."""
    kept = suffix_dedup.remove(_packed(docs), REPEAT_BYTES, scanned=True)  # stages are read from files
    out = kept.select("_doc.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.scan(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["_doc"])
    return found.where("n_hit = 0").select("_doc.*", "text").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, packed ids and the digest of the decoded text."""
    return piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"]).select(
        "doc_id", "lang", "source", "n_tokens", F.col("packed").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", token_stage),
]
#: Learnt weights and token ids have no SQL form; the operators are tested against brute force, the stages for their shape.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
