"""Queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontaminate, jaccard_join, licenses, oracles, piece_bpe, quality, range_join, rollups, shards, suffix_dedup, warc

QUERIES = {
    "op1_embedding_range_join": range_join.op1,
    "op2_license_scan": licenses.op2,
    "op3_warc_derivatives": warc.op3,
    "op4_benchmark_decontamination": decontaminate.op4,
    "op5_quality_rules": quality.op5,
    "op6_suffix_array_dedup": suffix_dedup.op6,
    "op7_piece_tokens": piece_bpe.op7,
    "op8_token_rollups": rollups.op8,
    "op9_sampled_shards": shards.op9,
    "op10_ngram_jaccard_join": jaccard_join.op10,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
