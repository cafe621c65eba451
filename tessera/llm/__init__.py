"""Operators for preparing training data: near-copy removal, scans, scoring, tokens and shards.

Nothing outside this package imports it.  Queries and their SQL are in :mod:`tessera.llm.registry`.
"""
