"""Operators that SQL expresses equal their SQL; folded sketches bound differences from below."""

import duckdb
import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.project(", ".join(f'"{x}"' for x in cols)).fetchall()))


def test_sketches():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    for a, b in ((base[:700], base[30:730]), (base[:500], base[:560]), (base[:30_000], base[500:36_000]), (base[:3], base[2:4])):
        x, y = (np.frombuffer(J._wide_sketch(s), np.uint64)[None] for s in (a, b))
        w = min(x.shape[1], y.shape[1])
        bound = int(np.bitwise_count(J._fold(x, w) ^ J._fold(y, w)).sum())
        assert 0 < bound <= len(np.setxor1d(a, b))
