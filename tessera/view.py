"""Reads of one generation: each is a filter that reaches the scan, and returns a bounded number of rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from tessera.functions.text import tails
from tessera.operators import catalog
from tessera.store import Store

ENTITY = ("key", "category", "kind", "name", "signature", "path", "start", "end", "digest", "test")


class View:
    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name, self.spark = store, name, store.spark
        self.manifest = store.manifest(name)
        self._sources: dict[str, bytes] = {}

    def table(self, name: str):
        return self.store.read(self.name, name)

    @cached_property
    def files(self) -> dict[str, dict]:
        return {r.path: r.asDict() for r in self.table("files").select("path", "digest", "size", "dialect", "coverage").collect()}

    def entities(self, keys) -> dict[str, dict]:
        keys = sorted(set(keys))
        if not keys:
            return {}
        return {r.key: r.asDict() for r in self.table("entities").where(F.col("key").isin(keys)).select(*ENTITY).sort("key").collect()}

    def blast(self, keys) -> dict[str, dict]:
        keys = sorted(set(keys))
        return {r.key: r.asDict() for r in self.table("blast").where(F.col("key").isin(keys)).collect()} if keys else {}

    def named(self, name: str, limit: int, paths: list[str] | None = None) -> tuple[list[str], bool]:
        df = self.table("entities").where(F.col("name") == name)
        df = df if paths is None else df.where(F.col("path").isin(paths))
        keys = [r.key for r in df.select("key").sort("key").limit(limit + 1).collect()]
        return keys[:limit], len(keys) > limit

    def innermost(self, path: str, start: int, end: int) -> str | None:
        df = self.table("entities").where((F.col("path") == path) & (F.col("category") == "symbol") & (F.col("start") <= start) & (F.col("end") >= end))
        found = df.select("key", (F.col("end") - F.col("start")).alias("w")).sort("w", "key").limit(1).collect()
        return found[0].key if found else None

    def declarations(self, paths: list[str], limit: int) -> list[dict]:
        df = self.table("entities").where((F.col("category") == "symbol") & F.col("path").isin(paths))
        return [r.asDict() for r in df.select(*ENTITY).sort("path", "start", F.desc("end"), "key").limit(limit).collect()]

    def adjacency(self, keys, allowance: int, kinds: tuple[str, ...] = ()) -> dict[str, tuple[list, list]]:
        """For each key its (kind, other, heuristic) rows out and in; keys from the first one on whose rows would exceed the allowance, in
        key order and in either direction, are left out."""
        keys = sorted(set(keys))
        rel = self.table("relations").where(F.col("target").isNotNull())
        rel = rel.where(F.col("kind").isin(*kinds)) if kinds else rel
        out = {k: ([], []) for k in keys}
        cut = None
        for way, (own, other) in enumerate((("source", "target"), ("target", "source"))):
            rows = (rel.where(F.col(own).isin(keys)).select(F.col(own).alias("k"), "kind", F.col(other).alias("o"), (F.col("basis") == "heuristic").alias("h")).sort("k", "kind", "o").limit(allowance + 1).collect())
            if len(rows) > allowance:
                cut = min(cut or rows[-1].k, rows[-1].k)
            for r in rows:
                out[r.k][way].append((r.kind, r.o, r.h))
        return {k: v for k, v in out.items() if cut is None or k < cut}

    def relations(self, key: str) -> list[dict]:
        rel = self.table("relations").where((F.col("source") == key) | (F.col("target") == key))
        return [r.asDict() for r in rel.withColumn("label", catalog.label()).sort("site", "source", F.coalesce("target", F.lit(""))).collect()]

    def mentions(self, names, kinds=("calls", "references")) -> int:
        names = sorted(set(names))
        rel = self.table("relations").where((F.col("resolution") == "unresolved") & F.col("kind").isin(*kinds))
        return rel.where(F.arrays_overlap(tails(F.col("text")), F.array(*map(F.lit, names)))).select("site").distinct().count() if names else 0

    def source(self, path: str) -> bytes:
        if path not in self._sources:
            digest = self.files[path]["digest"]
            self._sources[path] = bytes(self.table("sources").where(F.col("digest") == digest).select("data").first()["data"])
        return self._sources[path]

    def lexical(self, text: str, limit: int) -> tuple[list[tuple[str, float]], bool]:
        """Best entities for a text by BM25 over the stored postings, score then key; and whether there are more."""
        from tessera.operators import lexical

        query = self.spark.createDataFrame([(0, text)], "q int, text string")
        found = lexical.ranked(self.table("postings"), self.table("lengths"), self.table("stats"), query, "key", "q", "text", limit + 1).sort("rank").collect()
        return [(r.key, r.score_micro / 1e6) for r in found[:limit]], len(found) > limit
