"""The test tables as files, entities, relations and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark, d) -> DataFrame:
    """path, text, digest of each document."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return read(spark, d, "documents").select("doc_id", path.alias("path"), "text", F.sha2("text", 256).alias("digest"))


def entities(spark, d) -> DataFrame:
    def one(table, key, name, parent):
        t = read(spark, d, table)
        return t.select(F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("key"), F.lit(table).alias("kind"), F.col(name).alias("name"), parent.alias("parent"))

    of = lambda table, c: F.concat(F.lit(f"{table}:"), F.col(c).cast("string"))
    return (one("region", "r_regionkey", "r_name", F.lit("repo")).unionByName(one("nation", "n_nationkey", "n_name", of("region", "n_regionkey")))
            .unionByName(one("customer", "c_custkey", "c_name", of("nation", "c_nationkey"))).unionByName(one("supplier", "s_suppkey", "s_name", of("nation", "s_nationkey")))
            .unionByName(one("part", "p_partkey", "p_name", F.lit("repo"))).unionByName(one("orders", "o_orderkey", "o_orderpriority", of("customer", "o_custkey"))))


def relations(spark, d) -> DataFrame:
    """orders call parts, parts reference suppliers; return flags give the resolution."""
    line = read(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    common = [F.when(flag == "N", "ambiguous").otherwise("resolved").alias("resolution"), F.when(flag == "R", "heuristic").otherwise("resolved").alias("basis")]
    site = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site")
    part = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    calls = line.select(site, F.lit("calls").alias("kind"), F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("source"), part.alias("target"), *common)
    refs = line.select(site, F.lit("references").alias("kind"), part.alias("source"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target"), *common)
    return calls.unionByName(refs)


#: The same projections as SQL, for oracles.
SQL = """files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text, sha256(text) AS digest FROM documents),
entities AS (SELECT 'region:' || r_regionkey AS key, 'region' AS kind, r_name AS name, 'repo' AS parent FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'region:' || n_regionkey FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'nation:' || c_nationkey FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'nation:' || s_nationkey FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'repo' FROM part
 UNION ALL SELECT 'orders:' || o_orderkey, 'orders', o_orderpriority, 'customer:' || o_custkey FROM orders),
relations AS (SELECT l_orderkey * 10 + l_linenumber AS site, 'calls' AS kind, 'orders:' || l_orderkey AS source, 'part:' || l_partkey AS target,
  CASE WHEN l_returnflag = 'N' THEN 'ambiguous' ELSE 'resolved' END AS resolution, CASE WHEN l_returnflag = 'R' THEN 'heuristic' ELSE 'resolved' END AS basis FROM lineitem
 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'references', 'part:' || l_partkey, 'supplier:' || l_suppkey,
  CASE WHEN l_returnflag = 'N' THEN 'ambiguous' ELSE 'resolved' END, CASE WHEN l_returnflag = 'R' THEN 'heuristic' ELSE 'resolved' END FROM lineitem),
labelled AS (SELECT *, CASE WHEN resolution = 'ambiguous' THEN 'ambiguous' WHEN basis = 'heuristic' THEN 'heuristic' ELSE 'proven' END AS label FROM relations)"""
