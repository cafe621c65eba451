"""Read operators of the property graph: entities (key, kind, name, parent) and relations (site, kind, source, target, name,
resolution, basis)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import tails
from tessera.operators.spans import smallest
from tessera.operators.staging import stage


def label() -> Column:
    return (F.when(F.col("resolution") == "unresolved", "unresolved").when(F.col("resolution") == "ambiguous", "ambiguous")
            .when(F.col("basis") == "heuristic", "heuristic").otherwise("proven"))


def entities_by_key(entities: DataFrame, keys: DataFrame) -> DataFrame:
    return entities.join(keys, "key", "left_semi")


def named(entities: DataFrame, name: str, limit: int) -> DataFrame:
    """Entities of a name in key order, with ``truncated`` if there are more."""
    found = entities.where(F.col("name") == name).sort("key").limit(limit + 1)
    w = W.orderBy("key")  # at most limit + 1 rows
    return found.withColumn("at", F.row_number().over(w)).withColumn("truncated", F.count("*").over(W.partitionBy()) > limit).where(F.col("at") <= limit).drop("at")


def innermost(spans: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (probe, path, start, end) the smallest span (path, s, e, key) that holds it, ties by key."""
    best = F.min(F.struct("width", "key"))
    found = probes.select("probe", "path", "start", "end").join(smallest(spans, probes, "path"), ["path", "start", "end"])
    return found.groupBy("probe").agg(best.alias("b")).select("probe", F.col("b.key").alias("key"), F.col("b.width").alias("width"))


def adjacency(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges out of and into a set of keys."""
    out = relations.join(keys.select(F.col("key").alias("source")), "source").select(F.col("source").alias("key"), F.lit("out").alias("direction"), "kind", F.col("target").alias("other"), label().alias("label"))
    into = relations.join(keys.select(F.col("key").alias("target")), "target").select(F.col("target").alias("key"), F.lit("in").alias("direction"), "kind", F.col("source").alias("other"), label().alias("label"))
    return out.unionByName(into).where("other is not null")


def within_allowance(adjacent: DataFrame, rows: int, parts: int = 64) -> DataFrame:
    """The keys before the first one whose rows, summed in key order over either direction alone, exceed the allowance.
    Counts are one row a key; sums run inside ranges of keys first, so no task orders all keys."""
    way = lambda d: F.sum((F.col("direction") == d).cast("long"))
    counts = adjacent.groupBy("key").agg(way("out").alias("o"), way("in").alias("i"))
    ranged = stage(counts.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.sum("o").alias("po"), F.sum("i").alias("pi"))  # one row a range
    w = W.orderBy("part")
    base = before.select("part", (F.sum("po").over(w) - F.col("po")).alias("bo"), (F.sum("pi").over(w) - F.col("pi")).alias("bi"))
    k = W.partitionBy("part").orderBy("key")
    run = ranged.withColumn("ro", F.sum("o").over(k)).withColumn("ri", F.sum("i").over(k)).join(F.broadcast(base), "part")
    over = run.where((F.col("ro") + F.col("bo") > rows) | (F.col("ri") + F.col("bi") > rows)).agg(F.min("key").alias("cut"))  # one row
    return adjacent.join(F.broadcast(over), F.col("cut").isNull() | (F.col("key") < F.col("cut")), "left_semi")


def mentions(relations: DataFrame, names: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Unresolved relations whose text is a name or ends with it after ``.`` or ``::``, each counted once a name."""
    open_ = relations.where("resolution = 'unresolved'")
    if kinds is not None:
        open_ = open_.where(F.col("kind").isin(*kinds))
    return open_.select("site", F.explode(tails(F.col("text"))).alias("name")).join(names, "name").groupBy("name").agg(F.countDistinct("site").alias("mentions"))


def entries(entities: DataFrame, blast: DataFrame, keys: DataFrame) -> DataFrame:
    """Entities of a key set with their blast columns."""
    return entities_by_key(entities, keys).join(blast, "key", "left")


def declarations(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """Symbols of a set of paths in source order: path, start, the longer first, key."""
    return entities.where("category = 'symbol'").join(paths, "path", "left_semi").sort("path", "start", F.desc("end"), "key")


def violations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(rule, key) of what breaks an invariant: repeated keys, endpoints that are missing, entities without exactly one parent."""
    repeated = entities.groupBy("key").count().where("count > 1").select(F.lit("repeated key").alias("rule"), "key")
    ends = relations.select(F.col("source").alias("key")).unionByName(relations.select(F.col("target").alias("key"))).where("key is not null").distinct()
    lost = ends.join(entities, "key", "left_anti").select(F.lit("missing endpoint").alias("rule"), "key")
    parents = relations.where("kind = 'contains'").groupBy(F.col("target").alias("key")).agg(F.count("*").alias("n"))
    alone = entities.where("key <> 'repo'").join(parents, "key", "left").where("coalesce(n, 0) <> 1").select(F.lit("parents").alias("rule"), "key")
    return repeated.unionByName(lost).unionByName(alone)


def link_counts(relations: DataFrame) -> DataFrame:
    """Counts of relations by kind for each label."""
    labels = ["proven", "heuristic", "ambiguous", "unresolved"]
    return relations.withColumn("label", label()).groupBy("kind").pivot("label", labels).count().na.fill(0, labels)


def touching(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """All relations of a key set, resolved or not, with direction; a relation of a key with itself goes out.
    Two equi-joins, so that either side may be hashed or broadcast."""
    out = relations.join(keys.select(F.col("key").alias("source")), "source").withColumn("key", F.col("source")).withColumn("direction", F.lit("out"))
    into = relations.where("target <> source").join(keys.select(F.col("key").alias("target")), "target").withColumn("key", F.col("target")).withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def links(relations: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, kind, direction, proven, heuristic, ambiguous, unresolved): counts of the relations that are no structure."""
    labels = ["proven", "heuristic", "ambiguous", "unresolved"]
    near = touching(relations, keys).where(~F.col("kind").isin("contains", "contains_logical", "defines"))
    return near.withColumn("label", label()).groupBy("key", "kind", "direction").pivot("label", labels).count().na.fill(0, labels)
