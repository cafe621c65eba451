"""Snapshots, differences and file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two tables of (path, digest)."""
    o, n = old.select("path", F.col("digest").alias("o")), new.select("path", F.col("digest").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified").otherwise("reused")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key: the columns asked for, which may be among those that give the order."""
    last = events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in columns])


def refresh(previous: DataFrame, changed: DataFrame) -> DataFrame:
    """The snapshot after a batch of (path, digest), where a null digest deletes; equals a full rebuild."""
    return previous.join(changed, "path", "left_anti").unionByName(changed.where("digest is not null"))


def follow(stream: DataFrame, key: str, order: list[str], columns: list[str], apply, checkpoint: str):
    """Run ``apply(latest events of the batch, batch id)`` for each micro-batch of a stream."""
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, n: apply(latest(df, key, order, columns), n)).trigger(availableNow=True).start())
