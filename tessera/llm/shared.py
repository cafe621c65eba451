"""Staging of intermediate tables and distributed connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task holds while it contracts its own part of a graph.
FOREST_EDGES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it.  Where it names none: on one machine a temporary folder, on a
    cluster a folder in the warehouse, which all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="tessera-stage-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-stage"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends in files that
    every executor sees, so a lost executor costs a task and not the job."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Owner -> how a worker drops what that owner's tasks keep for its next ones.
HELD: dict[str, Callable[[], None]] = {}


# Both are looked up by name in the worker; a nested function would carry the driver's HELD along.
def _drop(owner: str | None) -> None:
    for other, drop in HELD.items():
        if other != owner:
            drop()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run, owner: str | None = None):
    """``run`` for mapInArrow, giving memory back: workers live on between stages.  What other owners hold goes at the
    start of a task, freed memory returns to the system at its end."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop(owner)
        try:
            yield from run(batches)
        finally:
            _trim()

    return go


def bare_crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest connected node) of an edge list, by repeated hooking to smaller labels."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(limit: int):
    """Spanning forests of at most ``limit`` edges at a time: an edge from each node to the smallest one it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate([np.asarray(x.column(i)) for x in held]) for i in (0, 1))
            nodes, root = forest(a, b)
            far = nodes != root
            out = pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])
            for i in range(0, out.num_rows, 100_000):
                yield out.slice(i, 100_000)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _stars(e: DataFrame) -> DataFrame:
    return (e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
            .groupBy("id").agg(F.min("component").alias("component")))


def components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, component): each id of ``edges`` (a, b: long, not null) with the smallest id that it reaches.

    Edges meet by their larger end, and each task replaces those it has by a spanning forest of stars, at most
    ``limit`` (default ``FOREST_EDGES``) edges at a time.  If all that is left fits one such forest, one more task ends
    the work.  Otherwise rounds follow: every node sends its larger neighbours to its smallest one (an equi-join
    with one row for each node on one side, so a hub's side may be split), and the new edges are contracted by their larger ends
    again; they end when a round changes nothing.  An empty input gives an empty result; loops and repeated edges are harmless.
    """
    limit = limit or FOREST_EDGES
    edges = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    contract = lambda df: df.mapInArrow(tidy(_contract(limit)), "a long, b long")
    e = stage(contract(edges.repartition("a")))
    seen = None
    while True:
        n, *print_ = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if n <= limit:
            return _stars(stage(contract(e.coalesce(1))) if n else e)
        if [n, *print_] == seen:
            return _stars(e)
        seen = [n, *print_]
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = stage(contract(large.distinct().repartition("a")))
