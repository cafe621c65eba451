"""Sharding by sampled splitters.

Records are ordered by a key (hash of the text, then id, then place), so equal texts are neighbours.
A size-weighted sample of keys of bounded size gives quantile boundaries, records are dealt to
the ranges between them, and ranges that come out too full are subdivided by samples of their own.
With the exact totals of all ranges (a table of bounded length) each record knows how many bytes
stand before it, so shard sizes differ by about one record or small group.

One law holds for every group of equal texts: it goes to the shard of its middle byte as a whole while it is smaller than
the share ``whole`` of a shard, and is dealt row by row otherwise, because a group kept whole moves the shard's size by
half its own.  ``whole`` is thus the bound of a shard's deviation.  Texts are read once; only keys and sizes are shuffled.

Defined results: null text: size 1, crc 0; null or repeated ids: each row has its own slot; rows that
are equal in all respects share the law but may swap slots; an empty table gives an empty table; a single row goes to one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessera.llm.shared import stage

#: Sampled keys for each boundary, rows that a range should hold, and bounds of the number of ranges.
PER_SPLITTER = 16
ROWS_A_RANGE = 200_000
RANGES = (64, 4096)
#: Default of ``whole``.
WHOLE = 0.005
_KEY = ["k", "i", "p"]


def _sample(df: DataFrame, total: int, wanted: int) -> list[tuple]:
    """About ``wanted`` keys with their weights, drawn in proportion to size; the same rows every time."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    draw = F.pmod(F.xxhash64("k", "i", "p", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rows = df.withColumn("c", chance).where(draw < F.col("c")).select(*_KEY, (F.col("size") / F.col("c")).alias("w")).collect()
    return sorted((r.k, r.i, r.p, r.w) for r in rows)


def _quantiles(sample: list[tuple], n: int) -> list[tuple]:
    """n - 1 keys that cut the weighted sample into n equal parts (fewer if keys repeat)."""
    if not sample:
        return []
    weight = np.cumsum([x[3] for x in sample])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, n) / n)
    return sorted({sample[int(a)][:3] for a in np.minimum(at, len(sample) - 1)})


def _ranges(df: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``df`` with range int: the number of cuts at or below each key."""
    if not cuts:
        return df.withColumn("range", F.lit(0))
    arrays = [np.array([c[j] for c in cuts], np.int64) for j in range(3)]
    places = [df.columns.index(c) for c in _KEY]
    schema = T.StructType([*df.schema.fields, T.StructField("range", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort(arrays[::-1])
        c = [a[order] for a in arrays]
        for b in batches:
            x = [np.asarray(b.column(p)) for p in places]
            low = np.searchsorted(c[0], x[0], "left")
            high = np.searchsorted(c[0], x[0], "right")
            while (open_ := low < high).any():  # binary search among cuts of the same hash
                mid = np.where(open_, (low + high) // 2, 0)
                below = (c[1][mid] < x[1]) | ((c[1][mid] == x[1]) & (c[2][mid] <= x[2]))
                low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low, pa.int32())], schema.names)

    return df.mapInArrow(run, schema)


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", whole: float = WHOLE) -> DataFrame:
    """One row for each record: id, size, text_crc32, law, shard int, slot long (gapless from 0 in each shard).  Groups of equal
    texts below the share ``whole`` of a shard stay together; 0 deals every row by its own place."""
    spark = df.sparkSession
    clean = F.coalesce(F.col(text), F.lit(""))
    keyed = stage(df.select(
        F.col(id_col).alias("id"), (F.octet_length(clean) + 1).cast("long").alias("size"), F.crc32(clean.cast("binary")).alias("crc"),
        F.xxhash64(clean).alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63) + 1)).alias("i"), F.monotonically_increasing_id().alias("p")))
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = min(RANGES[1], max(RANGES[0], rows // ROWS_A_RANGE + 1))
    low = -(2**63)
    cuts = sorted({(k, low, low) for k, _, _ in _quantiles(_sample(keyed, total, n * PER_SPLITTER), n)})
    target = max(total / n, 1)
    for _ in range(4):
        ranged = _ranges(keyed, cuts)
        totals = sorted((r.range, r.n, r.s) for r in ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect())
        full = [(r, s) for r, c, s in totals if s > 3 * target and c > 1]
        if not full or len(cuts) > 2 * RANGES[1]:
            break
        inside = ranged.where(F.col("range").isin([r for r, _ in full]))
        sample = _sample(inside, sum(s for _, s in full), PER_SPLITTER * int(sum(s for _, s in full) / target))
        before = len(cuts)
        edges = [(low, low, low), *cuts, (2**63 - 1,) * 3]
        for r, s in full:
            own = [x for x in sample if edges[r] <= x[:3] < edges[r + 1]]
            cuts = sorted({*cuts, *_quantiles(own, max(2, round(s / target)))})
        if len(cuts) == before:
            break
    rows_before, bytes_before, table = 0, 0, []
    for r, c, s in totals:
        table.append((r, rows_before, bytes_before))
        rows_before, bytes_before = rows_before + c, bytes_before + s
    offsets = F.broadcast(spark.createDataFrame(table, "range int, rows_before long, bytes_before long"))
    ordered = W.partitionBy("range").orderBy(*_KEY)
    group = W.partitionBy("range", "k")
    spread = ranged.withColumn("row", F.row_number().over(ordered)).withColumn("done", F.sum("size").over(ordered.rowsBetween(W.unboundedPreceding, 0))).join(offsets, "range")
    share = max(total, 1) / shards
    own = F.col("bytes_before") + F.col("done") - F.col("size") / 2
    spread = spread.withColumn("g", F.sum("size").over(group)).withColumn("g0", F.min(F.col("bytes_before") + F.col("done") - F.col("size")).over(group))
    place = F.when(F.col("g") < whole * share, F.col("g0") + F.col("g") / 2).otherwise(own)
    placed = stage(spread.select(
        "id", "size", "crc", (F.col("rows_before") + F.col("row") - 1).alias("at"),
        F.least(F.lit(shards - 1), F.floor(place / F.lit(share)).cast("int")).alias("shard")))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("at").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"))


def op9(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("grown_shard", F.lit(None).cast("int"))
