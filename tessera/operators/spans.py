"""Windows over source spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def merge(spans: DataFrame, by: str, gap: int = 0) -> DataFrame:
    """Islands of spans (s, e) that overlap or lie at most ``gap`` apart."""
    w = W.partitionBy(by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + gap), 1).otherwise(0)).over(w)
    return (spans.withColumn("reach", reach).withColumn("island", island)
            .groupBy(by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("island"))


def ordinals(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """0-based place among siblings of one name."""
    return df.withColumn("ordinal", F.row_number().over(W.partitionBy(*same).orderBy(*order)) - 1)


def _blocks(spans: DataFrame, probes: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Spans (of, level, block, s, e, ...) and probes (``by``, at, place, start, end): a span of 2^k to 2^(k+1) - 1 lies in at most three blocks of
    2^k, a probe's start in one block of each k, so the two meet once at most, and a path of many spans is spread. A span that ends before it
    starts holds nothing."""
    sized = spans.where("e >= s").withColumn("level", F.expr("length(bin(greatest(e - s, 1))) - 1"))
    cut = sized.withColumn("block", F.explode(F.expr("sequence(shiftright(s, level), shiftright(e, level))"))).withColumnRenamed(by, "of")
    levels = sized.agg(F.collect_set("level").alias("levels"))  # one row, at most 63 numbers
    asked = probes.crossJoin(F.broadcast(levels)).withColumn("at", F.explode("levels")).withColumn("place", F.expr("shiftright(start, at)")).drop("levels")
    return cut.where(F.col("of").isNotNull()), asked.where(F.col(by).isNotNull())


def _met(spans: DataFrame, probes: DataFrame, by: str, answer, schema: str) -> DataFrame:
    """``answer(spans, probes)`` of each block; no table of pairs."""
    cut, asked = _blocks(spans, probes, by)
    return asked.groupBy(by, "at", "place").cogroup(cut.groupBy("of", "level", "block")).applyInArrow(lambda p, s: answer(s, p), schema)


def smallest(spans: DataFrame, probes: DataFrame, by: str) -> DataFrame:
    """(``by``, start, end, width, key): for each range that probes (``by``, start, end) ask for the smallest span (``by``, s, e, key) that holds it, ties
    by key; ranges that none holds are left out.

    In a block the spans in order of (width, key) are leaves of a tree, and a range goes down to the first that holds it: whether a node
    has one is known from its spans by start and the farthest end so far. The work is n log^2 n, whatever the ranges hold."""
    once = spans.groupBy(by, "s", "e").agg(F.min("key").alias("key"))
    asked = probes.select(by, "start", "end").distinct()
    kind = {c.name: c.dataType.simpleString() for c in once.select("key", (F.col("e") - F.col("s")).alias("width")).schema} | {c: asked.schema[c].dataType.simpleString() for c in (by, "start", "end")}

    def answer(s, p):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        s = s.append_column("width", pc.subtract(s["e"], s["s"])).sort_by([("width", "ascending"), ("key", "ascending")])
        n = len(s)
        begins, at_s = np.unique(s["s"].to_numpy(), return_inverse=True)
        ends, at_e = np.unique(s["e"].to_numpy(), return_inverse=True)
        a, b = np.searchsorted(begins, p["start"].to_numpy(), "right"), np.searchsorted(ends, p["end"].to_numpy())
        rank, node, found = np.arange(n), np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        high = max(n - 1, 0).bit_length()
        for level in range(high, -1, -1) if n else ():
            base = (rank >> level) * (n + 1)
            order = np.argsort(base + at_s, kind="stable")
            code, far = (base + at_s)[order], np.maximum.accumulate((base + at_e)[order])
            child = (node * 2 if level < high else node) * (n + 1)
            last = np.searchsorted(code, child + a) - 1
            hit = (last >= 0) & (far[last] >= child + b)
            found, node = (hit, node) if level == high else (found, node * 2 + ~hit)
        node = pa.array(node[found])
        p = p.filter(pa.array(found))
        return pa.table({by: p[by], "start": p["start"], "end": p["end"], "width": s["width"].take(node), "key": s["key"].take(node)})

    got = _met(once, asked, by, answer, ", ".join(f"`{c}` {kind[c]}" for c in (by, "start", "end", "width", "key")))
    return got.groupBy(by, "start", "end").agg(F.min(F.struct("width", "key")).alias("b")).select(by, "start", "end", "b.width", "b.key")


def depth(spans: DataFrame, by: str) -> DataFrame:
    """Number of spans that strictly enclose each span. In a block the ends in order of start are a wavelet matrix, which counts those
    that are no smaller than a bound in a prefix, bit by bit."""
    held = spans.select(by, "s", "e")
    asked = held.select(by, F.col("s").alias("start"), F.col("e").alias("end")).distinct()
    kind = {c.name: c.dataType.simpleString() for c in asked.schema}

    def answer(s, p):
        import numpy as np
        import pyarrow as pa

        s = s.sort_by([("s", "ascending"), ("e", "ascending")])
        begin, end, start, stop = (c.to_numpy() for c in (s["s"], s["e"], p["start"], p["end"]))
        ends, row = np.unique(end, return_inverse=True)
        to, bound = np.searchsorted(begin, start, "right"), np.searchsorted(ends, stop)
        # Equal spans lie together: those of the probe's own start and end do not enclose it.
        code, mine = np.searchsorted(begin, begin) * (len(ends) + 1) + row, np.searchsorted(begin, start) * (len(ends) + 1) + bound
        known = (to > np.searchsorted(begin, start)) & (bound < len(ends)) & (ends[np.minimum(bound, len(ends) - 1)] == stop) if len(s) else np.zeros(len(p), bool)
        n = -np.where(known, np.searchsorted(code, mine, "right") - np.searchsorted(code, mine), 0)
        x, y = np.zeros(len(p), np.int64), to
        for bit in range(len(ends).bit_length() - 1, -1, -1):
            one = (row >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            up = (bound >> bit) & 1 == 1
            n = n + np.where(up, 0, (y - x) - (zeros[y] - zeros[x]))
            x, y = (np.where(up, zeros[-1] + z - zeros[z], zeros[z]) for z in (x, y))
            row = np.concatenate([row[one == 0], row[one == 1]])
        return pa.table({by: p[by], "start": p["start"], "end": p["end"], "depth": pa.array(n + y - x, pa.int64())})

    got = _met(held, asked, by, answer, ", ".join([*(f"`{c}` {kind[c]}" for c in (by, "start", "end")), "depth long"]))
    return got.unionByName(asked.withColumn("depth", F.lit(0).cast("long"))).groupBy(by, "start", "end").agg(F.sum("depth").alias("depth")).withColumnsRenamed({"start": "s", "end": "e"})
