"""Benchmark decontamination by Wu-Manber search over words.

A symbol is a word (its 64-bit hash), a pattern a window of consecutive item words, a block two
words.  The shift table tells how far the search may jump; where it says 0, the bucket of the
block selects windows, and their words are compared directly, as hashes and then as bytes.
All texts of a step are searched in lockstep, each text as lanes of bounded length.

The benchmark is the small side: its texts pass through the driver in chunks of at most ``CHUNK_BYTES``, one at a time, and reach
each executor by broadcast, where the tables are built.  A benchmark of several chunks is searched in as many passes over
the documents, which carry the runs found so far, so nothing is dropped and a task's tables stay bounded; the passes, and the chunks
that an executor keeps, grow with the benchmark's size.  No shuffle.

Defined results: null or empty text, or text without words: no words, no hits; items without words
match nothing; items with equal windows are all reported; those of items with a null id are hit, but not named; repeated rows stay; an empty benchmark
gives no hits; other columns are passed on, except those with a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import lanes
from tessera.llm.shared import tidy

WINDOW = 10
#: Benchmark text searched for in one pass.
CHUNK_BYTES = 8 << 20
#: Window starts that one lane of a text covers.
LANE = 512
BLOCK = 2


class WuManber:
    """Windows of one length m, given as starts into the item words."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, m: int) -> None:
        self.words, self.m, self.b = words, m, min(BLOCK, m)
        span = m - self.b
        bits = max(12, min(22, int(len(starts) * (span + 1)).bit_length() + 2))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, span + 1, np.int64)
        for q in range(span + 1):
            at = (self.block(words, starts + q) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, at, span - q)
        tail = self.block(words, starts + span)
        order = np.argsort(tail, kind="stable")
        self.tail, self.starts = tail[order], starts[order]

    def block(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = words[at]
        for j in range(1, self.b):
            h = lanes.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + j])
        return h

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, start of the equal window) of all occurrences; first: bounds of the texts."""
        m, span = self.m, self.m - self.b
        n = np.maximum(0, np.diff(first) - m + 1)  # window starts of each text
        cuts = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), cuts)
        k = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        pos = first[:-1][text] + k * LANE
        stop = np.minimum(pos + LANE, first[:-1][text] + n[text])
        found = []
        while len(pos):
            tail = self.block(words, pos + span)
            jump = self.shift[(tail & self.mask).astype(np.int64)]
            zero = jump == 0
            if zero.any():
                found.append((pos[zero], tail[zero]))
            pos = pos + np.maximum(jump, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, tail = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = np.searchsorted(self.tail, tail, "left"), np.searchsorted(self.tail, tail, "right")
        at = np.repeat(at, high - low)
        which = np.arange(len(at)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        window = self.starts[which]
        for j in range(m):
            same = words[at + j] == self.words[window + j]
            at, window = at[same], window[same]
        return at, window


class Windows:
    """All distinct windows of some items, by length, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        data, offs = lanes.lane(pa.array([t for _, t in items], pa.string()))
        w = lanes.Words(data, offs, lanes.ALNUM)
        raw = w.data.tobytes()
        self.words = w.hash
        self.text = [raw[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        self.names = [n for n, _ in items]
        by: dict[int, dict[bytes, int]] = {}
        self.items: dict[int, dict[int, set[int]]] = {}
        for k, (i, j) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            m = min(size, j - i)
            for s in range(i, j - m + 1) if m else ():
                start = by.setdefault(m, {}).setdefault(self.words[s : s + m].tobytes(), s)
                self.items.setdefault(m, {}).setdefault(start, set()).add(k)
        self.searches = [WuManber(self.words, np.array(sorted(x.values())), m) for m, x in sorted(by.items())]

    def __call__(self, w: lanes.Words) -> tuple[list[tuple[int, int]], list[set[int]]]:
        """(first word, last word + 1) of each occurrence, and the items found in each text.  A text's window is looked up
        in the items once, however often it occurs there."""
        runs, seen = [], set()
        owned: list[set[int]] = [set() for _ in range(len(w.first) - 1)]
        for s in self.searches:
            at, window = s.search(w.hash, w.first)
            text = np.searchsorted(w.first, at, "right") - 1
            for p, q, d in zip(at.tolist(), window.tolist(), text.tolist(), strict=True):
                if all(w.data[w.start[p + j] : w.end[p + j]].tobytes() == self.text[q + j] for j in range(s.m)):
                    runs.append((p, p + s.m))
                    if (d, s.m, q) not in seen:
                        seen.add((d, s.m, q))
                        owned[d] |= self.items[s.m][q]
        return runs, owned


def chunks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The distinct items as (id, text) lists of bounded size, one at a time on the driver; equal rows count once."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = -(-2 * total // limit) if total > limit else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.sort("i", "t").collect()]


def scan(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, limit: int = CHUNK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with n_words long, n_hit long, runs array<int> (first word and last word + 1 of each run of hit
    words, in turn) and items array<string> (ids of items with occurring windows, sorted)."""
    made = ("n_words", "n_hit", "runs", "items")
    keep = [c for c in (documents.columns if keep is None else keep) if c not in (*made, text)]
    out = documents.select(*keep, text)
    fields = [documents.schema[c] for c in keep] + [documents.schema[text]]
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("runs", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType(fields + more)
    spark = documents.sparkSession
    for number, items in enumerate(chunks(benchmark, item, item_text, limit)):
        held = spark.sparkContext.broadcast(items)  # at most about ``limit`` bytes
        out = out.mapInArrow(tidy(_pass(held, window, len(keep), number > 0, schema.names)), schema)
    return out


def _pass(items, window: int, at: int, again: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None
        for b in batches:
            windows = windows or Windows(items.value, window)
            for i, j, data, offs in lanes.steps(b.column(at)):
                part = b.slice(i, j - i)
                w = lanes.Words(data, offs, lanes.ALNUM)
                runs, owned = windows(w)
                had: list[set[str]] = [set(x or ()) for x in part.column(at + 4).to_pylist()] if again else [set() for _ in range(j - i)]
                mark = np.zeros(len(w.hash) + 1, np.int64)
                for s, e in runs:
                    mark[s] += 1
                    mark[e] -= 1
                if again:
                    for f, x in zip(w.first.tolist(), part.column(at + 3).to_pylist(), strict=False):
                        for s, e in zip(x[::2], x[1::2], strict=True):
                            mark[f + s] += 1
                            mark[f + e] -= 1
                hit = np.cumsum(mark)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                for d, found in enumerate(owned):  # an item without a name is hit, but cannot be given
                    had[d].update(windows.names[k] for k in found if windows.names[k] is not None)
                out_runs = []
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                for f, l, n in zip(w.first[:-1].tolist(), w.first[1:].tolist(), n_hit.tolist(), strict=True):
                    out_runs.append(np.flatnonzero(np.diff(np.concatenate([[False], hit[f:l], [False]]).astype(np.int8))).tolist() if n else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in range(at + 1)]
                    + [pa.array(w.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(out_runs, pa.list_(pa.int32())), pa.array([sorted(x) for x in had], pa.list_(pa.string()))],
                    names)

    return run


def op4(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return scan(read("documents"), read("benchmark"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
