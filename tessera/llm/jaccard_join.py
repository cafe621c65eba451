"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes; it is cut into fragments of equal width.
Two sets with Jaccard similarity of at least t differ in at most D = (1-t)/(1+t) * (|x|+|y|) n-grams, so
among more than D fragments one holds the same n-grams of both.  Texts that agree in a fragment
are linked to the smallest of them, which gives candidate groups: every similar pair is in
one.  Inside a group, the overlaps of its texts are counted fragment by fragment, each fragment on its own, and
summed for each pair; pairs that reach t become links.

Scale: texts that agree are first joined inside each map task, so a key with very many texts is shuffled
once per task; texts with equal sets are one node; groups larger than ``BLOCK`` are cut into blocks whose pairs
are separate tasks; tasks give stars of linked texts, never all pairs; components are found by
distributed star rounds.  Before texts move, parity sketches (lower bounds on the difference) of ``SKETCH`` words
each exclude pairs of a candidate group and split it; texts are only sent within what is left.

Defined results: null text or text without words: empty set, linked with nothing; fewer words than the
n-gram, but not none: one n-gram of all words; equal sets are linked; rows that share an id are one node; a row with a null id
is its own (component null); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm import lanes
from tessera.llm.shared import components, forest, stage, tidy

#: Keys that a map task joins at once, texts of a block, columns of one counting fragment, words of the parity sketch.
KEYS = 1 << 19
BLOCK = 512
#: Sketches of a block, rows and columns compared at once, and words of the longest sketch.
SCREEN, STRIP, COLS, WIDEST = 16384, 128, 4096, 512
COLUMNS = 4096
SKETCH = 16
_U = np.uint64


class Classes:
    """Size classes: similar sets are in the same class or in neighbouring ones, and meet in the larger's."""

    def __init__(self, t: Fraction) -> None:
        self.t = t
        self.low = [1]

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(math.floor(self.low[-1] / self.t) + 1)

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.low, size, "right")) - 1

    def fragments(self, c: int) -> tuple[int, int]:
        """(largest difference of two similar sets that meet in class c, number of fragments)."""
        while len(self.low) <= c + 1:
            self._grow(self.low[-1])
        top = self.low[c + 1] - 1
        most = math.floor((1 - self.t) / (1 + self.t) * 2 * top)
        least = self.low[max(0, c - 1)]
        n = most + 1
        return most, n + math.ceil(1.5 * n * math.exp(-least / n)) if most else 1


def keys(s: np.ndarray, classes: Classes) -> np.ndarray:
    """Hashes of the fragments of an ascending set, for its own class and the next."""
    out = []
    own = classes.of(len(s))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(lanes.mix(s), dtype=_U)])
    for c in (own, own + 1):
        most, n = classes.fragments(c)
        if not most:
            continue  # only equal sets meet here, and those are one node already
        at = np.searchsorted((s >> _U(32)) * _U(n) >> _U(32), np.arange(n + 1, dtype=_U))
        held = np.diff(at)
        h = lanes.mix((sums[at[1:]] - sums[at[:-1]]) + np.arange(n, dtype=_U) * _U(0x9E3779B97F4A7C15) + held.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + _U(c * 0x165667B19E3779F9 % 2**64))
        out.append(h if n - int((held == 0).sum()) <= most else h[held > 0])
    return np.concatenate(out) if out else np.zeros(0, _U)


def _sets(k: int):
    """id, size, a 128-bit name and the sketch of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in lanes.steps(b.column(1)):
                sets = lanes.shingle_sets(data, offs, k)
                f1 = np.array([np.bitwise_xor.reduce(lanes.mix(s)) if len(s) else 0 for s in sets], _U)
                f2 = np.array([lanes.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) if len(s) else 0 for s in sets], _U)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                                                  pa.array([_wide_sketch(x) for x in sets], pa.binary())], ["id", "size", "f1", "f2", "sketch"])

    return run


def _map_keys(k: int, t: Fraction):
    """(key, id) for the smallest id of each key in a task's run; texts that agree there get a key of their own for the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(t)
        held_k, held_d, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc = np.concatenate(held_k), np.concatenate(held_d)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            lead = doc[first]
            leader = lead[np.cumsum(first) - 1]
            far = doc != leader
            if far.any():
                a, b = forest(doc[far], leader[far])
                a, b = a[a != b], b[a != b]
            else:
                a = b = np.zeros(0, np.int64)
            own = lanes.mix(a.view(_U) * _U(0x9E3779B97F4A7C15) ^ lanes.mix(b.view(_U)))
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[first], own, own]).view(np.int64)), pa.array(np.concatenate([lead, a, b]))], ["k", "d"])
            for i in range(0, out.num_rows, 100_000):
                yield out.slice(i, 100_000)

        for b in batches:
            for i, j, data, offs in lanes.steps(b.column(1)):
                ids = np.asarray(b.column(0).slice(i, j - i))
                for doc, s in zip(ids, lanes.shingle_sets(data, offs, k), strict=True):
                    if len(s):
                        got = keys(s, classes)
                        held_k.append(got)
                        held_d.append(np.full(len(got), doc, np.int64))
                        size += len(got)
                if size >= KEYS:
                    yield from flush()
                    held_k, held_d, size = [], [], 0
        if size:
            yield from flush()

    return run


def _wide_sketch(s: np.ndarray) -> bytes:
    """A sketch with about two bits for each n-gram, a power of two of words; folding halves it (see ``_fold``)."""
    width = min(WIDEST, max(SKETCH, 1 << (len(s) // 32).bit_length()))
    h = lanes.mix(s ^ _U(0x2545F4914F6CDD1D))
    bits = np.bincount((h & _U(64 * width - 1)).astype(np.int64), minlength=64 * width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """Sketches of fewer words from wider ones."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Parities: two sets differ in at least as many n-grams as their sketches in bits."""
    out = np.zeros((len(sets), SKETCH), _U)
    for r, s in enumerate(sets):
        h = lanes.mix(s ^ _U(0x2545F4914F6CDD1D))
        np.bitwise_xor.at(out[r], (h >> _U(6)).astype(np.int64) % SKETCH, _U(1) << (h & _U(63)))
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: counted for each fragment of the order on its own, and summed."""
    total = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.unique(np.concatenate(a)), np.unique(np.concatenate(b))
    both = np.intersect1d(va, vb, assume_unique=True)
    for i in range(0, len(both), COLUMNS):
        part = both[i : i + COLUMNS]
        ma, mb = (np.zeros((len(x), len(part)), np.float32) for x in (a, b))
        for m, sets in ((ma, a), (mb, b)):
            for r, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, s)
                m[r, at[part[np.minimum(at, len(part) - 1)] == s]] = 1
        total += ma @ mb.T
    return total


def similar(a: list[np.ndarray], b: list[np.ndarray], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of non-empty sets with Jaccard similarity of at least t."""
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    up, down = t.numerator, t.denominator
    maybe = (na[:, None] * down >= nb[None, :] * up) & (nb[None, :] * down >= na[:, None] * up)
    if len(a) * len(b) > 64:
        sa, sb = _sketch(a), _sketch(b)
        differ = np.zeros(maybe.shape, np.int64)
        for k in range(SKETCH):
            differ += np.bitwise_count(sa[:, k][:, None] ^ sb[:, k][None, :])
        maybe &= differ * (up + down) <= (down - up) * (na[:, None] + nb[None, :])
    ra, rb = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if not len(ra):
        return ra, rb
    o = overlaps([a[i] for i in ra], [b[j] for j in rb]).astype(np.int64)
    good = (o * (up + down) >= up * (na[ra][:, None] + nb[rb][None, :])) & maybe[np.ix_(ra, rb)]
    i, j = np.nonzero(good)
    return ra[i], rb[j]


def _near(na: np.ndarray, sa: np.ndarray, nb: np.ndarray, sb: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs that neither sizes nor sketches exclude; both sides ascend by size."""
    up, down = t.numerator, t.denominator
    for i in range(0, len(na), STRIP):
        x, y = na[i : i + STRIP], sa[i : i + STRIP]
        low = int(np.searchsorted(nb, -(-x[0] * up // down), "left"))
        high = int(np.searchsorted(nb, x[-1] * down // up, "right"))
        for j in range(low, high, COLS):
            end = min(j + COLS, high)
            differ = np.zeros((len(x), end - j), np.int32)
            for k in range(y.shape[1]):
                differ += np.bitwise_count(y[:, k][:, None] ^ sb[j:end, k][None, :])
            a, b = np.nonzero(differ.astype(np.int64) * (up + down) <= (down - up) * (x[:, None] + nb[None, j:end]))
            yield a + i, b + j


def _screen(t: Fraction):
    """Stars of ids that may be similar in each (group, block pair); rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if not sides.get(False):
                return
            if key[1] != key[2] and True not in sides:
                return
            side = {}
            for r, widths in sides.items():
                side[r] = {}
                for w, parts in widths.items():
                    ids, sizes, sketch = (np.concatenate([p[c] for p in parts]) for c in range(3))
                    order = np.argsort(sizes, kind="stable")
                    side[r][w] = ids[order], sizes[order], sketch[order]
            node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for wa, (ia, na, sa) in side[False].items():
                for wb, (ib, nb, sb) in side.get(True, side[False]).items():
                    w = min(wa, wb)
                    for i, j in _near(na, _fold(sa, w), nb, _fold(sb, w), t):
                        x, y = ia[i], ib[j]
                        far = x != y
                        if far.any():
                            node, root = forest(np.concatenate([node, x[far]]), np.concatenate([root, y[far]]))
                            node, root = node[node != root], root[node != root]
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

        for b in batches:
            c, p, q, right, ids, sizes = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            sketch = b.column(6).to_pylist()
            width = np.array([len(x) // 8 for x in sketch])
            cuts = (np.flatnonzero((np.diff(c) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0) | (np.diff(right.astype(np.int8)) != 0)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(c)], strict=True):
                if i == j:
                    continue
                now = int(c[i]), int(p[i]), int(q[i])
                if now != key:
                    yield from close()
                    key, sides = now, {}
                for w in np.unique(width[i:j]).tolist():
                    of = np.flatnonzero(width[i:j] == w) + i
                    bits = np.frombuffer(b"".join([sketch[x] for x in of.tolist()]), _U).reshape(-1, w)
                    sides.setdefault(bool(right[i]), {}).setdefault(w, []).append((ids[of].astype(np.int64), sizes[of].astype(np.int64), bits))
        yield from close()

    return run


def _tasks(groups: DataFrame, block: int) -> DataFrame:
    """id, component and x (p, q, right) for each pair of blocks of its group that an id belongs to."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    place = groups.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A block meets itself and every other block of its group once; in a pair the first is the left side.
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("p"), F.greatest("block", o).alias("q"), (F.col("block") > o).alias("right")))
    return place.select("id", "component", pairs.alias("pairs"))


def _verify(k: int, t: Fraction):
    """Stars of linked ids in each (group, block pair); rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [], [], [])
        out_a, out_b = [], []

        def close() -> None:
            ia, sa, ib, sb = sides
            alone = not ib
            if not ia or alone and len(ia) < 2:
                return
            i, j = similar(sa, sa if alone else sb, t)
            x, y = np.array(ia, np.int64), np.array(ia if alone else ib, np.int64)
            if len(i):
                node, root = forest(x[i], y[j])
                out_a.append(node[node != root]), out_b.append(root[node != root])

        for b in batches:
            groups = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            right = b.column(3).to_pylist()
            for i, j, data, offs in lanes.steps(b.column(5)):
                ids = b.column(4).slice(i, j - i).to_pylist()
                for n, s in enumerate(lanes.shingle_sets(data, offs, k)):
                    if groups[i + n] != key:
                        close()
                        key, sides = groups[i + n], ([], [], [], [])
                    at = 2 if right[i + n] else 0
                    sides[at].append(ids[n]), sides[at + 1].append(s)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a, out_b = [], []
        close()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def join(df: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, n_shingles long, component_id (smallest id reachable by links, itself
    included).  ``threshold`` is a fraction, so that the comparison is exact."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    known = rows.where("id is not null")
    sets = stage(rows.mapInArrow(tidy(_sets(k)), "id long, size long, f1 long, f2 long, sketch binary"))
    names = ["f1", "f2", "size"]
    lead = sets.where("id is not null and size > 0").groupBy(*names).agg(F.min("id").alias("rep"))
    member = sets.where("id is not null and size > 0").join(lead, names).groupBy("id").agg(F.min("rep").alias("rep"))
    sent = known.mapInArrow(tidy(_map_keys(k, threshold)), "k long, d long")
    low = F.min("d").over(W.partitionBy("k"))
    agree = sent.withColumn("low", low).where("d <> low").select(F.col("d").alias("a"), F.col("low").alias("b")).distinct()
    same = member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    agree = stage(agree)
    reps = stage(member)
    to = lambda e, c: e.join(reps.select(F.col("id").alias(c), F.col("rep").alias(f"r{c}")), c)
    among = to(to(agree, "a"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
    order = ["component", "p", "q", "right", "id"]
    sketches = sets.select("id", "size", "sketch").join(_tasks(stage(components(among)), SCREEN), "id").select(
        "component", F.explode("pairs").alias("x"), "id", "size", "sketch").select("component", "x.p", "x.q", "x.right", "id", "size", "sketch")
    maybe = sketches.repartition("component", "p", "q").sortWithinPartitions(*order).mapInArrow(tidy(_screen(threshold)), "a long, b long")
    tasks = (known.join(_tasks(stage(components(maybe)), BLOCK), "id").select("component", "id", "text", F.explode("pairs").alias("x"))
             .select("component", "x.p", "x.q", "x.right", "id", "text"))
    links = (tasks.repartition("component", "p", "q").sortWithinPartitions(*order)
             .mapInArrow(tidy(_verify(k, threshold)), "a long, b long"))
    linked = components(stage(links).unionByName(same))
    return (sets.join(linked, "id", "left")
            .select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))


def deduplicate(df: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with the smallest id of each component; rows with a null id stay."""
    found = join(df, k, threshold, id_col, text).where(f"{id_col} <> component_id").select(F.col(id_col).alias("_gone")).distinct()
    return df.join(found, df[id_col] == found["_gone"], "left_anti")


def op10(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, Fraction(9, 10))
