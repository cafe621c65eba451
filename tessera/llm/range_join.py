"""Embedding near-dedup: an exact metric range join over unit vectors.

Cosine >= c is a distance of at most r = sqrt(2 - 2c) between unit vectors.  Pivots (a bounded sample
without vectors that nearly coincide) partition the vectors: each vector's home is the nearest pivot's cell.  By the triangle inequality a vector
x can have partners at home in the cell of pivot p only if (d(x,p)^2 - d(x,h)^2) / (2 d(p,h)) <= r, where h
is its own pivot, and only if d(x,p) is within r of the distances that the cell's members have.  So x is
sent to these cells only, and every cell joins independently.  Both ends of a link would send to the other's cell, so of
two cells only one sends to the other, chosen by their numbers: each pair meets once and counts for both.

A cell's members are cut into blocks of at most ``BLOCK`` bytes and its visitors into salted runs, so that a
task never holds a whole cell; tasks give sums of links and stars of linked vectors, never all
pairs.  Only cells' sizes and radii (a row for each pivot) reach the driver.

Vectors in many dimensions without clusters lie at almost equal distances; then the inequality
excludes little and most vectors visit most cells.

Defined results: null or zero vectors, and those with null or non-finite components, link with nothing; so do
vectors of different lengths; equal vectors link; repeated ids count as vectors of their own in n_links, and
share a component; a null id links with nothing; an empty table gives an empty table; other columns are not passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, forest, stage, tidy

#: Vectors for each pivot, bounds of the number of pivots, bytes of the members of a block and visitors of a run.
PER_PIVOT, PIVOTS = 4096, (8, 1024)
BLOCK, RUN = 8 << 20, 8192
_SLACK = 1e-6
#: Smallest distance of two pivots.  Rounding errs by some 1e-15 in squared distances, and the inequality divides it by
#: d(p,h) and d(p,h)^2: pivots this far apart keep the quotient's error well below ``_SLACK``.
APART = 1e-3


def _clean(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, place (a number for each row) and unit: binary doubles, null for vectors that cannot link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2).to_pylist()
            units = []
            for x in rows:
                v = np.array(x if x is not None and None not in x else [], float)
                n = float(np.sqrt(v @ v)) if v.size and np.isfinite(v).all() else 0.0
                if n and not np.isfinite(n) or v.size and np.isfinite(v).all() and 0 < np.abs(v).max() < 1e-150:
                    v = v / np.abs(v).max()
                    n = float(np.sqrt(v @ v))
                units.append((v / n).tobytes() if n else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(units, pa.binary())], ["id", "place", "unit"])

    return (df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("place"), F.col(vector).cast("array<double>").alias("v"))
            .mapInArrow(tidy(run), "id long, place long, unit binary"))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dim)


def _by_length(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.array([len(x) // 8 for x in b.column(column).to_pylist()])
    for d in np.unique(sizes):
        yield int(d), b.filter(pa.array(sizes == d))


def _apart(v: np.ndarray) -> np.ndarray:
    """Those of the unit vectors that are at least ``APART`` from all kept before them."""
    v, kept = np.unique(v, axis=0), []
    near = np.zeros(len(v), bool)
    for i in range(len(v)):
        if not near[i]:
            kept.append(i)
            near |= np.sqrt(((v - v[i]) ** 2).sum(1)) < APART
    return v[kept]


def _sends(home, cell):
    """Whether vectors at home in one cell visit the other: of two cells exactly one does, of all others about half."""
    return (home < cell) ^ ((home + cell) % 2 == 1)


def _homes(pivots: dict[int, np.ndarray]):
    """dim, home and distance to the home's pivot; a length without pivots has one cell, -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_length(b, 2):
                x = _matrix(part.column(2), d)
                if d in pivots:
                    dist = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots[d].T))
                    home = dist.argmin(1)
                    near = dist[np.arange(len(x)), home]
                else:
                    home, near = np.full(len(x), -1), np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), d), pa.int32()), pa.array(home, pa.int32()), pa.array(near)],
                                                 ["id", "place", "unit", "dim", "home", "near"])

    return run


def _visits(pivots: dict[int, np.ndarray], cells: dict[tuple[int, int], tuple[int, float, float]], r: float):
    """One row for each block of each cell that a vector must meet: as a visitor from the cell itself (role 0) or another (1),
    and as a member (2, own block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_length(b, 2):
                x = _matrix(part.column(2), d)
                home, place = np.asarray(part.column(4)), np.asarray(part.column(1))
                mine = np.arange(len(x))
                salt = ((place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
                rows, cell, block, run_, role = [], [], [], [], []
                dist = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots[d].T)) if d in pivots else np.zeros((len(x), 1))
                between = np.sqrt(np.maximum(1e-300, 2 - 2 * pivots[d] @ pivots[d].T)) if d in pivots else np.ones((1, 1))
                for p in range(dist.shape[1]) if d in pivots else (-1,):
                    size, low, high = cells.get((d, p), (0, 0.0, 0.0))
                    if not size:
                        continue
                    at = dist[:, max(p, 0)]
                    own = np.asarray(part.column(5))
                    go = (home == p) | (_sends(home, p) & ((at**2 - own**2) / (2 * between[max(p, 0), np.maximum(home, 0)]) <= r + _SLACK) & (at <= high + r + _SLACK) & (at >= low - r - _SLACK))
                    who = mine[go]
                    blocks, runs = -(-size // max(256, BLOCK // (8 * d))), -(-(size * 4) // RUN)
                    for k in range(blocks):
                        rows.append(who), cell.append(np.full(len(who), p)), block.append(np.full(len(who), k))
                        run_.append(salt[who] % runs), role.append((home[who] != p).astype(np.int8))
                    who = mine[home == p]
                    for k in range(runs):  # each run of visitors needs its block of members
                        rows.append(who), cell.append(np.full(len(who), p)), block.append(salt[who] // 65536 % blocks)
                        run_.append(np.full(len(who), k)), role.append(np.full(len(who), 2, np.int8))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    key = (np.concatenate(cell).astype(np.int64) + 1) << 40 | np.concatenate(block).astype(np.int64) << 20 | np.concatenate(run_).astype(np.int64)
                    for i in range(0, len(at), 20_000):
                        pick = at.slice(i, 20_000)
                        n = len(pick)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d), pa.int32()), pa.array(key[i : i + n]), pa.array(np.concatenate(role)[i : i + n]),
                                                          part.column(0).take(pick), part.column(1).take(pick), part.column(2).take(pick)],
                                                         ["dim", "task", "role", "id", "place", "unit"])

    return run


def _join(c: float):
    """Links of one block, of its visitors and, with those from other cells, its members: (id, place, n) and stars (id, far)."""
    names = ["id", "place", "n", "far", "star"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, mid, mplace = None, [], [], []
        m = ids = places = None
        for b in batches:
            dims, tasks, role = (np.asarray(b.column(i)) for i in range(3))
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(dims) != 0) | (np.diff(role) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tasks)], strict=True):
                if i == j:
                    continue
                part, now = b.slice(i, j - i), (int(dims[i]), int(tasks[i]))
                if now != key:
                    key, members, mid, mplace, m = now, [], [], [], None
                x = _matrix(part.column(5), now[0])
                pid, pplace = np.asarray(part.column(3)), np.asarray(part.column(4))
                if role[i] == 2:
                    members.append(x), mid.append(pid), mplace.append(pplace)
                    m = None
                    continue
                if not members:
                    continue
                if m is None:
                    m, ids, places = np.concatenate(members), np.concatenate(mid), np.concatenate(mplace)
                    m32 = m.astype(np.float32)
                slack = (now[0] + 8) * 2.0**-23  # more than single precision errs on unit vectors of this length
                step = max(16, (1 << 21) // len(m))
                for k in range(0, len(x), step):
                    y = x[k : k + step]
                    a, e = np.nonzero(y.astype(np.float32) @ m32.T >= np.float32(c - slack))
                    real = np.concatenate([np.einsum("ij,ij->i", y[a[s : s + 65536]], m[e[s : s + 65536]]) >= c for s in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
                    a, e = a[real], e[real]
                    other = pplace[k : k + step][a] != places[e]
                    a, e = a[other], e[other]
                    if not len(a):
                        continue
                    ends = [(pid[k : k + step], pplace[k : k + step], np.bincount(a, minlength=len(y)))]
                    if role[i] == 1:  # the members do not visit the other cell
                        ends.append((ids, places, np.bincount(e, minlength=len(ids))))
                    node, root = forest(pid[k : k + step][a], ids[e])
                    far = node != root
                    zero = np.zeros(far.sum(), np.int64)
                    for who, where, n in ends:
                        has = np.flatnonzero(n)
                        none = np.zeros(len(has), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(who[has]), pa.array(where[has]), pa.array(n[has]), pa.array(none), pa.array(none > 0)], names)
                    yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(zero), pa.array(zero), pa.array(root[far]), pa.array(zero == 0)], names)

    return run


def link(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each row of ``df``: id, n_links long, component_id long, kept boolean."""
    spark = df.sparkSession
    rows = stage(_clean(df, id_col, vector))
    clean = rows.where("id is not null and unit is not null")
    n = clean.count()
    wanted = min(PIVOTS[1], max(PIVOTS[0], n // PER_PIVOT))
    pivots: dict[int, list[bytes]] = {}
    for r in clean.sort(F.xxhash64("place", F.lit(5))).limit(wanted).select("unit").collect():
        pivots.setdefault(len(r.unit) // 8, []).append(bytes(r.unit))
    piv = {d: _apart(np.stack([np.frombuffer(x, float) for x in v])) for d, v in pivots.items()}
    # Staged, so that a vector between two pivots has one home in the cells' sizes, in what is sent and in repeated tasks.
    homed = stage(clean.mapInArrow(tidy(_homes(piv)), "id long, place long, unit binary, dim int, home int, near double"))
    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    cells = {(x.dim, x.home): (x.n, x.low, x.high) for x in homed.groupBy("dim", "home").agg(F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high")).collect()}
    sent = homed.mapInArrow(tidy(_visits(piv, cells, r)), "dim int, task long, role byte, id long, place long, unit binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = stage(sent.repartition(parts, "dim", "task").sortWithinPartitions("dim", "task", F.desc("role"))
                  .mapInArrow(tidy(_join(cosine)), "id long, place long, n long, far long, star boolean"))
    counts = found.where("not star").groupBy("id", "place").agg(F.sum("n").alias("n"))
    groups = components(found.where("star").select(F.col("id").alias("a"), F.col("far").alias("b")))
    return (rows.select("id", "place").join(counts, ["id", "place"], "left").join(groups, "id", "left")
            .select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def op1(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
