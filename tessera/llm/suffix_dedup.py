"""Suffix-array dedup: repeated byte strings by two-stage suffix sorting.

What is sought are starts of ``length``-byte strings that occur at least twice.  Every such window has an
anchor, the leftmost of its ``gram``-byte grams with the smallest hash, and equal windows have equal anchors.  Maximal runs
of starts with the same anchor value are cut out of the texts; runs whose anchor value occurs once in
the corpus cannot hold a repeat.  The other runs, equal ones only once with their count, meet by
anchor value and go into suffix arrays:

* a suffix smaller than its successor is sorted directly (only ``length`` bytes matter),
* all others are induced from their successors by one scan of the 256 buckets in order,
* common prefixes of neighbours are compared word by word up to ``length`` bytes; neighbours that agree in
  all of them are repeats, weighted by the counts.

Scale: only hashes and positions of runs are shuffled at first (about two for each ``length - gram`` bytes) with
partial counts; texts are shuffled once by id, and only runs with repeated anchors beyond that.
Runs of an anchor value that hold more than ``ARRAY`` bytes in all are cut finer: into pieces of ``PIECE`` starts that meet by the
hash of the bytes they share.  Equal pieces are counted before they are shuffled, so an array holds each only once.  Different
pieces with the same shared bytes that still hold more than ``ARRAY`` bytes are cut once more, into single windows, of which equal
ones are counted; so no task sorts more than about two ``ARRAY``, however many rows share a passage.

Defined results: null and empty text, and text shorter than ``length``: nothing removed (kept_text of a null text is null); repeats inside one text
count; rows with equal ids and texts are places of their own only if ids differ or the row repeats (each repeated
row counts); a null id is a row like others; an empty table gives an empty table; a column that has a result's name is
replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import lanes
from tessera.llm.shared import stage, tidy

LENGTH = 400
#: Bytes of one suffix array, and starts of a piece of a hot anchor's run.
ARRAY, PIECE = 1 << 18, 16
#: Suffixes whose bytes are held at once while they are sorted directly.
NAMES = 1 << 15
_U = np.uint64


def gram_of(length: int) -> int:
    """Longer anchors repeat less by chance, shorter ones make fewer runs."""
    return max(1, length * 2 // 5)


def _windows_min(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive values."""
    n = len(key) - w + 1
    pad = -len(key) % w
    k = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(k, 1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor value, hash of the run's bytes, first start, last start, number of anchors) of each run of a text."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    sums, down = lanes.prefix_hash(data)
    h = lanes.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    key = (h & ~_U(0xFFFFFFFF)) | np.arange(len(h), dtype=_U)
    anchor = _windows_min(key, length - gram + 1) & _U(0xFFFFFFFF)
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    begin = np.concatenate([[0], change])
    value = h[anchor[begin].astype(np.int64)]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    first = begin[new]
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    stop = last + length
    name = lanes.mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(_U))
    return value[new], name, first, last, np.diff(np.concatenate([np.flatnonzero(new), [len(new)]]))


def _map_runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in lanes.steps(b.column(1)):
                got = [runs(data[s:e], length, gram) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                rows = pa.array(np.repeat(np.asarray(b.column(0).slice(i, j - i)), [len(g[0]) for g in got]))
                c = [np.concatenate([g[x] for g in got]) if got else np.zeros(0) for x in range(5)]
                yield pa.RecordBatch.from_arrays([rows, pa.array(c[0].view(np.int64)), pa.array(c[1].view(np.int64)), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())],
                                                 ["row", "anchor", "name", "first", "last", "times"])

    return run


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor."""
    n = len(t)
    differ = np.flatnonzero(t[1:] != t[:-1])
    at = np.searchsorted(differ, np.arange(n))
    known = at < len(differ)
    out = np.zeros(n, bool)
    d = differ[at[known]]
    out[known] = t[d] < t[d + 1]
    return out


def _direct(t: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Ascending starts sorted by their next ``depth`` bytes; at most ``NAMES`` such strings exist at once.  Larger sets
    are split by eight bytes at a time first."""
    raw, n = t.tobytes(), len(t)
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(8, np.uint8)]), 8)
    out, todo = [np.zeros(0, np.int64)], [(starts, 0)]
    while todo:
        part, k = todo.pop()
        if k >= depth:
            out.append(np.sort(part)[::-1])  # equal but for their ends: the shorter first
        elif len(part) <= NAMES:
            names = [raw[i + k : i + depth] for i in part.tolist()]
            out.append(part[sorted(range(len(names)), key=names.__getitem__)])
        else:
            w = words[np.minimum(part + k, n)].view(">u8").ravel()
            order = np.argsort(w, kind="stable")
            part, w = part[order], w[order]
            cuts, runs_ = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist(), len(w)], []
            begin = 0
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - begin > NAMES:
                    if a > begin:
                        runs_.append((part[begin:a], k))
                    begin = a
                if e - a > NAMES:
                    runs_.append((part[a:e], k + 8))
                    begin = e
            if begin < len(w):
                runs_.append((part[begin:], k))
            todo.extend(reversed(runs_))
    return np.concatenate(out)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of bytes, sorted by at least their first ``depth`` bytes, in two stages."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    smaller = _types(t)
    direct = _direct(t, np.flatnonzero(smaller), depth)
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1]))  # its successor is the empty suffix
    out = []
    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        scanned = []
        while len(now):  # runs of one byte induce within their bucket
            scanned.append(now)
            before = now[now > 0] - 1
            now = before[(t[before] == c) & ~smaller[before]]
        scanned.append(direct[bounds[c] : bounds[c + 1]])
        full = np.concatenate(scanned)
        out.append(full)
        before = full[full > 0] - 1
        before = before[~smaller[before] & (t[before] > c)]
        if len(before):
            by = np.argsort(t[before], kind="stable")
            before = before[by]
            cut = np.flatnonzero(np.diff(t[before])) + 1
            for part in np.split(before, cut):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def repeats(t: np.ndarray, ok: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which positions with ``ok`` start a ``length``-byte string whose occurrences weigh at least 2 in all."""
    sa = suffix_array(t, length)
    sa = sa[ok[sa]]
    found = np.zeros(len(t), bool)
    if not len(sa):
        return found
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    same = np.arange(len(sa) - 1)
    for k in [*range(0, length - 7, 8), max(0, length - 8)]:
        if length < 8:
            same = same[[raw_a[:length].tobytes() == raw_b[:length].tobytes() for raw_a, raw_b in zip(words[sa[same]], words[sa[same + 1]], strict=True)]]
            break
        same = same[(words[sa[same] + k].view(np.int64) == words[sa[same + 1] + k].view(np.int64)).ravel()]
    joined = np.zeros(len(sa), bool)
    joined[same + 1] = True
    group = np.cumsum(~joined) - 1
    total = np.bincount(group, weight[sa])
    found[sa] = total[group] >= 2
    return found


_CUT = "key long, one long, two long, skip int, weight long, hot boolean, anchor long, name long, bytes binary"


def _cut(length: int, piece: int):
    """Cuts runs out of texts.  A hot anchor's run falls into pieces that meet by the bytes they share (key) and are
    known by all their bytes (one, two); any other run meets by its anchor and is known by anchor and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _CUT.split(", ")]
        for b in batches:
            out, size = [], 0
            for text, want in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = text.as_py() or b""
                for w in want:
                    f, l = w["first"], w["last"]
                    if not w["hot"]:
                        out.append((w["anchor"], w["anchor"], w["name"], 0, w["weight"], False, w["anchor"], w["name"], raw[f : l + length]))
                        size += l + length - f
                        continue
                    # Equal windows have the same offset to their anchors and so lie in cells of the same
                    # number; the core is what all windows of a cell share.
                    anchor = f + _anchors(raw[f : l + length], length)
                    start = np.arange(f, l + 1)
                    cell = (anchor - start) // piece
                    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]))
                    for x, y in zip(begin.tolist(), [*(begin[1:] - 1).tolist(), l - f], strict=True):
                        core = int(anchor[x]) - int(cell[x]) * piece
                        key = hashlib.blake2b(raw[core : core + length - piece + 1], digest_size=8, salt=int(cell[x]).to_bytes(8, "little")).digest()
                        part = raw[f + x : f + y + length]
                        own = hashlib.blake2b(part, digest_size=16, salt=key).digest()
                        out.append((*(int.from_bytes(d, "little", signed=True) for d in (key, own[:8], own[8:])), x, w["weight"], True, w["anchor"], w["name"], part))
                        size += len(part)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out, size = [], 0
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _sort(length: int, array: int):
    """Repeated starts, relative to their pieces, of all pieces that share a key; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            t = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
            lens = np.array([len(x[4]) for x in held])
            begin = np.cumsum(lens) - lens
            ok = np.ones(len(t), bool)
            for b_, n in zip(begin.tolist(), lens.tolist(), strict=True):
                ok[b_ + n - length + 1 : b_ + n] = False
            hit = repeats(t, ok, np.repeat([x[3] for x in held], lens), length)
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            a, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            own = np.searchsorted(begin, a, "right") - 1
            return pa.RecordBatch.from_arrays([
                pa.array(np.array([x[1] for x in held], np.int64)[own]), pa.array(np.array([x[2] for x in held], np.int64)[own]),
                pa.array(a - begin[own], pa.int32()), pa.array(e - begin[own], pa.int32())], ["one", "two", "a", "e"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= array and row[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield flush()

    return run


def _windows(length: int):
    """The single windows of pieces, by the digest of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(3).to_pylist()
                starts = [max(0, len(x) - length + 1) for x in texts]
                digest = [hashlib.blake2b(x[s : s + length], digest_size=16).digest() for x, n in zip(texts, starts, strict=True) for s in range(n)]
                own = pa.array(np.repeat(np.arange(len(texts)), starts))
                at = np.concatenate([np.arange(n) for n in starts]) if starts else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column(c).take(own) for c in range(3)] + [pa.array(at, pa.int32()), pa.array(digest, pa.binary())], ["one", "two", "weight", "a", "window"])

    return run


def _apply(length: int, names: list[str], at: int):
    """Removes the bytes that repeated starts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                rows = []
                for text, found in zip(part.column(at), part.column(at + 1).to_pylist(), strict=True):
                    raw = text.as_py() or b""
                    kept, done, spans, end = [], 0, 0, -1
                    for a, e in sorted((x["a"], x["e"]) for x in found or ()):
                        if a > end:
                            spans += 1
                            kept.append(raw[done:a])
                        end = max(end, e + length)
                        done = end
                    kept.append(raw[done:])
                    k = b"".join(kept) if spans else raw
                    rows.append((len(raw), len(raw) - len(k), spans, hashlib.sha256(k).hexdigest(), k, k.decode("utf-8", "ignore") if text.is_valid else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *made], names)

    return run


def _numbered(df: DataFrame, columns: list) -> DataFrame:
    """``columns`` of a scan of Parquet files, and _row: the file's number, written once, and the place in the file.
    Splits, and monotonically_increasing_id with them, may differ each time that files are scanned."""
    files = stage(df.select(F.col("_metadata.file_path").alias("_file")).distinct().coalesce(1).select("_file", F.monotonically_increasing_id().alias("_number")))
    placed = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"), *columns)
    return placed.join(F.broadcast(files), "_file").withColumn("_row", F.shiftleft("_number", 40) + F.col("_at")).drop("_file", "_at", "_number")


def _covering(spans: DataFrame, by: list[str], length: int) -> DataFrame:
    """Spans (``by``, a, e) as fewer ones that cover the same bytes: starts in one block of ``length`` starts lie less than
    ``length`` apart, so no byte between them is left out.  Each place of a run then takes one row, not one for each start."""
    return (spans.groupBy(*by, F.expr(f"a div {length}").alias("_block")).agg(F.min("a").alias("a"), F.max("e").alias("e"))
            .select(*by, "a", "e"))


def remove(df: DataFrame, length: int = LENGTH, text: str = "text", keep: list[str] | None = None, scanned: bool = False,
           array: int | None = None, piece: int | None = None) -> DataFrame:
    """``keep`` (default: all other columns) with n_bytes, n_removed, n_spans, kept_sha256, kept binary (the remaining bytes)
    and kept_text string (the same without characters of which only a part is left).  ``scanned`` says that ``df`` is a
    plain scan of Parquet files: its rows are then numbered by file and place in the file, which no split changes; any other
    input is staged first."""
    if length < 2:
        raise ValueError("length: at least 2")
    array, piece, gram = array or ARRAY, min(piece or PIECE, length), gram_of(length)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, *made)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not scanned:
        df = stage(df.select(*keep, text))
    rows = _numbered(df, [*keep, F.col(text).cast("binary").alias("_text")])
    raw = rows.select("_row", "_text")
    found = stage(raw.mapInArrow(tidy(_map_runs(length, gram)), "row long, anchor long, name long, first int, last int, times int"))
    # Anchors seen once go first, on narrow pre-aggregated rows; what follows moves only the rest.
    anchors = found.groupBy("anchor").agg(F.sum("times").alias("all")).where("all > 1").select("anchor")
    found = stage(found.join(anchors, "anchor"))
    distinct = found.groupBy("anchor", "name").agg(F.count("*").alias("weight"), F.min(F.struct("row", "first", "last")).alias("at"))
    sizes = distinct.groupBy("anchor").agg(F.sum(F.col("at.last") - F.col("at.first") + length).alias("n"))
    wanted = distinct.join(sizes, "anchor").select(
        F.col("at.row").alias("_row"), F.struct("anchor", "name", F.col("at.first").alias("first"), F.col("at.last").alias("last"), "weight", (F.col("n") > array).alias("hot")).alias("w"))
    by_row = rows.repartition(parts, "_row")
    cut = stage(by_row.select("_row", "_text").join(wanted.groupBy("_row").agg(F.collect_list("w").alias("w")), "_row").select("_text", "w")
                .mapInArrow(tidy(_cut(length, piece)), _CUT))
    pieces = stage(cut.where("hot").groupBy("key", "one", "two").agg(F.sum("weight").alias("weight"), F.first("bytes").alias("bytes")))
    full = pieces.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("n")).where(F.col("n") > array).select("key")
    into = cut.where("not hot").select("key", "one", "two", "weight", "bytes").unionByName(pieces.join(full, "key", "left_anti"))
    sorted_ = (into.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(_sort(length, array)), "one long, two long, a int, e int"))
    windows = pieces.join(full, "key", "left_semi").select("one", "two", "weight", "bytes").mapInArrow(tidy(_windows(length)), "one long, two long, weight long, a int, window binary")
    often = windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    single = windows.join(often, "window").select("one", "two", "a", F.col("a").alias("e"))
    starts = stage(_covering(sorted_.unionByName(single), ["one", "two"], length))
    named = _covering(cut.where("hot").join(starts, ["one", "two"])
                      .select("anchor", "name", (F.col("skip") + F.col("a")).alias("a"), (F.col("skip") + F.col("e")).alias("e")), ["anchor", "name"], length)
    plain = starts.select(F.col("one").alias("anchor"), F.col("two").alias("name"), "a", "e")
    hits = (found.join(plain.unionByName(named), ["anchor", "name"])
            .select(F.col("row").alias("_row"), F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("e")).alias("e")).alias("s"))
            .groupBy("_row").agg(F.collect_list("s").alias("_found")))
    fields = [df.schema[c] for c in keep]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType(), T.StringType()]
    schema = T.StructType(fields + [T.StructField(n, k) for n, k in zip(made, kinds, strict=True)])
    return by_row.join(hits, "_row", "left").select(*keep, "_text", "_found").mapInArrow(tidy(_apply(length, [*keep, *made], len(keep))), schema)


def _anchors(run: bytes, length: int) -> np.ndarray:
    """Place of each start's anchor in a run's bytes."""
    data = np.frombuffer(run, np.uint8)
    gram = gram_of(length)
    sums, down = lanes.prefix_hash(data)
    h = lanes.mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    key = (h & ~_U(0xFFFFFFFF)) | np.arange(len(h), dtype=_U)
    return (_windows_min(key, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)


def op6(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], scanned=True).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))
