"""Arrow text columns as flat UTF-8 bytes: words, hashes and shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on (a single longer text is its own step).
STEP_BYTES = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**40, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of words: all but space and 0x09-0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: digits, a-z (after lower-casing) and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lane(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, off, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(array: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last+1, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offs = lane(array)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of several texts.

    start, end: byte positions; hash: 64 bits of each word; first: index of each text's first word,
    with the number of words at the end.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool = True) -> None:
        if lower:
            data = _LOWER[data]
        self.data = data
        n = len(data)
        inside = kind[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        edge = offs[(offs > 0) & (offs < n)]
        before[edge] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        up, down = _power(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers: ``(sums[j] - sums[i]) * down[i]`` is a hash of ``data[i:j]``."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def word_hash(word: str) -> np.uint64:
    """The hash that :class:`Words` gives to a lower-case word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), np.ones(256, bool), lower=False).hash[0]


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + hashes[j : j + n] * _ODD[j % 64]
    return mix(total)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int, kind: np.ndarray = NOT_BLANK) -> list[np.ndarray]:
    """For each text its distinct ``k``-word shingles as ascending hashes; a text of fewer words, but
    not none, has its whole sequence as the only one."""
    w = Words(data, offs, kind)
    every = sequence_hash(w.hash, k)
    out = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if j - i >= k:
            s = np.sort(every[i : j - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(sequence_hash(w.hash[i:j], j - i)[:1] if j > i else np.zeros(0, np.uint64))
    return out
