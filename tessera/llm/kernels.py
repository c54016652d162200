"""Numpy kernels that the Arrow stages of this subpackage share.

Everything works on one slice of documents at a time: a flat ``uint8`` buffer
plus offsets, so memory is bounded by the slice and not by the Arrow batch.

`range_hash` is a polynomial modulo 2**64: quick, and only ever a proposal (a group whose
text is compared later, a feature). Where equal hashes decide, words and contexts are
digested by BLAKE2b.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call handles, unless a single document is longer.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        for i, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the polynomial hash over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[0]=0, such that any range's hash is a difference of two entries."""
    pw, _ = powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of each range; the length goes in as well."""
    _, inv = powers(len(prefix))
    h = (prefix[end] - prefix[start]) * inv[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of the width, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def anchors(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, width: int) -> np.ndarray:
    """Positions whose k-gram is the least of some window of `width` k-grams of its document.

    Equal windows of k + width - 1 units hold an anchor at the same offset, whatever
    surrounds them. All ties count.
    """
    n = len(prefix) - 1
    if n < k:
        return np.empty(0, np.int64)
    pos = np.arange(n - k + 1)
    h = range_hash(prefix, pos, pos + k)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    whole = ends - starts >= k + width - 1
    bad = np.zeros(n + 1, np.int32)  # k-grams across a border, and documents below one window
    np.add.at(bad, np.where(whole, np.maximum(ends - k + 1, starts), starts), 1)
    np.add.at(bad, ends, -1)
    out_of = np.cumsum(bad)[: len(h)] > 0
    h[out_of] = top
    if len(h) < width:
        return np.empty(0, np.int64)
    least = sliding(h, width, np.minimum)
    # A window that reaches over a border is none: it must not select.
    crossing = sliding(out_of.astype(np.uint8), width, np.maximum) > 0
    least[crossing] = 0
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.nonzero((most == h) & ~out_of)[0]


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a stage, and so would what they once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # another C library


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of a string column; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        own = offsets[first : last + 1]
        yield first, last, flat[own[0] : own[-1]], own - own[0]
        first = last
    if len(flat) > SLICE_BYTES:
        give_back()


def byte_units(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class _Digests(dict):
    """Digests of words as 64-bit numbers, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_digests = _Digests()


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each range of bytes."""
    return np.frombuffer(b"".join([blake2b(raw[x:y], digest_size=8).digest() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64)


def sequences(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of few values, mixed value by value."""
    out = mix(counts.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in range(int(counts.max()) if len(counts) else 0):
        inside = counts > i
        step = mix(out * np.uint64(0xA24BAED4963EE407) + values[np.minimum(starts + i, len(values) - 1)])
        out = step if inside.all() else np.where(inside, step, out)
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start byte, end byte of each word, and the offset of each document's first word).

    Words are runs without 0x20 and 0x09-0x0D; none crosses a document's border. `exact`
    hashes are digests, which different words don't share.
    """
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(n + 1, np.int8)
    inside[:n] = ~_SPACE[data]
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = edge[: n + 1] == 1, edge[: n + 1] == -1
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    split = borders[(inside[borders] == 1) & (inside[borders - 1] == 1)]
    starts[split] = True
    s = np.nonzero(starts)[0]
    e = np.nonzero(ends)[0]
    if len(split):
        e = np.sort(np.concatenate([e, np.unique(split)]))
    at = np.searchsorted(s, offsets)
    if exact:
        raw = data.tobytes()
        found = map(_digests.__getitem__, [raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])
        return np.fromiter(found, np.uint64, len(s)), s, e, at
    prefix = prefix_hash(_BYTE[data])
    return range_hash(prefix, s, e), s, e, at
