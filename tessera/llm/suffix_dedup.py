"""Suffix-array dedup: common-prefix interval tree over the suffixes at repeated anchors.

The contexts of one k-gram are the suffixes of an enhanced suffix array: sorted by what
follows the anchor, with the lengths of common prefixes of neighbours. A stack scan closes
the prefix intervals from the deepest up. Every interval keeps its members in order of what
precedes the anchor, so left-extension diversity is read between neighbours there: two
neighbours share their left extension and no more. An interval of depth R with neighbours
that share L bytes to the left is a repeat of L + R bytes that extends on neither side;
each member gets the longest of them that reaches `length`, against any other occurrence.

Defined results: null text is empty; texts shorter than `length` lose nothing; rows that
repeat are separate occurrences, so their windows are repeated; null ids are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .repeats import HOT, Unit, cover, keyed, repeated_spans, with_spans

LENGTH = 200
K_GRAM = 32


def interval_tree(length: int, k: int):
    """A matcher: maximal repeats of at least `length` bytes around the anchor, per context."""
    left_most = length - k

    def common(a: int, b: int, size: int) -> int:
        return size - ((a ^ b).bit_length() + 7) // 8

    def match(contexts: list[bytes], leads: list[int], places: list[tuple] | None = None) -> list[tuple[int, int, int]]:
        m = len(contexts)
        rights = [int.from_bytes(c[p:].ljust(length, b"\xff"), "big") for c, p in zip(contexts, leads, strict=True)]
        lefts = [int.from_bytes(c[:p][::-1].ljust(left_most, b"\xff"), "big") for c, p in zip(contexts, leads, strict=True)]
        room = [len(c) - p for c, p in zip(contexts, leads, strict=True)]
        order = sorted(range(m), key=rights.__getitem__)
        lo, hi = [0] * m, [0] * m

        def merge(a: list, b: list, depth: int) -> list:
            """Members of two intervals under one of this depth, in order of their left contexts."""
            if len(a) < len(b):
                a, b = b, a
            for item in b:
                at = bisect_left(a, item)
                value, i = item
                for other, j in a[max(0, at - 1) : at + 1]:
                    shared = min(common(value, other, left_most), leads[i], leads[j])
                    if shared + depth >= length:
                        for x in (i, j):
                            lo[x], hi[x] = max(lo[x], shared), max(hi[x], depth)
                a.insert(at, item)
            return a

        stack: list[list] = []  # open intervals: depth, members
        for r in range(1, m + 1):
            i = order[r - 1]
            depth = -1
            if r < m:
                j = order[r]
                depth = min(common(rights[i], rights[j], length), room[i], room[j])
            members = [(lefts[i], i)]
            while stack and stack[-1][0] > depth:
                top, inner = stack.pop()
                members = merge(inner, members, top)
            if r < m:
                if stack and stack[-1][0] == depth:
                    stack[-1][1] = merge(stack[-1][1], members, depth)
                else:
                    stack.append([depth, members])
        return [(i, lo[i], hi[i]) for i in range(m) if hi[i]]

    return match


def repeated_bytes(df: DataFrame, *, length: int = LENGTH, k: int = K_GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) with spans of bytes that a string of `length` covers which also starts elsewhere."""
    unit = Unit(words=False, length=length, k=k, earlier=False)
    rows = keyed(df, id_col, text_col)
    return with_spans(rows, repeated_spans(rows, unit, interval_tree(length, k), hot))


def remove_repeats(df: DataFrame, **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in K.text_slices(b.column("text")):
                gone = cover(b.column("spans").slice(first, last - first), offsets)
                at = np.concatenate([[0], np.cumsum(gone)])
                begins = gone & ~np.concatenate([[False], gone[:-1]])
                begins[offsets[:-1][offsets[:-1] < len(gone)]] = gone[offsets[:-1][offsets[:-1] < len(gone)]]
                runs = np.concatenate([[0], np.cumsum(begins)])
                raw, cut = data[~gone].tobytes(), (offsets - at[offsets]).tolist()
                kept = [raw[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(first, last - first), pa.array(np.diff(offsets)), pa.array(np.diff(at[offsets])), pa.array(np.diff(runs[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return repeated_bytes(df, **options).mapInArrow(run, schema).withColumnRenamed("id", options.get("id_col", "doc_id"))
