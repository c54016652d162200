"""Substring dedup: suffix automata of reference shards, matching statistics of documents.

A reference shard holds passages of documents: what can match one k-gram of words, the
contexts of its occurrences, with those of a document that touch each other merged. The
corpus is its own reference, and sending the automaton of every shard to every document
would be quadratic, so the k-grams say which documents meet which shard, and both are sent
to the same task. There passages stream through the shard's automaton in order of document
and position: each word moves the match on, over all passages before it and all words
before it in its own, and is then added. Where the match is as long as the threshold, the
words of the match go, so what goes are maximal spans above the threshold.

Defined results: null text has no words; fewer words than the threshold lose nothing; rows
that repeat an id and text are one document listed twice, and share its answer; null ids
come before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .repeats import HOT, Unit, cover, keyed, repeated_spans, with_spans

WORDS = 20
K_GRAM = 5
#: Contexts of one automaton: some 40 words with about 700 bytes each where all are new, so 170 MB at most.
SHARD = 6_000


class SuffixAutomaton:
    """Of a growing set of strings (Blumer et al., 1985); symbols are any hashable values."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, c, q: int) -> int:
        nexts, link = self.next, self.link
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def extend(self, last: int, c) -> int:
        """Adds c after the string whose state is `last`; the state of the longer string."""
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def stream(self, symbols: list, grow: bool = True) -> list[int]:
        """Length of the longest known string that ends at each symbol; if it grows, each symbol is known from the next on."""
        nexts, link, length = self.next, self.link, self.length
        state = size = last = 0
        out = []
        for c in symbols:
            while state and c not in nexts[state]:
                state = link[state]
                size = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                size += 1
            out.append(size)
            if grow:
                last = self.extend(last, c)
                while state and length[link[state]] >= size:  # a state was split below the match
                    state = link[state]
        return out


def automaton_matcher(length: int, shard: int = SHARD):
    """A matcher: spans of words that occurred before, in passages merged from the contexts of a document.

    Contexts beyond `shard` are further reference shards: one automaton is held at a time, and all
    later contexts stream through it.
    """

    def match(contexts: list[bytes], leads: list[int], places: list[tuple]) -> list[tuple[int, int, int]]:
        m, found = len(contexts), []
        texts = [c.split() for c in contexts]
        begins = [place[2] - lead for place, lead in zip(places, leads, strict=True)]
        for first in range(0, m, shard):
            automaton = SuffixAutomaton()
            i = first
            while i < m:
                words, j = list(texts[i]), i + 1
                while j < m and places[j][:2] == places[i][:2] and begins[j] <= begins[i] + len(words):
                    words += texts[j][begins[i] + len(words) - begins[j] :]
                    j += 1
                ends = automaton.stream(words, i < first + shard)
                spans: list[list[int]] = []  # of the passage, merged where they overlap
                for at, size in enumerate(ends):
                    if size >= length:
                        if spans and at - size + 1 <= spans[-1][1]:
                            spans[-1] = [min(spans[-1][0], at - size + 1), at + 1]
                        else:
                            spans.append([at - size + 1, at + 1])
                found += [(i, leads[i] - s, e - leads[i]) for s, e in spans]
                i = j
        return found

    return match


def repeated_words(df: DataFrame, *, length: int = WORDS, k: int = K_GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) with spans of words that a window of `length` covers which also starts earlier."""
    unit = Unit(words=True, length=length, k=k, earlier=True)
    rows = keyed(df, id_col, text_col)
    return with_spans(rows, repeated_spans(rows, unit, automaton_matcher(length), hot))


def remove_repeats(df: DataFrame, **options) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and kept (remaining words, joined by one space) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in K.text_slices(b.column("text")):
                _, start, end, at = K.words(data, offsets)
                gone = cover(b.column("spans").slice(first, last - first), at)
                number = np.concatenate([[0], np.cumsum(gone)])
                s, e = start[~gone], end[~gone]
                size = e - s + 1
                stop = np.cumsum(size)
                source = np.repeat(s - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
                text = np.append(data, np.uint8(0x20))[np.minimum(source, len(data))]
                text[stop - 1] = 0x20
                raw, cut = text.tobytes(), np.concatenate([[0], stop])[at - number[at]].tolist()
                kept = [raw[x : max(x, y - 1)] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(first, last - first), pa.array(np.diff(at)), pa.array(np.diff(number[at])), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())],
                    names=["id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    schema = "id long, n_words long, n_removed long, kept_sha256 string, kept binary"
    return repeated_words(df, **options).mapInArrow(run, schema).withColumnRenamed("id", options.get("id_col", "doc_id"))
