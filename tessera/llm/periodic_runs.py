"""Periodic runs: harmonic grid probing over the words of each document.

A run of period p and length of at least 2p holds p consecutive words that equal the word
p further on, so one of them lies on the grid of the multiples of p. For all p together the
grids have n log n points. Periods are probed in octaves [P, 2P), for all documents of a
slice at once: words at jp and (j + 1)p are compared, and survivors are extended by
comparing chunks that double, each at most to the next grid point; neighbours whose chunks
meet are one run. No period of an octave divides another, so grid points inside runs of an
earlier octave whose period divides p are skipped: what they belong to is that run. What is
left is kept if no divisor of p is a period of it.

Words are equal by a 64-bit BLAKE2b digest. A document is handled whole, about 60 bytes for
each byte of its text; probes and chunks are taken in blocks of a million.

Defined results: null, empty or blank text has no words, no runs and an empty collapsed
text; null ids and repeated rows give a row each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of

MIN_WORDS = 12
#: Probes or words compared in one step.
CELLS = 1 << 20
_CHUNK = 4096


@lru_cache(4096)
def _prime_factors(n: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*out, n) if n > 1 else tuple(out)


def _reach(w: np.ndarray, first: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from `first` on, in the direction of `step`, equal the word a period later; at most `limit`."""
    out = np.zeros(len(first), np.int64)
    live, chunk = np.nonzero(limit > 0)[0], 2
    while len(live):
        ahead, on = np.arange(chunk), []
        for part in np.array_split(live, -(-len(live) * chunk // CELLS)):
            room = (limit[part] - out[part])[:, None] > ahead
            at = np.where(room, (first[part] + step * out[part])[:, None] + step * ahead, first[part][:, None])
            same = (w[at] == w[at + period[part][:, None]]) & room
            got = np.where(same.all(1), chunk, same.argmin(1))
            out[part] += got
            on.append(part[(got == chunk) & (out[part] < limit[part])])
        live, chunk = np.concatenate(on), min(chunk * 2, _CHUNK)
    return out


class _Octave:
    """The runs whose periods lie in one octave, by start, each with the run among those up to it that reaches furthest."""

    def __init__(self, start: np.ndarray, length: np.ndarray, period: np.ndarray):
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.period = start[order], (start + length)[order], period[order]
        most = np.maximum.accumulate(self.end)
        self.furthest = np.maximum.accumulate(np.where(self.end == most, np.arange(len(most)), 0))

    def holds(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the words at `at` and a period later lie in a run whose period divides theirs."""
        i = np.searchsorted(self.start, at, "right") - 1
        run = self.furthest[np.maximum(i, 0)]
        return (i >= 0) & (self.end[run] > at + period) & (period % self.period[run] == 0)


def _probe(w: np.ndarray, base: np.ndarray, end: np.ndarray, period: np.ndarray, known: list[_Octave], least: int) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the runs of one period for each of some documents that begin at `base`."""
    points = (end - base - 1) // period
    row = np.repeat(np.arange(len(base)), points)
    j = np.arange(len(row)) - np.repeat(np.cumsum(points) - points, points)
    at = base[row] + j * period[row]
    hit = np.nonzero(w[at] == w[at + period[row]])[0]
    for octave in known:
        hit = hit[~octave.holds(at[hit], period[row[hit]])]
    row, j, at = row[hit], j[hit], at[hit]
    p = period[row]
    right = _reach(w, at, p, np.minimum(p, end[row] - at - p), 1)
    joined = np.zeros(len(at), bool)  # with the grid point before
    joined[1:] = (row[1:] == row[:-1]) & (j[1:] == j[:-1] + 1) & (right[:-1] == p[:-1])
    first = np.nonzero(~joined)[0]
    last = np.append(first[1:] - 1, len(at) - 1)[: len(first)]
    stop = at[last] + right[last]
    # What would be too short even with a whole period to the left needs no look there.
    enough = np.maximum(least - p[first], p[first])
    near = stop - at[first] + np.minimum(p[first], at[first] - base[row[first]]) >= enough
    first, stop, enough = first[near], stop[near], enough[near]
    start = at[first] - _reach(w, at[first] - 1, p[first], np.minimum(p[first], at[first] - base[row[first]]), -1)
    long = stop - start >= enough
    start, stop, p = start[long], stop[long], p[first][long]
    own = [all(not np.array_equal(w[s : s + q], w[s + q // f : s + q // f + q]) for f in _prime_factors(q)) for s, q in zip(start.tolist(), p.tolist(), strict=True)]
    own = np.array(own, bool)
    return start[own], (stop - start + p)[own], p[own]


def runs_of(w: np.ndarray, at: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least max(least, 2 * period) words in documents w[at[i]:at[i + 1]], in order of start, then period."""
    base, size = at[:-1], np.diff(at)
    known: list[_Octave] = []
    found = [(np.empty(0, np.int64),) * 3]
    low = 1
    while len(size) and low <= size.max() // 2:
        some = np.nonzero((size >= 2 * low) & (size >= least))[0]
        periods = np.minimum(2 * low, size[some] // 2 + 1) - low
        doc = np.repeat(some, periods)
        period = low + np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods)
        work = np.cumsum((size[doc] - 1) // period)
        cuts = np.unique(np.searchsorted(work, np.arange(CELLS, work[-1], CELLS))) if len(work) else []
        fresh = [_probe(w, base[d], base[d] + size[d], p, known, least) for d, p in zip(np.split(doc, cuts), np.split(period, cuts), strict=True)]
        start, length, period = (np.concatenate(x) for x in zip(*fresh, strict=True))
        if len(start):
            known.append(_Octave(start, length, period))
            found.append((start, length, period))
        low *= 2
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeats(at: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words some run holds after its first period."""
    edge = np.zeros(at[-1] + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:-1] > 0


def _tandem(at: np.ndarray, first: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The word that stands at each place when words from `first` on repeat `period` of them; nan leaves a document alone."""
    source = np.arange(at[-1])
    for d in np.nonzero(~np.isnan(first) & ~np.isnan(period))[0]:
        a, n, p = int(first[d]), int(at[d + 1] - at[d]), int(period[d])
        if a < n:
            source[at[d] + a : at[d + 1]] = at[d] + a + np.arange(n - a) % p
    return source


def find_runs(df: DataFrame, *, min_words: int = MIN_WORDS, tandem: tuple[Column, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (array<struct<start, length, period>> in that order) and collapsed (words without repeats, joined by one space).

    `tandem` (first word, period) reads a text as if from that word on a period of words were repeated.
    """
    first, period = tandem or (F.lit(None), F.lit(None))
    rows = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), first.cast("double").alias("_first"), period.cast("double").alias("_period"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, last, data, offsets in K.text_slices(b.column("_text")):
                w, s, e, at = K.words(data, offsets, exact=True)
                source = _tandem(at, *(b.column(c).slice(one, last - one).to_numpy(zero_copy_only=False).astype(float) for c in ("_first", "_period")))
                w, s, e = w[source], s[source], e[source]
                start, length, period = runs_of(w, at, min_words)
                gone = repeats(at, start, length, period)
                raw, kept, number = data.tobytes(), np.nonzero(~gone)[0], np.concatenate([[0], np.cumsum(~gone)])[at]
                s, e = s[kept], e[kept]
                texts = [b" ".join([raw[x:y] for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)]) for i, j in zip(number[:-1].tolist(), number[1:].tolist(), strict=True)]
                cut = np.searchsorted(start, at)
                own = start - np.repeat(at[:-1], np.diff(cut))
                items = pa.StructArray.from_arrays([pa.array(x) for x in (own, length, period)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(one, last - one), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items), pa.array(texts, pa.binary())],
                    names=["_id", "n_words", "runs", "collapsed"],
                )

    schema = f"_id {dict(rows.dtypes)['_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
