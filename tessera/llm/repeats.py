"""Repeated strings of a fixed length, found through content-defined anchors.

A sequence (bytes of a text, or its words) repeats a window of `length` units only if both
occurrences hold an anchor at the same offset: an anchor is the least k-gram of a window of
k-grams, so it depends on the window alone. Everything that can match around an anchor lies
within its context, length - k units to the left and length to the right.

1. Anchors are counted by the hash of their k-gram (map-side combined); single ones go.
2. Equal contexts (by a digest) are one representative with a count.
3. Representatives that share a k-gram with other contexts meet in one group, which
   bring their text; a matcher (an interval tree of a suffix array, or a suffix automaton)
   says how far each context is repeated.
4. A k-gram with more than `hot` different contexts is lengthened: a window that holds it
   reaches at least half of what is missing to one side, so its contexts are grouped anew
   by the k-gram and the next units to the right, and by the k-gram and those to the left.
   Groups that are still hot are lengthened again, until keys are whole windows, which are
   compared as text and counted. No group grows beyond `hot` members, and a context is sent
   twice as often at each level, at most.
5. Spans return to their documents.

A document is (id, tag): the tag is 32 bits of a hash of the text, so ids that repeat with
other texts stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_side, text_of, written

#: Contexts of a group: about 400 bytes each in the task that matches them, and in its data structure a few times more.
HOT = 20_000
_CONTEXT = "h long, id long, tag int, pos int, lead int, context binary"


@dataclass(frozen=True)
class Unit:
    """What a window is made of. `earlier`: only a later occurrence counts as repeated."""

    words: bool
    length: int
    k: int
    earlier: bool

    @property
    def left(self) -> int:
        return self.length - self.k

    def sequence(self, data: np.ndarray, offsets: np.ndarray):
        """(hashes of the units, offsets of documents in units, start and end byte of each unit)."""
        if self.words:
            h, start, end, at = K.words(data, offsets)
            return h, at, start, end
        return K.byte_units(data), offsets, None, None


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("tag"), text.alias("text"))


def _anchors_of(data: np.ndarray, offsets: np.ndarray, unit: Unit):
    """(offsets of documents in units, start and end byte of each unit, anchors, hashes of their k-grams)."""
    values, at, ws, we = unit.sequence(data, offsets)
    prefix = K.prefix_hash(values)
    a = K.anchors(prefix, at[:-1], at[1:], unit.k, unit.left + 1)
    return at, ws, we, a, K.range_hash(prefix, a, a + unit.k)


def _anchor_counts(rows: DataFrame, unit: Unit) -> DataFrame:
    """(h, c): k-grams that are anchors more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in K.text_slices(b.column("text")):
                h, n = np.unique(_anchors_of(data, offsets, unit)[4].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return rows.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")).filter("c > 1")


def _anchor_rows(rows: DataFrame, unit: Unit) -> DataFrame:
    """(h, hc, id, tag, pos, n, more): each context of a document once; more has the later positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b.column("id"), b.column("tag")
            for first, last, data, offsets in K.text_slices(b.column("text")):
                at, ws, we, a, h = _anchors_of(data, offsets, unit)
                doc = np.searchsorted(at, a, "right") - 1
                start, end = np.maximum(a - unit.left, at[doc]), np.minimum(a + unit.length, at[doc + 1])
                s, e = (ws[start], we[end - 1]) if unit.words else (start, end)
                hc = K.mix(K.digests(data.tobytes(), s, e) + (a - start).astype(np.uint64))
                order = np.lexsort((a, hc, h, doc))
                a, doc, h, hc = a[order], doc[order], h[order], hc[order]
                new = np.ones(len(a), bool)
                new[1:] = (h[1:] != h[:-1]) | (hc[1:] != hc[:-1]) | (doc[1:] != doc[:-1])
                head = np.nonzero(new)[0]
                n = np.diff(np.append(head, len(a)))
                pos = (a - at[doc]).astype(np.int32)
                more = [None] * len(head)
                for i in np.nonzero(n > 1)[0].tolist():
                    more[i] = pos[head[i] + 1 : head[i] + n[i]].tobytes()
                take = pa.array(first + doc[head])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[head].view(np.int64)), pa.array(hc[head].view(np.int64)), ids.take(take), tags.take(take),
                        pa.array(pos[head]), pa.array(n.astype(np.int32)), pa.array(more, pa.binary()),
                    ],
                    names=["h", "hc", "id", "tag", "pos", "n", "more"],
                )

    return rows.mapInArrow(run, "h long, hc long, id long, tag int, pos int, n int, more binary")


def _contexts(rows: DataFrame, reps: DataFrame, unit: Unit) -> DataFrame:
    """reps (h, id, tag, pos, hot) with the text around: lead units to the left, `cut` where units end."""
    per_doc = reps.groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "h", "hot")).alias("at"))
    joined = rows.join(per_doc, rows.id.eqNullSafe(per_doc.id) & (rows.tag == per_doc.tag)).select(rows.id, rows.tag, "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("at")
            for first, last, data, offsets in K.text_slices(b.column("text")):
                _, at, ws, we = unit.sequence(data, offsets) if unit.words else (None, offsets, None, None)
                part = lists.slice(first, last - first)
                wanted = part.flatten()
                count = np.diff(part.offsets.to_numpy())
                doc = np.repeat(np.arange(len(count)), count)
                a = at[:-1][doc] + wanted.field("pos").to_numpy()
                s, e = np.maximum(a - unit.left, at[doc]), np.minimum(a + unit.length, at[doc + 1])
                lead = (a - s).astype(np.int32)
                if unit.words:
                    s, e = ws[s], we[e - 1]
                raw = data.tobytes()
                context = pa.array([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())
                take = pa.array(first + doc)
                yield pa.RecordBatch.from_arrays(
                    [wanted.field("h"), b.column("id").take(take), b.column("tag").take(take), wanted.field("pos"), pa.array(lead), context, wanted.field("hot")],
                    names=["h", "id", "tag", "pos", "lead", "context", "hot"],
                )

    return joined.mapInArrow(run, f"{_CONTEXT}, hot boolean")


#: (contexts of one key, in order of document and position; units left of their anchors; (id, tag, position) of these)
#: -> (index, units to the left, to the right) that repeat.
Matcher = Callable[[list[bytes], list[int], list[tuple]], list[tuple[int, int, int]]]
_SPAN = "id long, tag int, pos int, lo int, hi int, more binary"


def _matched(contexts: DataFrame, matcher: Matcher) -> DataFrame:
    """Spans of the contexts, group by group, streamed in order of the k-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def spans(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            h, pos = part.column("h").to_numpy(), part.column("pos").to_pylist()
            ids, tags = part.column("id").to_pylist(), part.column("tag").to_pylist()
            lead, context = part.column("lead").to_pylist(), part.column("context").to_pylist()
            places = list(zip(ids, tags, pos, strict=True))
            cut = np.concatenate([[0], np.nonzero(h[1:] != h[:-1])[0] + 1, [len(h)]]).tolist()
            out = []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > 1:
                    out += [(ids[s + i], tags[s + i], pos[s + i], lo, hi) for i, lo, hi in matcher(context[s:e], lead[s:e], places[s:e])]
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), *[pa.int32()] * 4]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(out), pa.binary())], names=["id", "tag", "pos", "lo", "hi", "more"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column("h")[0] == batch.column("h")[-1] and sum(x.num_rows for x in held) < 4000:
                continue
            whole = pa.Table.from_batches(held)
            h = whole.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield spans(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    ordered = contexts.select("h", "id", "tag", "pos", "lead", "context").repartition("h").sortWithinPartitions("h", "id", "tag", "pos")
    return ordered.mapInArrow(run, _SPAN)


def _longer_keys(contexts: DataFrame, unit: Unit) -> DataFrame:
    """Contexts (with known_left, known_right: what all of a group share around the anchor) under keys that reach further.

    Of the `missing` units a window has at least `right` on the right, or else `left` on the
    left. Where nothing is missing any more, `window` is the text of the whole window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, keys, lefts, rights, windows = [], [], [], [], []
            columns = (b.column(c).to_pylist() for c in ("h", "lead", "context", "known_left", "known_right"))
            for i, (h, lead, context, known_left, known_right) in enumerate(zip(*columns, strict=True)):
                units = context.split() if unit.words else context
                text = b" ".join if unit.words else bytes
                missing = unit.left - known_left - known_right
                right = (missing + 1) // 2
                left = missing - right + 1
                a, z = lead - known_left, lead + unit.k + known_right
                for side, start, end, more_left, more_right in ((b"r", z, z + right, 0, right), (b"l", a - left, a, left, 0)):
                    if start < 0 or end > len(units):
                        continue
                    key = blake2b(h.to_bytes(8, "little", signed=True) + side + text(units[start:end]), digest_size=8).digest()
                    take.append(i)
                    keys.append(int.from_bytes(key, "little", signed=True))
                    lefts.append(known_left + more_left)
                    rights.append(known_right + more_right)
                    whole = missing == more_left + more_right
                    windows.append(text(units[a - more_left : z + more_right]) if whole else None)
            own = b.take(pa.array(take, pa.int64()))
            cols = [pa.array(keys, pa.int64()), *(own.column(c) for c in ("id", "tag", "pos", "lead", "context"))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(lefts, pa.int32()), pa.array(rights, pa.int32()), pa.array(windows, pa.binary())],
                names=["h", "id", "tag", "pos", "lead", "context", "known_left", "known_right", "window"],
            )

    return contexts.mapInArrow(run, f"{_CONTEXT}, known_left int, known_right int, window binary")


def _equal_windows(rows: DataFrame, unit: Unit) -> DataFrame:
    """Spans of whole windows that occur at several places."""
    start = (F.col("pos") - F.col("known_left")).alias("pos")
    windows = written(rows.select("window", "id", "tag", start).distinct(), "windows")  # a window may hold several anchors
    place = F.struct("id", "tag", "pos")
    known = windows.groupBy("window").agg(F.count("*").alias("c"), F.min(place).alias("first")).filter("c > 1")
    again = windows.join(known, "window")
    if unit.earlier:
        again = again.filter(place != F.col("first"))
    return again.select("id", "tag", "pos", F.lit(0).alias("lo"), F.lit(unit.length).alias("hi"), F.lit(None).cast("binary").alias("more"))


def _hot_spans(contexts: DataFrame, unit: Unit, matcher: Matcher, hot: int) -> list[DataFrame]:
    """Spans of the contexts of hot groups, level by level: as many levels as the binary logarithm of what a k-gram lacks."""
    found = []
    wide = contexts.withColumns({"known_left": F.lit(0), "known_right": F.lit(0)})
    while not wide.isEmpty():
        longer = written(_longer_keys(wide, unit), "longer")
        whole = longer.filter("window is not null")
        if not whole.isEmpty():
            found.append(_equal_windows(whole, unit))
        longer = longer.filter("window is null").drop("window")
        sizes = written(longer.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
        sized = longer.join(sizes, "h")
        found.append(_matched(sized.filter(F.col("c") <= hot), matcher))
        wide = sized.filter(F.col("c") > hot).drop("c")
    return found


def repeated_spans(rows: DataFrame, unit: Unit, matcher: Matcher, hot: int = HOT) -> DataFrame:
    """(id, tag, pos, lo, hi, more) of keyed rows: units pos - lo to pos + hi repeat, at pos and at each position in more."""
    repeated = written(_anchor_rows(rows, unit).join(_anchor_counts(rows, unit), "h"), "anchors")
    place = F.struct("id", "tag", "pos")
    groups = written(repeated.groupBy("h", "hc").agg(F.sum("n").alias("m"), F.min(place).alias("rep"), F.first("c").alias("c")), "groups")
    several = groups.filter("c > m")
    wide = written(several.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("h", F.lit(True).alias("hot")), "hot")
    reps = several.join(small_side(wide), "h", "left").select("h", "rep.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    contexts = _contexts(rows, reps, unit)
    if wide.isEmpty():
        parts = [_matched(contexts, matcher)]
    else:
        contexts = written(contexts, "contexts")
        parts = [_matched(contexts.filter("not hot"), matcher), *_hot_spans(contexts.filter("hot").drop("hot"), unit, matcher, hot)]
    partial = written(reduce(DataFrame.union, parts), "spans")
    copied = groups.filter("m > 1").select(F.col("h").alias("gh"), F.col("hc").alias("ghc"), "rep")
    copies = repeated.join(copied, (F.col("h") == F.col("gh")) & (F.col("hc") == F.col("ghc")))
    lo, hi = F.lit(unit.left).alias("lo"), F.lit(unit.length).alias("hi")
    if not unit.earlier:
        return partial.union(copies.select("id", "tag", "pos", lo, hi, "more"))
    later = copies.filter(place != F.col("rep")).select("id", "tag", "pos", lo, hi, "more")
    # At the representative itself only the positions after the first are copies.
    own = copies.filter((place == F.col("rep")) & F.col("more").isNotNull()).select("id", "tag", F.lit(None).cast("int").alias("pos"), lo, hi, "more")
    return partial.union(later).union(own)


def cover(spans: pa.ListArray, units: np.ndarray, doc_of: np.ndarray | None = None) -> np.ndarray:
    """Boolean mask of covered units; units: offsets of the documents of the slice."""
    total = int(units[-1])
    edge = np.zeros(total + 1, np.int32)
    count = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten()
    if len(flat):
        doc = np.repeat(np.arange(len(count)), count)
        pos, lo, hi = (flat.field(c) for c in ("pos", "lo", "hi"))
        lo, hi = lo.to_numpy(), hi.to_numpy()
        here = pos.is_valid().to_numpy(zero_copy_only=False)
        places, docs, los, his = [pos.fill_null(0).to_numpy()[here]], [doc[here]], [lo[here]], [hi[here]]
        more = flat.field("more")
        for i in np.nonzero(more.is_valid().to_numpy(zero_copy_only=False))[0].tolist():
            extra = np.frombuffer(more[i].as_py(), np.int32)
            places.append(extra)
            docs.append(np.full(len(extra), doc[i]))
            los.append(np.full(len(extra), lo[i]))
            his.append(np.full(len(extra), hi[i]))
        place, doc, lo, hi = (np.concatenate(x) for x in (places, docs, los, his))
        start = np.maximum(units[:-1][doc] + place - lo, units[:-1][doc])
        end = np.minimum(units[:-1][doc] + place + hi, units[1:][doc])
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row (id, tag, text) and its spans."""
    per_doc = spans.groupBy("id", "tag").agg(F.collect_list(F.struct("pos", "lo", "hi", "more")).alias("spans"))
    kind = dict(per_doc.dtypes)["spans"]
    joined = rows.join(per_doc, rows.id.eqNullSafe(per_doc.id) & (rows.tag == per_doc.tag), "left")
    return joined.select(rows.id, "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
