"""N-gram Jaccard join by multiple-global-order filtering.

Sets of word n-grams link when their Jaccard similarity reaches the threshold. Equal
sets are one node. Filters, each under another global order of the tokens:

1. hash order: the prefix of n - ceil(t n) + 1 least hashes; partners share a token there.
   The prefixes of partners have far more in common than one token: for a random order
   their number is hypergeometric, and `least_shared(n)` is its quantile at `chance`. A
   document with fewer prefix tokens that occur elsewhere has no partner. With chance=0
   that is one token, and the filter loses nothing whatever the draw.
2. rarity order: those shared tokens sorted by how many documents have them. Partners share
   one among the first c - least_shared + 1, so the frequent ones are dropped.
3. the tokens kept group the documents; in a group the whole prefixes are intersected, and
   what passes the exact prefix bound goes on.
4. a second hash order, of the whole set and independent of the first: its prefixes must
   pass the same exact bound. What passes both joins one family.

Texts are read for families only. There sets are counted against each other, and a link is
taken once the shingles themselves, as words, reach the threshold. Groups and families beyond
GROUP members or TOKENS tokens are split into blocks that meet pairwise. Inside a task members already
connected are not compared again, and tasks emit spanning links only, so a group of m
copies costs m rows, not m * m.

Defined results: null or empty text, or white space, is the empty set, n_shingles 0, and
links with nothing; fewer words than n are one shingle; null ids are one node each set,
reported with a null component unless a linked id is known; rows that repeat are equal
sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_side, text_of, written
from .graph import connected_components

WORDS = 5
PERCENT = 80
GROUP = 4096
#: Tokens of a block: about 60 bytes of working memory each, two blocks in a task.
TOKENS = 2_000_000
#: Chance that partners share fewer prefix tokens than the filters ask for.
CHANCE = 1e-12
_SECOND = np.uint64(0x5BD1E9955BD1E995)


def overlap_bound(a, b, percent: int = PERCENT):
    """Least intersection of sets of these sizes that link, elementwise."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


@lru_cache(maxsize=None)
def least_shared(n: int, percent: int = PERCENT, chance: float = CHANCE) -> int:
    """Prefix tokens that partners share but for this chance: lower hypergeometric quantile."""
    p, good = prefix_length(n, percent), -(-percent * n // 100)
    log = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    total, k = 0.0, max(0, p - (n - good))
    while k < p:
        total += math.exp(log(good, k) + log(n - good, p - k) - log(n, p)) if k <= good else 0.0
        if total > chance:
            break
        k += 1
    return max(1, k)


def slice_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets."""
    h, _, _, at = K.words(data, offsets, lower=True, exact=True)
    count = np.diff(at)
    shingles = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), shingles)
    first = np.concatenate([[0], np.cumsum(shingles)])
    start = at[:-1][doc] + np.arange(len(doc)) - first[:-1][doc]
    value = K.sequences(h, start, np.minimum(words, count[doc]))
    _sort_each(value, first)
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def _sort_each(value: np.ndarray, at: np.ndarray) -> None:
    """Each document's values in order, in place."""
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        value[s:e].sort()


def set_digests(value: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit halves of a digest of each set."""
    raw = value.tobytes()
    halves = np.frombuffer(b"".join([blake2b(raw[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))


def shingles_of(text: bytes, words: int) -> set[bytes]:
    """The shingles themselves."""
    w = text.lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def _prefixes(value: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of each sorted set, and their offsets."""
    n = np.diff(at)
    length = np.where(n > 0, prefix_length(n, percent), 0)
    own = np.repeat(np.arange(len(n)), length)
    cut = np.concatenate([[0], np.cumsum(length)])
    return value[at[:-1][own] + np.arange(len(own)) - cut[:-1][own]], cut


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, tag, _text): the tag tells apart rows that share an id, or have none."""
    text = text_of(text_col)
    return df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("tag"), text.alias("_text"))


def sketches(df: DataFrame, words: int, percent: int, chance: float, id_col: str, text_col: str) -> DataFrame:
    """(_id, tag, n, fp, low, need, prefix, second) per row; fp and low identify the set, the prefixes are those of two hash orders."""
    rows = keyed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in K.text_slices(b.column("_text")):
                value, at = slice_sets(data, offsets, words)
                n = np.diff(at)
                other = K.mix(value ^ _SECOND)
                _sort_each(other, at)
                need = np.array([least_shared(int(x), percent, chance) if x else 0 for x in n], np.int32)
                own = [b.column(c).slice(first, last - first) for c in ("_id", "tag")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n.astype(np.int32)), *set_digests(value, at), pa.array(need), _lists(*_prefixes(value, at, percent)), _lists(*_prefixes(other, at, percent))],
                    names=["_id", "tag", "n", "fp", "low", "need", "prefix", "second"],
                )

    return rows.mapInArrow(run, "_id long, tag long, n int, fp long, low long, need int, prefix array<long>, second array<long>")


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            next_up = up[up]
            if (next_up == up).all():
                return up
            self.up = up = next_up


def spanning_links(tokens: np.ndarray, at: np.ndarray, side: np.ndarray, enough, sure) -> list[tuple[int, int]]:
    """Spanning links of the members (tokens[at[i]:at[i+1]]) whose overlap is enough(i, others, overlaps), and that are sure(i, other).

    Each member is counted against the members of other connected parts by an inverted
    list; `side` -1 meets all, else only members of another side.
    """
    m = len(at) - 1
    own = np.repeat(np.arange(m), np.diff(at))
    _, local = np.unique(tokens, return_inverse=True)
    order = np.argsort(local, kind="stable")
    holders = own[order]
    begin = np.searchsorted(local[order], np.arange(local.max() + 2 if len(local) else 1))
    union, links = _Union(m), []
    for i in range(m):
        mine = local[at[i] : at[i + 1]]
        if not len(mine):
            continue
        lengths = begin[mine + 1] - begin[mine]
        shift = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        overlap = np.bincount(holders[shift + np.arange(len(shift))], minlength=m)
        overlap[: i + 1] = 0
        others = np.nonzero(overlap)[0]
        roots = union.roots()
        others = others[roots[others] != roots[i]]
        if side[i] >= 0:
            others = others[side[others] != side[i]]
        others = others[enough(i, others, overlap[others])]
        for j in others:
            a, b = union.root(i), union.root(int(j))
            if a != b and sure(i, int(j)):
                union.up[max(a, b)] = min(a, b)
                links.append((i, int(j)))
    return links


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of lists, and the offset of each list."""
    part = lists.combine_chunks()
    part = part if isinstance(part, pa.ListArray) else part.chunk(0)
    return part.flatten().to_numpy(), part.offsets.to_numpy() - part.offsets[0].as_py()


def blocks_of(held: str, tokens: str, limit: int, most: int) -> Column:
    """Number of blocks of a group with so many members and tokens."""
    return F.ceil(F.greatest(F.col(held) / limit, F.col(tokens) / most)).cast("int").alias("blocks")


def in_blocks(rows: DataFrame, node: str) -> DataFrame:
    """Rows with a block pair: groups of one block stay whole; larger ones meet block by block.

    Adds _x, _y (the pair of blocks) and _side (-1 if all members are to be compared, else the own block).
    """
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    meets = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = rows.withColumn("_own", own).withColumn("_other", meets)
    return rows.select(
        *[c for c in rows.columns if c not in ("_own", "_other")],
        F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"),
    ).withColumn("_side", F.when(F.col("_x") == F.col("_y"), -1).otherwise(own))


def _group_links(rows: DataFrame, keys: list[str], group_links: Callable) -> DataFrame:
    """Spanning links (a, b) of each group of rows(keys..., node, n, _side, more), streamed in order of the keys.

    group_links takes the rows of one group, and returns pairs of their numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links_of(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            node = part.column("node").to_numpy()
            key = np.stack([part.column(k).to_numpy() for k in keys])
            cut = np.concatenate([[0], np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1, [len(node)]])
            a, b = [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s < 2:
                    continue
                found = group_links(part.slice(s, e - s).combine_chunks())
                a += [node[s + i] for i, _ in found]
                b += [node[s + j] for _, j in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held)
            key = np.stack([whole.column(k).to_numpy() for k in keys])
            last = np.nonzero((key != key[:, -1:]).any(0))[0]
            if len(last):
                cut = int(last[-1]) + 1
                yield links_of(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield links_of(pa.Table.from_batches(held))

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "node")
    return ordered.mapInArrow(run, "a long, b long")


def links(df: DataFrame, *, words: int = WORDS, percent: int = PERCENT, group: int = GROUP, block_tokens: int = TOKENS, chance: float = CHANCE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, labels): rows (_id, tag, n, node), and (node, component) of the nodes that link."""
    sets = written(sketches(df, words, percent, chance, id_col, text_col), "sets")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "tag")).alias("r")
    nodes = sets.filter("n > 0").groupBy("fp", "low").agg(first, F.first("n").alias("n")).select("fp", "low", "n", F.col("r._id").alias("_rid"), F.col("r.tag").alias("_rtag"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    reps = sets.filter("n > 0").select("_id", "tag", "fp", "low", "need", "prefix", "second").join(nodes, ["fp", "low"])
    reps = reps.filter(F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("tag") == F.col("_rtag")))
    reps = written(reps.dropDuplicates(["node"]).select("node", "n", "need", "prefix", "second"), "prefixes")

    tokens = reps.select("node", "need", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    # Second order: rarest first, as far as partners must have met.
    per_node = tokens.join(shared, "token").groupBy("node", "need").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("t"))
    kept = per_node.filter(F.size("t") >= F.col("need")).select("node", "need", F.explode(F.expr("slice(t, 1, size(t) - need + 1)")).alias("t"))
    kept = written(kept.select("node", "need", F.col("t.token").alias("token")), "kept")
    mark = F.xxhash64("node")
    most = F.sum(2 * F.col("need") + 12).alias("tokens")  # no prefix is longer
    groups = kept.groupBy("token").agg(F.count("*").alias("held"), most, F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y")).filter("held > 1")
    groups = groups.groupBy("held", "tokens", "x", "y").agg(F.min("token").alias("token")).select("token", blocks_of("held", "tokens", group, block_tokens))  # equal groups once
    members = in_blocks(kept.join(groups, "token"), "node").join(reps.select("node", "n", "prefix", "second"), "node")

    def prefix_enough(n: np.ndarray, p: np.ndarray):
        def enough(i: int, j: np.ndarray, overlap: np.ndarray) -> np.ndarray:
            o = overlap_bound(n[i], n[j], percent)
            fits = o <= np.minimum(n[i], n[j])
            return fits & (overlap >= np.maximum(1, np.minimum(p[i] - n[i] + o, p[j] - n[j] + o)))

        return enough

    def by_prefixes(part: pa.Table) -> list[tuple[int, int]]:
        n = part.column("n").to_numpy().astype(np.int64)
        (flat, at), (other, cut) = _flat(part.column("prefix")), _flat(part.column("second"))

        def both_orders(i: int, j: int) -> bool:
            p, o = prefix_length(n, percent), overlap_bound(n[i], n[j], percent)
            shared = len(np.intersect1d(other[cut[i] : cut[i + 1]], other[cut[j] : cut[j + 1]], assume_unique=True))
            return shared >= max(1, min(p[i] - n[i] + o, p[j] - n[j] + o))

        return spanning_links(flat, at, part.column("_side").to_numpy(), prefix_enough(n, np.diff(at)), both_orders)

    near = _group_links(members.select("token", "_x", "_y", "_side", "node", "n", "prefix", "second"), ["token", "_x", "_y"], by_prefixes)
    families = written(connected_components(near).join(nodes, "node").select("component", "node", "n", "_rid", "_rtag"), "families")
    sizes = families.groupBy("component").agg(F.count("*").alias("held"), F.sum("n").alias("tokens")).select("component", blocks_of("held", "tokens", group, block_tokens))
    chosen = written(families.join(sizes, "component").select("_rid", "_rtag", "node", "component", "blocks", "n"), "members")

    own = (F.col("_id").eqNullSafe(F.col("_rid"))) & (F.col("tag") == F.col("_rtag"))
    texts = keyed(df, id_col, text_col).join(small_side(chosen), own)

    def by_texts(part: pa.Table) -> list[tuple[int, int]]:
        texts = part.column("_text").combine_chunks()
        values, n = [], []
        for _, _, data, offsets in K.text_slices(texts):
            value, at = slice_sets(data, offsets, words)
            values.append(value)
            n.append(np.diff(at))
        n = np.concatenate(n)
        held: list = [None, None]  # a member and its shingles

        def enough(i: int, j: np.ndarray, overlap: np.ndarray) -> np.ndarray:
            return 100 * overlap >= percent * (n[i] + n[j] - overlap)

        def same_words(i: int, j: int) -> bool:
            if held[0] != i:
                held[:] = i, shingles_of(texts[i].as_py(), words)
            other = shingles_of(texts[j].as_py(), words)
            both = len(held[1] & other)
            return 100 * both >= percent * (len(held[1]) + len(other) - both)

        return spanning_links(np.concatenate(values), np.concatenate([[0], np.cumsum(n)]), part.column("_side").to_numpy(), enough, same_words)

    full = texts.select("node", "component", "blocks", "n", F.col("_text").cast("binary").alias("_text"))
    blocked = in_blocks(full, "node").select("component", "_x", "_y", "_side", "node", "n", "_text")
    verified = _group_links(blocked, ["component", "_x", "_y"], by_texts)
    return sets.select("_id", "tag", "n", "fp", "low").join(nodes.select("fp", "low", "node"), ["fp", "low"], "left").drop("fp", "low"), connected_components(verified)


def near_duplicates(df: DataFrame, **options) -> DataFrame:
    """id, n_shingles and component_id (least id that links reach, itself included) of every row."""
    rows, labels = links(df, **options)
    placed = rows.join(labels, "node", "left").withColumn("_class", F.coalesce("component", "node"))
    placed = written(placed.select("_id", "n", "_class"), "classes")
    least = placed.filter("_class is not null").groupBy("_class").agg(F.min("_id").alias("component_id"))
    return placed.join(least, "_class", "left").select(
        F.col("_id").alias(options.get("id_col", "doc_id")), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with its columns: that with the least id (null ids last), by the hash of the text among equal ids.

    Texts without words all stay. Rows are told apart by id and text, so other texts under the id of a copy stay.
    """
    rows, labels = links(df, id_col=id_col, text_col=text_col, **options)
    linked = rows.filter("node is not null").join(labels, "node", "left").withColumn("_class", F.coalesce("component", "node"))
    placed = written(linked.groupBy("_class", "_id", "tag").agg(F.count("*").alias("held")), "classes")
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "tag")
    judged = placed.join(placed.groupBy("_class").agg(F.min(place).alias("keeper")), "_class").withColumn("stays", place.eqNullSafe(F.col("keeper")))
    told = judged.filter("not stays or held > 1").select(F.col("_id").alias("_kid"), F.col("tag").alias("_ktag"), F.col("stays").alias("_kstays"))
    told = written(told, "gone")
    joined = df.join(small_side(told), F.col(id_col).cast("long").eqNullSafe(F.col("_kid")) & (F.xxhash64(text_of(text_col)) == F.col("_ktag")), "left")
    single = joined.filter("_ktag is null").select(*df.columns)
    if told.filter("_kstays").isEmpty():
        return single
    return single.unionByName(joined.filter("_kstays").dropDuplicates(["_kid", "_ktag"]).select(*df.columns))
