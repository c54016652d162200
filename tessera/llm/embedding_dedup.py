"""Embedding near-dedup by sorted projection passes.

Equal vectors are one point with a count. Each pass hashes a point by random hyperplanes,
concatenates the signs and sorts points of a label by that key; in the sorted order each
point is compared with the next `window`. Order positions are global (range partitions and
their sizes), so windows run over partition borders. Pairs that reach the threshold, in
double precision, are united across passes.

What no pass brings together is found exactly. Points of a label are cut into blocks by
their first hash bits; blocks meet pairwise, but for pairs that the triangle inequality of
angles excludes (centres further apart than both radii and the threshold's angle) and pairs
that lie in one component already. In a pair of blocks all cosines are taken, and points of
different components that reach the threshold unite them.

The verified pairs give components; the passes of a window do not see every pair of a
large component, so links inside a component are then completed exactly. Around the component's mean direction,
points within half the threshold's angle are linked to each other by the triangle inequality
of angles, so they are counted and not compared. The rest is compared in blocks of the
component, cut along its hash bits: a point outside meets only blocks whose centre and
radius leave room for a link. Large groups of near copies thus cost their size, not its
square, and chains the blocks that are near each other.

Defined results: null labels, null or zero vectors, and vectors with null or non-finite
components link with nothing; so do null ids; vectors of different dimension never link;
rows that repeat are other vectors, linked; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, written
from .graph import connected_components
from .ngram_join import _Union

THRESHOLD = 0.93
PASSES = 8
WINDOW = 32
BLOCK = 2000
#: Points of a block of the exact search.
EXACT_BLOCK = 8192
BITS = 63
#: Least number of blocks that small components share.
LEAST_SHARED = 256


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Unit vectors in double precision; all lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _vector_of(df: DataFrame, column: str) -> Column:
    """Floats stay floats, which halves what is shuffled; arithmetic is in double precision."""
    return F.col(column) if dict(df.dtypes)[column] == "array<float>" else F.col(column).cast("array<double>")


def points(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(label, vector, point, copies): distinct usable vectors of each label."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("point"), F.col(label_col).cast("string").alias("label"), _vector_of(df, vector_col).alias("vector"))
    usable = F.col("point").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return rows.filter(usable).groupBy("label", "vector").agg(F.min("point").alias("point"), F.count("*").alias("copies"))


def _keys(rows: DataFrame, passes: int, bits: int) -> DataFrame:
    """(pass, key) of each point, as many rows as passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = b.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(1000 + int(dim)).standard_normal((int(dim), passes * bits))
                signs = (_vectors(part.column("vector")) @ planes[dim] > 0).reshape(part.num_rows, passes, bits)
                keys = signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
                take = pa.array(np.repeat(np.arange(part.num_rows), passes))
                own = part.take(take)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(passes, dtype=np.int32), part.num_rows)), pa.array(keys.ravel()), *own.columns], names=["pass", "key", *own.schema.names])

    return rows.mapInArrow(run, f"pass int, key long, label string, dim int, point long, vector {dict(rows.dtypes)['vector']}")


def _ordered_blocks(rows: DataFrame, window: int, block: int) -> DataFrame:
    """The rows in global order, cut into blocks that overlap by the window: adds at and block."""
    order = ["pass", "label", "dim", "key", "point"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_row", F.monotonically_increasing_id()), "passes")
    part, row = F.shiftright("_row", 33).cast("int"), F.col("_row").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.max(row).alias("last")).collect())  # one row per partition
    before, start = 0, {}
    for p, last in sizes:
        start[p] = before
        before += last + 1
    offsets = F.create_map(*[F.lit(x) for pair in start.items() for x in pair]) if start else F.lit(None).cast("map<int,int>")
    at = (F.element_at(offsets, part) + row).cast("long")
    placed = placed.withColumn("at", at).withColumn("_block", F.floor(F.col("at") / block))
    first = F.col("at") % block < window
    return placed.withColumn("block", F.explode(F.when(first & (F.col("_block") > 0), F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block"))))


def candidate_links(rows: DataFrame, threshold: float, passes: int, window: int, block: int) -> DataFrame:
    """Spanning links (a, b) of verified pairs among window neighbours of any pass."""
    own = rows.select("label", F.size("vector").alias("dim"), "point", "vector")
    blocks = _ordered_blocks(_keys(own, passes, BITS), window, block)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        x, dims = np.zeros((len(pdf), int(pdf["dim"].max()))), pdf["dim"].to_numpy()
        for dim in np.unique(dims):
            own = np.nonzero(dims == dim)[0]
            x[own, :dim] = _unit(np.stack(pdf["vector"].iloc[own].to_list()).astype(np.float64))
        group = pd.factorize(pd.MultiIndex.from_frame(pdf[["pass", "label", "dim"]]))[0]
        point, up = pdf["point"].to_numpy(), np.arange(len(pdf))
        a, b = [], []
        for d in range(1, min(window, len(pdf) - 1) + 1):
            near = (np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold) & (group[:-d] == group[d:])
            for i in np.nonzero(near)[0]:
                r, s = i, i + d
                while up[r] != r:
                    up[r] = r = up[up[r]]
                while up[s] != s:
                    up[s] = s = up[up[s]]
                if r != s:
                    up[max(r, s)] = min(r, s)
                    a.append(point[i])
                    b.append(point[i + d])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return blocks.select("pass", "label", "dim", "point", "vector", "at", "block").groupBy("block").applyInPandas(compare, "a long, b long")


def _compare_components(threshold: float):
    """Of a pair of blocks: spanning links (a, b) between components that hold points at the threshold."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _vectors(table.column("vector").chunk(0))
        comp, own = np.unique(table.column("component").to_numpy(), return_inverse=True)
        right = table.column("right").to_numpy()
        p, q = (np.nonzero(~right)[0], np.nonzero(right)[0]) if right.any() else (np.arange(len(x)),) * 2
        low = np.float32(threshold - 1.2e-7 * (x.shape[1] + 8))  # single precision proposes, double decides
        small, union = x.astype(np.float32), _Union(len(comp))
        others, links = small[q].T.copy(), []
        for s in range(0, len(p), 256):
            i, j = np.nonzero(small[p[s : s + 256]] @ others >= low)
            i, j = p[s + i], q[j]
            for c in range(0, len(i), 20_000):
                up = union.roots()[own]
                a, b = i[c : c + 20_000], j[c : c + 20_000]
                apart = up[a] != up[b]
                a, b = a[apart], b[apart]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                for r, t in np.unique(np.stack([own[a[near]], own[b[near]]], 1), axis=0):
                    m, n = union.root(int(r)), union.root(int(t))
                    if m != n:
                        union.up[max(m, n)] = min(m, n)
                        links.append((comp[r], comp[t]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def missed_links(distinct: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links (a, b) of components (or single points) of one label that hold points at the threshold: exact."""
    cells = ["label", "dim", "cell", "part"]
    keyed = _keys(distinct.select("label", F.size("vector").alias("dim"), "point", "vector"), 1, BITS).drop("pass")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / block))).cast("int")
    keyed = keyed.join(keyed.groupBy("label", "dim").agg(bits.alias("bits")), ["label", "dim"]).withColumn("cell", F.expr(f"shiftright(key, {BITS} - bits)")).drop("key", "bits")
    keyed = written(keyed.join(classes.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point")), "cells")
    parts = keyed.groupBy(*cells[:3]).agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = written(keyed.join(parts, cells[:3]).withColumn("part", F.pmod(F.xxhash64("point"), "parts")).drop("parts"), "placed")

    def describe(table: pa.Table) -> pa.Table:
        x = _vectors(table.combine_chunks().column("vector").chunk(0))
        centre = x.sum(0)
        long = np.linalg.norm(centre)
        radius = float(np.arccos(np.clip(x @ (centre / long), -1, 1)).max()) if long > 0 else float(np.pi)
        comp = table.column("component").to_numpy()
        row = {"centre": [(centre / (long or 1.0)).tolist()], "radius": [radius], "least": [int(comp.min())], "most": [int(comp.max())]}
        return pa.table(table.select(cells).slice(0, 1).to_pydict() | row, schema=pa.schema([*(table.schema.field(c) for c in cells), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("least", pa.int64()), ("most", pa.int64())]))

    described = placed.select(*cells, "component", "vector").groupBy(*cells).applyInArrow(describe, "label string, dim int, cell long, part long, centre array<double>, radius double, least long, most long")
    blocks = written(described, "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    dot = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)
    meets = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) <= F.col("a.radius") + F.col("b.radius") + float(np.arccos(threshold)) + 1e-6
    joined = (F.least("a.least", "b.least") != F.greatest("a.most", "b.most")) & ((F.struct("a.cell", "a.part") == F.struct("b.cell", "b.part")) | meets)
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.struct("a.cell", "a.part") <= F.struct("b.cell", "b.part")) & joined)
    pairs = written(pairs.select("a.label", "a.dim", "a.cell", "a.part", F.col("b.cell").alias("cell2"), F.col("b.part").alias("part2")), "pairs")
    keys = [*cells, "cell2", "part2"]
    own = placed.select(*cells, "component", "vector")
    left = own.join(pairs, cells).select(*keys, "component", "vector", F.lit(False).alias("right"))
    apart = pairs.filter("cell != cell2 or part != part2")
    other = own.withColumnsRenamed({"cell": "cell2", "part": "part2"}).join(apart, ["label", "dim", "cell2", "part2"]).select(*keys, "component", "vector", F.lit(True).alias("right"))
    return left.unionByName(other).groupBy(*keys).applyInArrow(_compare_components(threshold), "a long, b long")


def _sums(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre): sum of the unit vectors of each group, added up per batch before the shuffle and by position after it."""
    kinds = dict(members.dtypes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.select([*keys, "vector"]).to_pandas()
            groups = rows.groupby([*keys, rows["vector"].str.len()], sort=False).indices
            first = [int(i[0]) for i in groups.values()]
            total = [_unit(np.stack(rows["vector"].iloc[i].to_list()).astype(np.float64)).sum(0) for i in groups.values()]
            own = b.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), pa.array(total, pa.list_(pa.float64()))], names=[*keys, "total"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    sums = members.select(*keys, "vector").mapInArrow(partial, f"{schema}, total array<double>")
    parts = sums.select(*keys, F.posexplode("total").alias("_at", "_x")).groupBy(*keys, "_at").agg(F.sum("_x").alias("_x"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_l")).select(*keys, F.col("_l._x").alias("centre"))  # one entry per dimension


def _angle(x: Column, y: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))))), F.lit(float(np.pi)))


def _scaled(vector: Column) -> Column:
    """The vector over its largest component, in double precision."""
    values = vector.cast("array<double>")
    most = F.array_max(F.transform(values, lambda x: F.abs(x)))
    return F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(most, F.size(values)).alias("m")), lambda x: x["v"] / x["m"])


def count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(point, links): linked points of the same component, copies counted, exact. Members: (component, label, point, vector, copies)."""
    reach = float(np.arccos(threshold))
    half, slack = reach / 2 - 1e-7, 1e-6
    near = members.select("component", "point", "copies", _scaled(F.col("vector")).alias("vector"))
    centred = near.join(small_side(written(_sums(near, ["component"]), "centres")), "component")
    near = written(centred.withColumn("core", _angle(F.col("vector"), F.col("centre")) <= half).drop("centre"), "cores")
    sizes = near.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("in_core"), F.count("*").alias("held"), F.count_if(~F.col("core")).alias("outside"))
    sizes = written(sizes, "component_sizes")
    core = near.filter("core").join(sizes, "component").select("point", (F.col("in_core") - F.col("copies")).alias("links"))

    # Components with points outside are cut into blocks: all of a small one, those of like hash bits in a large one.
    asked = near.join(sizes.filter("outside > 0").select("component", F.ceil(F.col("held") / block).cast("int").alias("_cells")), "component")
    bits = F.ceil(F.log2(F.col("_cells"))).cast("int")
    keyed = _keys(asked.select(F.col("component").cast("string").alias("label"), F.size("vector").alias("dim"), "point", "vector"), 1, BITS).select("point", "key")
    cell = F.when(F.col("_cells") == 1, F.lit(0)).otherwise(F.expr(f"shiftright(key, {BITS} - least(16, _bits + 4))"))
    celled = written(asked.withColumn("_bits", bits).join(keyed, "point").withColumn("cell", cell.cast("long")).drop("key", "_bits", "_cells"), "cells")
    parts = celled.groupBy("component", "cell").agg(F.ceil(F.count("*") / block).alias("_parts"))
    celled = written(celled.join(parts, ["component", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), "_parts").cast("long")).drop("_parts"), "parts")
    cells = ["component", "cell", "part"]
    centres = celled.join(_sums(celled, cells), cells)
    blocks = centres.groupBy(*cells).agg(F.first("centre").alias("centre"), F.max(_angle(F.col("vector"), F.col("centre"))).alias("radius"), F.sum("copies").alias("_held"))
    blocks = written(blocks.withColumnsRenamed({"cell": "_cell", "part": "_part"}), "blocks")
    outside = celled.filter("not core")
    meets = outside.join(small_side(blocks.select("component", "_cell", "_part", "centre", "radius")), "component").withColumn("_angle", _angle(F.col("vector"), F.col("centre")))
    meets = meets.filter(F.col("_angle") <= F.col("radius") + reach + slack)
    asking = meets.select("component", F.col("_cell").alias("cell"), F.col("_part").alias("part"), "point", "copies", "vector", "core", F.lit(True).alias("asks"))
    held = celled.select(*cells, "point", "copies", "vector", "core", F.lit(False).alias("asks"))
    few = max(LEAST_SHARED, celled.count() // block)  # grows with the members, so that what small components share stays about a block
    shared = F.pmod(F.xxhash64("component"), F.lit(few))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        point, links = [], []
        for _, part in pdf.groupby(["component", "cell", "part"]):
            q, h = part[part["asks"]], part[~part["asks"]]
            if not len(q) or not len(h):
                continue
            y, copies, own, core = _unit(np.stack(h["vector"].to_list())), h["copies"].to_numpy(), h["point"].to_numpy(), h["core"].to_numpy()
            gain = np.zeros(len(h), np.int64)
            for s in range(0, len(q), 500):
                ask = q.iloc[s : s + 500]
                near_to = _unit(np.stack(ask["vector"].to_list())) @ y.T >= threshold
                near_to &= ask["point"].to_numpy()[:, None] != own[None, :]
                point += ask["point"].tolist()
                links += (near_to @ copies).tolist()
                gain += (ask["copies"].to_numpy() @ near_to) * core  # core points learn of those outside here
            point += own[gain > 0].tolist()
            links += gain[gain > 0].tolist()
        return pd.DataFrame({"point": np.array(point, np.int64), "links": np.array(links, np.int64)})

    rows = held.unionByName(asking).withColumn("_shared", shared)
    found = rows.groupBy("_shared", "cell", "part").applyInPandas(compare, "point long, links long")
    return core.unionByName(found).groupBy("point").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, *, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, exact_block: int = EXACT_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    distinct = written(points(df, id_col, vector_col, label_col), "points")
    links = candidate_links(distinct, threshold, passes, window, block)
    classes = written(connected_components(links), "components")
    missed = written(missed_links(distinct, classes, threshold, exact_block), "missed")
    if not missed.isEmpty():
        edges = classes.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes = written(connected_components(edges.unionByName(missed)), "components")
    members = written(distinct.join(classes.withColumnRenamed("node", "point"), "point"), "members")
    counted = written(count_links(members, threshold, block), "links")
    told = distinct.join(classes.withColumnRenamed("node", "point"), "point", "left").join(counted, "point", "left").select(
        "label", "vector", F.coalesce("component", "point").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links")
    )
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("label"), _vector_of(df, vector_col).alias("vector"))
    joined = rows.join(told, (rows.label == told.label) & (rows.vector == told.vector) & rows._id.isNotNull(), "left")
    component = F.coalesce("_component", "_id")
    return joined.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
