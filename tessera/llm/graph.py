"""Connected components of an edge table by alternating large-star and small-star steps.

(Kiveris et al., 2014.) Every step is a map-side combined minimum and a join, so a hub
with a third of all nodes is split like any skewed join; nothing is collected. Before the
first step each task replaces every batch of edges by stars to the least node that the
batch connects. Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of edges (u, v): every node with the least node that its edges connect it to."""
    for b in batches:
        up: dict[int, int] = {}
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            for x in (u, v):
                up.setdefault(x, x)
            while up[u] != u:
                up[u] = u = up[up[u]]
            while up[v] != v:
                up[v] = v = up[up[v]]
            up[max(u, v)] = min(u, v)
        ends = []
        for x in sorted(up):  # a parent is less than its node, so it is final by then
            up[x] = up[up[x]]
            if up[x] != x:
                ends.append((x, up[x]))
        u, v = zip(*ends, strict=True) if ends else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 1000) -> DataFrame:
    """(node, component): each node of an edge, and the least node that it reaches. Steps go on until nothing changes; beyond `rounds` it fails."""
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u != v")
    state = written(pairs.mapInArrow(_stars, "u long, v long").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        state = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
