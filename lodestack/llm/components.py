"""Connected components of an edge table by alternating stars, with local union-find.

Every round first lets each task merge its own edges by union-find (an edge list shrinks to a
forest), then links the neighbours of each node to the smallest of them.  Rounds are few (about the
logarithm of the longest chain) and each one is a table in the shared folder.  No component, link
list or label set is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import materialize

#: Edges that one task merges at a time; bounds its memory.
LOCAL_EDGES = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def drain() -> pa.RecordBatch:
        nodes = np.fromiter(parent, np.int64, len(parent))
        tops = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
        keep = nodes != tops
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(tops[keep]), pa.array(nodes[keep])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
            parent.setdefault(min(x, y), min(x, y))
        if len(parent) > LOCAL_EDGES:
            yield drain()
    if parent:
        yield drain()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the edge columns ``a`` and ``b``.

    The component is its smallest node.  Nulls and loops are ignored; repeated and reversed edges
    count once; no edges give an empty result.
    """
    links = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    links = materialize(links.where("a < b").mapInArrow(_forest, "a long, b long"), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every greater neighbour is linked to the least node around
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("a"), F.col("y").alias("b"))
        # small star: the same for the smaller neighbours and the node itself
        down = large.where("a < b").distinct()
        low = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e"))
        links = materialize(small.select("e.a", "e.b").where("a < b").distinct(), "edges")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots).distinct()
