"""Connected components by alternating large-star and small-star steps over DataFrames.

Every step is a partial aggregation and a join whose hot nodes are broadcast (bounded in number), so
a component of a third of all rows neither meets in one task nor reaches the driver. At most FEW
links are joined in one task instead, which then holds a few megabytes whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ._spark import forget, join_groups, written

#: So many links are no matter for one task; counted before that way is taken.
FEW = 200_000


def _nearest(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m: the smallest v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("group_size"))
    return join_groups(edges, least, ["u"], ["m"], total, F.xxhash64("v"))


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) by a forest of parents, for few links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for frame in frames:
        for a, b in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([x for x in found if x[0] != x[1]], columns=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of a link but the smallest of its component.

    component is the smallest node reachable. Self links and repeated links change nothing; no links
    give an empty table; a null end is no link. rows: a count that the links do not exceed, if known.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if rows is None:
        edges = written(edges.distinct(), "edges")
        rows = edges.count()
    if rows <= FEW:
        out = written(edges.coalesce(1).mapInPandas(_joined, "node long, component long"), "components", rows)
        forget(edges)
        return out
    edges, state = written(edges.distinct(), "edges", rows), None
    while True:
        n, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if n == 0 or (n, mark) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (n, mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both, 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        near = _nearest(large, n)
        small = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, written(small, "edges", n)
        forget(last)
