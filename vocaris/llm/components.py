"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocaris.llm.frames import cut, map_arrow

#: Edges that one task joins in memory.
EDGES_PER_TASK = 250_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around each part's smallest node (union-find)."""
    parent: dict = {}
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n in (x, y):
                parent.setdefault(n, n)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes, roots = [], []
        for n in parent:
            r = n
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            if r != n:
                nodes.append(n)
                roots.append(r)
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000], kind), pa.array(roots[at : at + 50_000], kind)], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Tasks first turn the edges that they hold, at most about EDGES_PER_TASK, into stars. As long as
    several tasks are needed for that, rounds of large-star and small-star steps hang every node's
    neighbours on its smallest one, which ends in one star for each component after about log(nodes)
    rounds. Minima are partial aggregates and joins that Spark can split, so that a hub's neighbours
    never meet in one task. Edges are written to the checkpoint folder between steps; nothing but two
    numbers a round comes to the driver.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before, tasks = mark, -(-mark[0] // EDGES_PER_TASK)
        state = cut(map_arrow(state.coalesce(tasks), _contract, state.schema.fields))
        if tasks == 1:
            break
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are cut, so that the joins have plain exchanges and Spark can split a hub's edges
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
