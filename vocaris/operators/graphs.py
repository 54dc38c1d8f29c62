"""Connectivity of the affinity graphs of many recordings at once.

Graphs are edges (rec, i, j), windows are (rec, i). Work is joins and aggregates by (rec, window), never by
recording alone, so that one long recording is spread like many short ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocaris.sources.shared import cut


def _follow(hooks: DataFrame) -> DataFrame:
    """(rec, a, to) with every chain of hooks (rec, a, to) followed to its end, by doubling. An end points
    to itself; there are no circles."""
    while True:
        further = hooks.select("rec", F.col("a").alias("to"), F.col("to").alias("end"))
        moved = cut(hooks.join(further, ["rec", "to"]).select("rec", "a", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
        hooks = moved.select("rec", "a", "to")
        if moved.where("moved").isEmpty():
            return hooks


def _contracted(windows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rec, i, c) with the smallest window of each one's component, and (rec, w) with the largest weight
    on a lightest spanning forest of edges (rec, a, b, w).

    In each round every component hooks on to the one at the end of its lightest edge (ties by the two
    ends, so that only pairs hook on to each other, which the smaller one ends), chains are followed, and
    edges inside a component go. Components at least halve each time."""
    both = edges.where("a <> b").select("rec", "a", "b", "w").unionByName(edges.where("a <> b").select("rec", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    live = cut(both.groupBy("rec", "a", "b").agg(F.min("w").alias("w")))
    labels = windows.select("rec", "i", F.col("i").alias("c")).distinct()
    heaviest = None
    while not live.isEmpty():
        ends = F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        best = live.groupBy("rec", "a").agg(F.min_by("b", ends).alias("to"), F.min("w").alias("w"))
        best = cut(best)
        back = best.select("rec", F.col("a").alias("to"), F.col("to").alias("back"))
        # of two that hook on to each other the smaller one is the end
        hooks = best.join(back, ["rec", "to"]).select("rec", "a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("to"))
        roots = cut(_follow(cut(hooks)))
        weights = best.groupBy("rec").agg(F.max("w").alias("w"))
        heaviest = weights if heaviest is None else heaviest.unionByName(weights)
        labels = cut(labels.join(roots.withColumnRenamed("a", "c"), ["rec", "c"], "left").select("rec", "i", F.coalesce("to", "c").alias("c")))
        one = live.join(roots, ["rec", "a"]).select("rec", F.col("to").alias("a"), "b", "w")
        two = one.join(roots.select("rec", F.col("a").alias("b"), F.col("to").alias("other")), ["rec", "b"])
        live = cut(two.where("a <> other").groupBy("rec", "a", F.col("other").alias("b")).agg(F.min("w").alias("w")))
    least = labels.withColumn("c", F.min("i").over(Window.partitionBy("rec", "c")))
    if heaviest is None:
        return least, windows.select("rec", F.lit(None).cast(edges.schema["w"].dataType).alias("w")).limit(0)
    return least, heaviest.groupBy("rec").agg(F.max("w").alias("w"))


def components(windows: DataFrame, edges: DataFrame) -> DataFrame:
    """(rec, i, component) of all windows: the smallest window that edges (rec, i, j) connect it with, in
    either direction; a window without edges is its own. Repeated edges and loops don't matter; edges of
    windows that aren't in windows are used as if they were."""
    ends = edges.select("rec", F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("w"))
    every = windows.select("rec", "i").unionByName(edges.select("rec", "i")).unionByName(edges.select("rec", F.col("j").alias("i")))
    return _contracted(every, ends)[0].select("rec", "i", F.col("c").alias("component"))


def connected(windows: DataFrame, edges: DataFrame) -> DataFrame:
    """(rec, n, parts, connected): windows and components of each recording, and whether it is one."""
    found = components(windows, edges).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") == F.col("component"), 1).otherwise(0)).alias("parts"))
    return found.withColumn("connected", F.col("parts") == 1)


def least_connecting(affinity: DataFrame) -> DataFrame:
    """(rec, p): the least count of strongest neighbours (ties: larger j) that connects a recording's
    windows, of affinities (rec, i, j, w) of all pairs. An edge is there from the count on at which one of
    its ends keeps it, so that p is the largest weight on a lightest spanning tree of these counts: one
    contraction finds it for all recordings, where bisection would contract once for each step."""
    rank = F.row_number().over(Window.partitionBy("rec", "i").orderBy(F.round("w", 12).desc(), F.desc("j")))
    ranked = affinity.select("rec", F.col("i").alias("a"), F.col("j").alias("b"), rank.alias("w"))
    windows = affinity.select("rec", "i").distinct()
    found = _contracted(windows, ranked)[1]
    return windows.select("rec").distinct().join(found, "rec", "left").select("rec", F.coalesce("w", F.lit(1)).alias("p"))
