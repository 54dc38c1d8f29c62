"""Approximate vector search by an inverted file: points in cells around centroids, of which a query
reads the nearest few. similarity.top_k is the exact way.

Centroids are fitted on a bounded sample of the points; every point is then put into the cell of its
nearest centroid. The index is a folder of Parquet files, one part for each cell, so that a search reads
the cells that its queries probe and no others. Scores inside probed cells are exact cosines. Cells may be
of any size: they are dealt into blocks, and a query meets each block of a cell by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.functions.vector import as_doubles


@dataclass(frozen=True)
class IndexConfig:
    cells: int = 64
    sample: int = 20_000  # points that centroids are fitted on, at most about so many
    rounds: int = 25
    seed: int = 0
    block: int = 20_000  # points of a cell that meet queries in one group
    most_cells: int = 16_384  # centroids travel with every task


INDEX = IndexConfig()


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def centroids_of(sample: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means: mean directions of the points nearest to each; an empty cell restarts at the point
    that is farthest from its centroid."""
    u = _unit(sample)
    rnd = np.random.default_rng(seed)
    centres = u[rnd.choice(len(u), size=min(cells, len(u)), replace=False)]
    for _ in range(rounds):
        score = u @ centres.T
        own, near = score.argmax(1), score.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, u)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = u[np.argsort(near, kind="stable")[: len(empty)]]
        new = _unit(sums)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def fit(points: DataFrame, config: IndexConfig = INDEX) -> np.ndarray:
    """Centroids of points (point, vector), from a sample by hash of the point that a count bounds. They are
    fitted in one task, which the sample's size bounds."""
    if config.cells > config.most_cells:
        raise ValueError(f"more than {config.most_cells} cells")
    n = points.count()
    share = min(1.0, config.sample / max(n, 1))
    some = points.where((F.pmod(F.xxhash64("point", F.lit(config.seed)), F.lit(1 << 20)) < int(share * (1 << 20) + 1)) & F.col("vector").isNotNull())
    cells, rounds, seed = config.cells, config.rounds, config.seed

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point")
        return pd.DataFrame({"centre": list(centroids_of(np.array(rows.v.tolist(), dtype=np.float64), cells, rounds, seed))})

    found = some.select("point", as_doubles(F.col("vector")).alias("v"), F.lit(0).alias("g")).groupBy("g").applyInPandas(one, "centre array<double>").collect()
    return np.array([r.centre for r in found])


def _nearest(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            score = _unit(v) @ centres.T
            k = min(probes, len(centres))
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(b.num_rows), k)
            out = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), *out.columns], names=["cell", *b.schema.names])

    return run


def assigned(rows: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """rows (..., vector) with cell, once for each of the nearest ``probes`` cells. Rows with a null vector
    go."""
    used = rows.where("vector is not null").withColumn("vector", as_doubles(F.col("vector")))
    fields = [T.StructField("cell", T.IntegerType()), *[T.StructField(f.name, f.dataType) for f in used.schema.fields]]
    if not len(centres):
        return used.limit(0).select(F.lit(0).alias("cell"), "*")
    return used.mapInArrow(_nearest(centres, probes), T.StructType(fields))


def build(points: DataFrame, path: str, config: IndexConfig = INDEX) -> np.ndarray:
    """Write the index of points (point, vector, ...) to a folder that all executors share, and return its
    centroids, which are kept there too. Every point gets into a cell, hot cells into several files."""
    spark = points.sparkSession
    centres = fit(points, config)
    rows = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    assigned(points, centres).repartition("cell", F.pmod(F.xxhash64("point"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/points")
    return centres


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    """Of an index that was built before; at most ``most_cells`` of them."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r.centre for r in rows])


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Groups (key, kind, id, vector) in order, a block's points before its queries; each query's k best."""
    at, points, ids, waiting = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if not ids or not waiting:
            return
        all_ids, v = np.concatenate(ids), _unit(np.concatenate(points))
        for a in range(0, len(waiting), 256):
            part = waiting[a : a + 256]
            score = np.round(_unit(np.array([x[1] for x in part])) @ v.T, 12)
            n = min(k, score.shape[1])
            for (query, _), row in zip(part, score):
                some = np.flatnonzero(row >= np.partition(row, len(row) - n)[len(row) - n])
                best = some[np.lexsort((all_ids[some], -row[some]))[:n]]
                yield pa.RecordBatch.from_arrays([pa.array([query] * n, pa.int64()), pa.array(all_ids[best]), pa.array(row[best])], names=["query", "point", "score"])

    for b in batches:
        key, kind, id_ = (b.column(j).to_numpy() for j in range(3))
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]) if len(key) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
            if key[lo] != at:
                yield from close()
                at, points, ids, waiting = key[lo], [], [], []
            v = b.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            if kind[lo] == 0:
                points.append(v)
                ids.append(id_[lo:hi])
            else:
                waiting += [(int(q), x) for q, x in zip(id_[lo:hi], v)]
    yield from close()


def search(queries: DataFrame, path: str, k: int = 10, probes: int = 8, config: IndexConfig = INDEX) -> DataFrame:
    """(query, point, score, rank): for each query (query, vector) the k nearest points of its ``probes``
    nearest cells, by exact cosine, ties by point. With as many probes as cells the result is exact."""
    spark = queries.sparkSession
    probed = assigned(queries.select("query", "vector"), centroids(spark, path), probes)
    points = spark.read.parquet(f"{path}/points")
    sizes = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / config.block).cast("long").alias("blocks"))
    used = points.join(F.broadcast(sizes), "cell")  # a row for each cell: at most most_cells
    block = F.pmod(F.xxhash64("point"), F.col("blocks"))
    key = lambda block_: F.xxhash64("cell", block_).alias("key")
    left = used.select(key(block), F.lit(0).alias("kind"), F.col("point").cast("long").alias("id"), "vector")
    each = probed.join(F.broadcast(sizes), "cell").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = each.select(key(F.col("b")), F.lit(1).alias("kind"), F.col("query").cast("long").alias("id"), "vector")
    fields = [T.StructField("query", T.LongType()), T.StructField("point", T.LongType()), T.StructField("score", T.DoubleType())]
    met = left.unionByName(right).repartition("key").sortWithinPartitions("key", "kind")
    hits = met.mapInArrow(lambda batches: _meet(batches, k), T.StructType(fields))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of exact hits (query, point) that were found."""
    both = exact.select("query", "point").join(found.select("query", "point", F.lit(1).alias("hit")), ["query", "point"], "left")
    return float(both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)
