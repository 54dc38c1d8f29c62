"""Hard negatives of anchors, by a full sort of each anchor's integer scores.

Vectors are turned into integers, so that scores are exact. Points are dealt into tiles by a hash of the
id and anchors into blocks, and every block meets every tile in a group of its own: one matrix product
gives the scores, and each anchor's row of them is sorted whole by (score descending, id), as one number
for both. A first pass reads each anchor's best points of its own label, its positives. In a second one
each positive's upper limit is found by binary search in the sorted scores, and the first k entries of
another label from there down to the lower limit are read. Of every tile come at most as many rows as
the answer has, which are then ranked over all tiles: nothing is cut off before it is known to lose.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; of
rows with one id one takes part, the one of smallest label, then vector; vectors of different lengths
don't meet; ties fall to the smaller id; an anchor without positives, and an empty table, give no rows;
other columns aren't read. Components whose scores might not fit into 63 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm.frames import map_arrow


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    lower: int = 30  # per cent of the positive's score
    upper: int = 90
    tile: int = 65_536  # points of a group at most, and fewer where cores would be idle
    least_tile: int = 2048
    block: int = 2048  # anchors of a group
    strip_cells: int = 4_000_000  # scores in memory at a time


SETTINGS = Settings()


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if one is null, infinite or no number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scores(anchors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = (int(np.abs(anchors).max(initial=0)) * int(np.abs(points).max(initial=0))) * anchors.shape[1]
    if most < 1 << 53:  # then doubles are exact
        return (anchors.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return anchors @ points.T
    raise ArithmeticError("scores don't fit into 63 bits")


def sorted_scores(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, descending scores) of a row whose places ascend by id: score first, then id."""
    bits = max(1, (len(row) - 1).bit_length())
    if len(row) and max(abs(int(row.min())), abs(int(row.max()))) < 1 << (62 - bits):
        both = np.sort((-row << bits) | np.arange(len(row)))
        order = both & ((1 << bits) - 1)
    else:
        order = np.lexsort((np.arange(len(row)), -row))
    return order, row[order]


Reader = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], list[tuple]]


def _meet(batches: Iterator[pa.RecordBatch], read: Reader, names: list[str], cells: int) -> Iterator[pa.RecordBatch]:
    """Groups (cell, kind, id, label, v, more) in order, a cell's points before its anchors. read(anchor,
    ids, labels, row of scores) gives the rows of an anchor."""
    at, held, points, waiting = None, [], None, []

    def answer() -> list[tuple]:
        ids, labels, v = points
        rows = []
        step = max(1, cells // max(1, len(ids)))
        for a in range(0, len(waiting), step):
            part = waiting[a : a + step]
            for anchor, row in zip(part, scores(np.array([x["v"] for x in part], dtype=np.int64).reshape(len(part), -1), v)):
                rows += read(anchor, ids, labels, row)
        return rows

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def close() -> Iterator[pa.RecordBatch]:
        if points is not None and waiting and (rows := answer()):
            yield batch(rows)

    for b in batches:
        cell, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])]) if len(cell) else []
        for lo, hi in zip(starts, [*starts[1:], len(cell)]):
            if cell[lo] != at:
                yield from close()
                at, held, points, waiting = cell[lo], [], None, []
            part = b.slice(lo, hi - lo)
            if kind[lo] == 0:
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4))))
                continue
            if held:
                points, held = tuple(np.concatenate(x) for x in zip(*held)), []
                once = np.r_[True, points[0][1:] != points[0][:-1]]  # repeated ids: the first
                points = tuple(x[once] for x in points)
            waiting += part.select(["id", "label", "v", "more"]).to_pylist()
    yield from close()


def _dealt(points: DataFrame, anchors: DataFrame, tiles: int, blocks: int) -> DataFrame:
    """Every block of anchors beside every tile of points, sorted inside groups."""
    tile, block = F.pmod(F.xxhash64("id"), F.lit(tiles)), F.pmod(F.xxhash64("id"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    left = points.select("id", "label", "v", none.alias("more"), tile.alias("tile"), every(blocks).alias("block"), F.lit(0).alias("kind"))
    right = anchors.select("id", "label", "v", "more", every(tiles).alias("tile"), block.alias("block"), F.lit(1).alias("kind"))
    rows = left.unionByName(right).select(F.xxhash64(F.size("v"), "tile", "block").alias("cell"), "kind", "id", "label", "v", "more")
    # the vector is in the order too, so that of repeated ids the same one is first everywhere
    return rows.repartition("cell").sortWithinPartitions("cell", "kind", "id", "label", "v")


def mine(rows: DataFrame, is_anchor: Column, settings: Settings = SETTINGS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its
    first positives of the same label, and for each of these the first negatives, entries of another
    label whose score is between lower and upper per cent of the positive's. is_anchor may read id and
    label (as ``id`` and ``label``)."""
    points = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), integers(F.col(vector_col), settings.scale).alias("v")).where("id is not null and label is not null and v is not null")
    once = Window.partitionBy("id").orderBy("label", "v")
    anchors = points.where(is_anchor).withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    n, m = rows.count(), anchors.count()
    spark = rows.sparkSession
    tiles = max(-(-n // settings.tile), min(int(spark.sparkContext.defaultParallelism), n // settings.least_tile), 1)
    blocks = max(1, -(-m // settings.block))
    long, cells = lambda *names: [T.StructField(x, T.LongType()) for x in names], settings.strip_cells
    most, k, lower, upper = settings.positives, settings.negatives, settings.lower, settings.upper

    def best(anchor: dict, ids: np.ndarray, labels: np.ndarray, row: np.ndarray) -> list[tuple]:
        order, high = sorted_scores(row)
        own = np.flatnonzero((labels[order] == anchor["label"]) & (ids[order] != anchor["id"]))[:most]
        return [(anchor["id"], int(ids[order[i]]), int(high[i])) for i in own]

    def hard(anchor: dict, ids: np.ndarray, labels: np.ndarray, row: np.ndarray) -> list[tuple]:
        order, high = sorted_scores(row)
        other = np.flatnonzero(labels[order] != anchor["label"])
        falling, out = -high[other], []
        for p in anchor["more"]:
            top, least = upper * p["score"] // 100, -(-lower * p["score"] // 100)
            start = int(np.searchsorted(falling, -top))
            for i in other[start : start + k]:
                if high[i] < least:
                    break
                out.append((anchor["id"], p["id"], int(ids[order[i]]), p["score"], int(high[i])))
        return out

    empty = anchors.withColumn("more", F.lit(None).cast("array<struct<id:bigint,score:bigint>>"))
    names = ["anchor", "id", "score"]
    near = map_arrow(_dealt(points, empty, tiles, blocks), lambda b: _meet(b, best, names, cells), long(*names))
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    # at most `positives` rows an anchor
    grouped = chosen.groupBy(F.col("anchor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("more"))
    names2 = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    found = map_arrow(_dealt(points, anchors.join(grouped, "id"), tiles, blocks), lambda b: _meet(b, hard, names2, cells), long(*names2))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, a.label = b.label AS same, b.id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10"""
