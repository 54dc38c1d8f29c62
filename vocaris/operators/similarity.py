"""Vector search, affinities and affinity graphs.

Affinities exist per recording: (rec, i, j, w) for all pairs of a recording's windows, so that their
number is bounded by the largest recording, never by the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.functions.vector import as_doubles
from vocaris.sources.shared import cut

#: Points and queries that one group holds, and scores in memory at a time.
TILE_POINTS = 100_000
CHUNK_QUERIES = 8192
STRIP_CELLS = 4_000_000


def _unit_rows(column: pa.ListArray) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _answers(ids: np.ndarray, v: np.ndarray, points: list[tuple[str, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Each query's own k best of each part, strip by strip of points."""
    for name, own_ids, own in points:
        strip = max(k, STRIP_CELLS // len(ids))
        best, of = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for a in range(0, len(own_ids), strip):
            b = min(a + strip, len(own_ids))
            best = np.concatenate((best, v @ own[a:b].T), axis=1)
            of = np.concatenate((of, np.broadcast_to(own_ids[a:b], (len(ids), b - a))), axis=1)
            # scores that agree to 12 digits are ties, which fall to the smaller point
            order = np.lexsort((of, -np.round(best, 12)), axis=1)[:, :k] if best.shape[1] <= 4 * k else _k_best(best, of, k)
            best, of = np.take_along_axis(best, order, axis=1), np.take_along_axis(of, order, axis=1)
        n = best.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(of.ravel()), pa.array([name] * of.size, pa.string()), pa.array(best.ravel())], names=["query", "point", "part", "score"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (tile, chunk, kind, id, part, vector) in order, a tile's points before the chunk's queries,
    which are answered a batch at a time."""
    at, held, points = None, [], None
    for b in batches:
        tile, chunk, kind, ids = (b.column(c).to_numpy() for c in range(4))
        new = (tile[1:] != tile[:-1]) | (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])
        cuts = np.flatnonzero(np.concatenate(([True], new))) if len(tile) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(tile)]):
            if (tile[lo], chunk[lo]) != at:
                at, held, points = (tile[lo], chunk[lo]), [], None
            v = _unit_rows(b.column(5).slice(lo, hi - lo))
            if kind[lo] == 0:
                held.append((ids[lo:hi], np.array(b.column(4).slice(lo, hi - lo).to_pylist(), dtype=str), v))
                continue
            if points is None:
                if not held:
                    continue
                all_ids, parts, all_v = (np.concatenate(x) for x in zip(*held))
                points, held = [(str(name), all_ids[own], all_v[own]) for name in np.unique(parts) for own in [np.flatnonzero(parts == name)]], []
            yield from _answers(ids[lo:hi], v, points, k)


def _k_best(score: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties by point."""
    out = np.empty((len(score), k), dtype=np.int64)
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - 1e-9
    for r in range(len(score)):
        some = np.flatnonzero(score[r] >= least[r])
        out[r] = some[np.lexsort((of[r, some], -np.round(score[r, some], 12)))[:k]]
    return out


def top_k(queries: DataFrame, points: DataFrame, k: int = 10, partition: str | None = None) -> DataFrame:
    """(query, point, score, rank): for each query (query, vector) the k points (point, vector) of
    highest cosine, ties by point; with partition, per query and value of that column of points.

    Points are dealt into tiles and queries into chunks of bounded size, and every chunk meets every
    tile in a group of its own: matrix products over strips of points, of which each query keeps its k
    best for each part. What is shuffled afterwards is k rows for each query and tile. Nothing is
    broadcast.
    """
    n, m = points.count(), queries.count()
    tiles, chunks = max(1, -(-n // TILE_POINTS)), max(1, -(-m // CHUNK_QUERIES))
    part = F.col(partition).cast("string") if partition else F.lit("")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))) if count > 1 else F.lit(0)
    own = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    row = lambda key, part_: (F.col(key).cast("long").alias("id"), part_.alias("part"), as_doubles(F.col("vector")).alias("vector"))
    rows = points.select(own("point", tiles).alias("tile"), every(chunks).alias("chunk"), F.lit(0).alias("kind"), *row("point", F.coalesce(part, F.lit("")))).unionByName(
        queries.select(every(tiles).alias("tile"), own("query", chunks).alias("chunk"), F.lit(1).alias("kind"), *row("query", F.lit("")))
    )
    fields = [T.StructField("query", T.LongType()), T.StructField("point", T.LongType()), T.StructField("part", T.StringType()), T.StructField("score", T.DoubleType())]
    hits = rows.repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "kind").mapInArrow(lambda batches: _search(batches, k), T.StructType(fields))
    order = Window.partitionBy("query", "part").orderBy(F.round("score", 12).desc(), "point")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked if partition else ranked.drop("part")


#: Rows of a recording in a block; a group is two blocks of one recording.
MATRIX_BLOCK = 512


def _products(batches: Iterator[pa.RecordBatch], unit_: bool, output: str) -> Iterator[pa.RecordBatch]:
    """Rows (rec, a, b, kind, k, v) in order, the left block's rows (kind 0) before the right one's: the
    products of all pairs of a group."""
    at, left, right, rec = None, [], [], None

    def close() -> Iterator[pa.RecordBatch]:
        if not left or not right:
            return
        (i, x), (j, y) = ((np.concatenate([k for k, _ in side]), np.concatenate([v for _, v in side])) for side in (left, right))
        c = x @ y.T
        yield pa.RecordBatch.from_arrays([pa.array([rec] * c.size, kind_of), pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(c.ravel())], names=["rec", "i", "j", output])

    for batch in batches:
        kind_of = batch.schema.field(0).type
        recs, a, b, kind, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        new = (recs[1:] != recs[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])
        cuts = np.flatnonzero(np.concatenate(([True], new))) if len(k) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(k)]):
            if (recs[lo], a[lo], b[lo]) != at:
                yield from close()
                at, left, right, rec = (recs[lo], a[lo], b[lo]), [], [], batch.column(0)[int(lo)].as_py()
            column = batch.column(5).slice(lo, hi - lo)
            v = _unit_rows(column) if unit_ else column.flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            (right if kind[lo] else left).append((k[lo:hi], v))
    yield from close()


def _all_products(rows: DataFrame, unit_: bool, output: str) -> DataFrame:
    """(rec, i, j, output): products of all pairs of a recording's rows (rec, k, v: array). A recording is
    dealt into blocks, and each two blocks of it are a group of their own."""
    blocks = rows.groupBy("rec").agg(F.ceil(F.count(F.lit(1)) / MATRIX_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    placed = rows.join(blocks, "rec").select("rec", "k", as_doubles(F.col("v")).alias("v"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = lambda a, b, kind: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(kind).alias("kind"))
    sides = placed.select("rec", F.explode(F.array(side("own", "other", 0), side("other", "own", 1))).alias("x"), "k", "v").select("rec", "x.a", "x.b", "x.kind", "k", "v")
    k = rows.schema["k"].dataType
    fields = [T.StructField("rec", rows.schema["rec"].dataType), T.StructField("i", k), T.StructField("j", k), T.StructField(output, T.DoubleType())]
    return sides.repartition("rec", "a", "b").sortWithinPartitions("rec", "a", "b", "kind", "k").mapInArrow(lambda batches: _products(batches, unit_, output), T.StructType(fields))


def pairs(windows: DataFrame) -> DataFrame:
    """(rec, i, j, c): cosines of all pairs of a recording's windows (rec, k, embedding)."""
    return _all_products(windows.select("rec", "k", F.col("embedding").alias("v")), True, "c")


def affinity_half(cosines: DataFrame) -> DataFrame:
    """Cosines moved to [0, 1]: w = (c + 1) / 2."""
    return cosines.select("rec", "i", "j", ((F.col("c") + 1) / 2).alias("w"))


def affinity_minmax(cosines: DataFrame) -> DataFrame:
    """Every column scaled to [0, 1] by its own extremes, hence not symmetric; a constant column is 0."""
    w = Window.partitionBy("rec", "j")
    low, high = F.min("c").over(w), F.max("c").over(w)
    return cosines.select("rec", "i", "j", F.when(high > low, (F.col("c") - low) / (high - low)).otherwise(0.0).alias("w"))


def nearest_midpoint(base: DataFrame, other: DataFrame) -> DataFrame:
    """(rec, idx, other): for each base segment (rec, idx, s, e), the segment of other whose middle is
    nearest, the earlier one if two are. An as-of join: both sides in one order of time, with the last
    middle at or before and the first at or after each base middle."""
    mid = lambda df, kind: df.select("rec", ((F.col("s") + F.col("e")) / 2).alias("m"), F.lit(kind).alias("kind"), "idx")
    both = mid(other, 0).unionByName(mid(base, 1))
    cand = F.when(F.col("kind") == 0, F.struct("m", "idx"))
    # of equal middles the smallest idx counts, on either side
    least = Window.partitionBy("rec", "m")
    both = both.withColumn("c", cand).withColumn("c", F.when(F.col("kind") == 0, F.struct("m", F.min(F.when(F.col("kind") == 0, F.col("idx"))).over(least).alias("idx"))))
    w = Window.partitionBy("rec").orderBy("m", "kind", "idx")
    down = F.last("c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first("c", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("lo", down).withColumn("hi", up).where("kind = 1")
    dl, dh = F.col("m") - F.col("lo.m"), F.col("hi.m") - F.col("m")
    pick = (
        F.when(F.col("lo").isNull(), F.col("hi.idx"))
        .when(F.col("hi").isNull(), F.col("lo.idx"))
        .when(dl < dh, F.col("lo.idx"))
        .when(dh < dl, F.col("hi.idx"))
        .otherwise(F.least("lo.idx", "hi.idx"))
    )
    return found.select("rec", "idx", pick.alias("other"))


def repeat_counts(mapping: DataFrame, other: DataFrame) -> DataFrame:
    """How often each segment of other is mapped to, zeros included."""
    n = mapping.groupBy("rec", F.col("other").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    return other.select("rec", "idx").join(n, ["rec", "idx"], "left").select("rec", "idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fuse_scales(affinities: list[tuple[DataFrame, DataFrame, float]]) -> DataFrame:
    """Weighted mean of affinities (rec, i, j, w), each carried to the base segments by its mapping
    (rec, idx, other)."""
    total = sum(x for _, _, x in affinities)
    parts = None
    for affinity, mapping, weight in affinities:
        rows = mapping.select("rec", F.col("idx").alias("bi"), F.col("other").alias("i"))
        cols = mapping.select("rec", F.col("idx").alias("bj"), F.col("other").alias("j"))
        one = affinity.join(rows, ["rec", "i"]).join(cols, ["rec", "j"]).select("rec", F.col("bi").alias("i"), F.col("bj").alias("j"), (F.col("w") * weight / total).alias("w"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("rec", "i", "j").agg(F.sum("w").alias("w"))


def jaccard(keys: DataFrame) -> DataFrame:
    """(rec, i, j, w): shared over all set bits of a recording's bit keys (rec, k, bits: positions of set
    bits); two keys without any are alike."""
    a, b = keys.select("rec", F.col("k").alias("i"), F.col("bits").alias("a")), keys.select("rec", F.col("k").alias("j"), F.col("bits").alias("b"))
    union = F.size(F.array_union("a", "b"))
    return a.join(b, "rec").select("rec", "i", "j", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union).alias("w"))


def p_graph(affinity: DataFrame, p: int) -> DataFrame:
    """Each window keeps its p strongest neighbours (ties: larger j); an edge weighs half for each side
    that keeps it."""
    kept = affinity.withColumn("r", F.row_number().over(Window.partitionBy("rec", "i").orderBy(F.round("w", 12).desc(), F.desc("j")))).where(F.col("r") <= p)
    both = kept.select("rec", "i", "j").unionByName(kept.select("rec", F.col("j").alias("i"), F.col("i").alias("j")))
    return both.groupBy("rec", "i", "j").agg((F.count(F.lit(1)) * 0.5).alias("w"))


def laplacian_normalised(graph: DataFrame) -> DataFrame:
    """Edges over the roots of both ends' degrees, with 1 on the diagonal; a window without edges has 0
    there, as its degree counts as 1 elsewhere. The graph's own diagonal doesn't count."""
    edges = graph.where("i <> j")
    degree = graph.groupBy("rec", "i").agg(F.sum(F.when(F.col("i") != F.col("j"), F.col("w")).otherwise(0.0)).alias("d"))
    root = lambda name: degree.select("rec", F.col("i").alias(name), F.sqrt("d").alias(f"d{name}"))
    scaled = edges.join(root("i"), ["rec", "i"]).join(root("j"), ["rec", "j"]).select("rec", "i", "j", (-F.col("w") / (F.col("di") * F.col("dj"))).alias("w"))
    diagonal = degree.select("rec", "i", F.col("i").alias("j"), F.when(F.col("d") > 0, 1.0).otherwise(0.0).alias("w"))
    return scaled.unionByName(diagonal)


def laplacian(graph: DataFrame) -> DataFrame:
    """Degrees on the diagonal, less the edges; the graph's own diagonal doesn't count."""
    edges = graph.where("i <> j")
    degrees = edges.groupBy("rec", "i").agg(F.sum(F.abs("w")).alias("w")).select("rec", "i", F.col("i").alias("j"), "w")
    return edges.select("rec", "i", "j", (-F.col("w")).alias("w")).unionByName(degrees)


def row_threshold(affinity: DataFrame, share: float = 0.95, factor: float = 0.01) -> DataFrame:
    """Values below their row's percentile (interpolated) are multiplied by factor."""
    limits = affinity.groupBy("rec", "i").agg(F.percentile("w", F.lit(share)).alias("lim"))
    return affinity.join(limits, ["rec", "i"]).select("rec", "i", "j", F.when(F.col("w") < F.col("lim"), F.col("w") * factor).otherwise(F.col("w")).alias("w"))


def symmetrize(affinity: DataFrame) -> DataFrame:
    """The larger of the two directions."""
    both = affinity.unionByName(affinity.select("rec", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("rec", "i", "j").agg(F.max("w").alias("w"))


def diffuse(affinity: DataFrame) -> DataFrame:
    """The matrix times its transpose."""
    rows = affinity.groupBy("rec", F.col("i").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "w"))), lambda x: x.w).alias("v"))
    return _all_products(cut(rows), False, "w")  # read twice


def row_max_norm(affinity: DataFrame) -> DataFrame:
    """Column j is divided by the largest value of row j."""
    largest = affinity.groupBy("rec", "i").agg(F.max("w").alias("m")).select("rec", F.col("i").alias("j"), "m")
    return affinity.join(largest, ["rec", "j"]).select("rec", "i", "j", (F.col("w") / F.col("m")).alias("w"))


def fill_diagonal(affinity: DataFrame) -> DataFrame:
    """The diagonal becomes the row's largest other value, at least 0."""
    w = F.max(F.when(F.col("i") != F.col("j"), F.col("w"))).over(Window.partitionBy("rec", "i"))
    return affinity.select("rec", "i", "j", F.when(F.col("i") == F.col("j"), F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0))).otherwise(F.col("w")).alias("w"))


def prune(affinity: DataFrame, p: float) -> DataFrame:
    """The floor((1 - p) n) smallest values of each row become 0 (ties: smaller j first)."""
    w = Window.partitionBy("rec", "i")
    rank = F.row_number().over(w.orderBy(F.round("w", 12), "j"))
    return affinity.select("rec", "i", "j", F.when(rank <= F.floor(F.count(F.lit(1)).over(w) * (1 - p)), 0.0).otherwise(F.col("w")).alias("w"))


def enhance(affinity: DataFrame) -> DataFrame:
    """Diagonal, threshold, symmetry, diffusion, norm. What is read by more than one step is written."""
    return row_max_norm(cut(diffuse(symmetrize(row_threshold(cut(fill_diagonal(affinity)))))))


def eigengap_count(values: DataFrame, most: int = 25) -> DataFrame:
    """(rec, speakers) from ascending eigenvalues (rec, k from 1, v): the place of the widest of the
    first gaps, the first one if several are."""
    gap = F.lead("v").over(Window.partitionBy("rec").orderBy("k")) - F.col("v")
    n = F.count(F.lit(1)).over(Window.partitionBy("rec"))
    gaps = values.select("rec", "k", gap.alias("gap"), n.alias("n")).where(F.col("gap").isNotNull() & (F.col("k") <= F.least(F.lit(most), F.col("n"))))
    return gaps.groupBy("rec").agg(F.max_by("k", F.struct(F.round("gap", 12), -F.col("k"))).cast("int").alias("speakers"))


def eigenratio_count(values: DataFrame, most: int | None = None, stop: float = 1e-2) -> DataFrame:
    """(rec, speakers) from descending eigenvalues: the largest ratio of neighbours before the first
    value under stop; at least 1."""
    w = Window.partitionBy("rec").orderBy("k")
    prev = F.lag("v").over(w)
    small = F.max(F.when(F.col("v") < stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = values.select("rec", "k", (prev / F.col("v")).alias("ratio"), F.coalesce(small, F.lit(0)).alias("stopped"), prev.alias("prev"))
    used = before.where((F.col("stopped") == 0) & F.col("prev").isNotNull() & (F.col("prev") >= stop))
    if most is not None:
        used = used.where(F.col("k") - 1 <= most)
    best = used.groupBy("rec").agg(F.max_by(F.col("k") - 1, F.struct(F.round("ratio", 12), -F.col("k"))).alias("speakers"))
    return values.select("rec").distinct().join(best, "rec", "left").select("rec", F.greatest(F.coalesce("speakers", F.lit(1)), F.lit(1)).cast("int").alias("speakers"))
