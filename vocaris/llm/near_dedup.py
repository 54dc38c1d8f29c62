"""Near-duplicate detection by MinHash bands, odd sketches and whole shingle sets.

1. One pass over the texts gives every document its number of shingles, a digest of its set, band
   keys of its MinHash samples, and an odd sketch (the samples' parity bitmap).
2. Documents with one digest are one class; from here on classes stand for them.
3. Classes that share a band key are candidates. In every bucket the class with the most shared
   bands leads, and only pairs with the leader are emitted: as many as rows.
4. Sketches reject pairs that can't be similar (their XOR's set bits estimate the similarity); the
   others are confirmed on whole sets, and links make components.
5. A bucket whose classes links leave in several components is compared by odd sketches of the whole
   sets, in tiles: each class outside the largest component meets all others of the bucket, and pairs
   of different components that sizes and sketches don't reject (by 5.5 deviations) are confirmed on
   whole sets. So no link is lost that a leader didn't see. Sets of a bucket meet only where their sizes
   let them be similar, and tiles have a largest size, so that tasks stay bounded.

Sets are read again only for candidate classes; a Bloom filter keeps other texts out of the shuffle.

Defined cases: null or empty texts have no shingles, are in no class and link with nothing; a text of
fewer words than a shingle has one shingle, the whole sequence; classes make repeated rows and
copies cheap and exact; a null id is the smallest of its component only if all are null; an empty
table gives an empty table; other columns are kept by ``keep_one`` and aren't read by ``decide``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm import near_kernels as kernels
from vocaris.llm.components import connected_components
from vocaris.llm.frames import cut, map_arrow
from vocaris.llm.membership import anti_join, semi_join
from vocaris.llm.near_kernels import SETTINGS, Settings
from vocaris.llm.textkernels import blocks, unique_sorted

#: m classes of a bucket and size band are cut into sqrt(m / TILE_ROWS) tiles, or more where a tile would
#: exceed MOST_ROWS classes (about 0.2 KB each, 1 KB in Python).
TILE_ROWS = 800
MOST_ROWS = 100_000


def signatures(df: DataFrame, id_col: str, text_col: str, settings: Settings = SETTINGS) -> DataFrame:
    """(i, n, digest, bands, sketch) of every row; the last three are null without shingles."""
    source = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                grams, first = kernels.shingles(block, settings.words)
                rows, samples = kernels.minhashes(grams, first, settings)
                keys = kernels.band_keys(samples, settings).astype(np.int64)
                flat = kernels.odd_sketches(samples, settings)
                count = np.zeros(block.rows, dtype=np.int64)
                digest: list[bytes | None] = [None] * block.rows
                bands: list[np.ndarray | None] = [None] * block.rows
                sketch: list[bytes | None] = [None] * block.rows
                for k, r in enumerate(rows):
                    distinct = unique_sorted(grams[first[r] : first[r + 1]])
                    count[r], digest[r], bands[r], sketch[r] = len(distinct), kernels.set_digest(distinct), keys[k], flat[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), pa.array(count), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=["i", "n", "digest", "bands", "sketch"],
                )

    return map_arrow(source, run, [T.StructField("i", source.schema["i"].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])


def whole_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(digest, n, shingles, wide) of the wanted classes (digest, rep), from the texts of their rep rows."""
    texts = semi_join(df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), "i", wanted, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                grams, first = kernels.shingles(block, settings.words)
                sets = [unique_sorted(grams[a:b]) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kernels.set_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([kernels.wide_sketch(s) for s in sets], pa.binary())],
                    names=["digest", "n", "shingles", "wide"],
                )

    found = map_arrow(texts.select("t"), run, [T.StructField("digest", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType()), T.StructField("wide", T.BinaryType())])
    return found.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of every bucket's leader and its other members (h, digest)."""
    shared = members.groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    leaders = cut(members.join(shared, "digest").groupBy("h").agg(F.max(F.struct("c", "digest")).alias("x")).select("h", F.col("x.digest").alias("lead")))
    pairs = members.join(leaders, "h").where("digest <> lead")
    return pairs.select(F.least("digest", "lead").alias("a"), F.greatest("digest", "lead").alias("b")).distinct()


def _both(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    one = side.select(F.col("digest").alias("a"), F.col(value).alias("x"))
    two = side.select(F.col("digest").alias("b"), F.col(value).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that are linked: sketches first, whole sets for what they don't reject."""
    pair_fields = [T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(kernels.estimates(x, y, settings) >= settings.reject_below))

    def by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [kernels.linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), settings.percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    likely = map_arrow(_both(pairs, classes, "sketch"), by_sketch, pair_fields)
    return map_arrow(_both(likely, sets, "shingles"), by_set, pair_fields)


def open_members(members: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """(h, digest, comp, main, n, wide, hs) of buckets of three classes or more that links leave in
    several components: main is the component with most classes. Of buckets with the same members one stands for all."""
    comps = connected_components(links).withColumnRenamed("node", "digest")
    known = cut(sets.join(comps, "digest", "left").select("digest", "n", "wide", F.coalesce("component", "digest").alias("comp")))
    placed = members.join(known.select("digest", "comp"), "digest").withColumns({"x": F.xxhash64("digest").cast("decimal(38,0)"), "y": F.xxhash64("digest", F.lit(1)).cast("decimal(38,0)")})
    parts = placed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    buckets = parts.groupBy("h").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.sum("x").alias("x"), F.sum("y").alias("y")).where("parts > 1 and m > 2")
    one = buckets.groupBy("m", "x", "y").agg(F.min(F.struct("h", "top")).alias("b"))
    open_ = cut(one.select("b.h", F.col("b.top.comp").alias("main")))
    found = members.join(open_, "h")
    # the open buckets of a class, at most one for each band: a pair belongs to the first that both are in
    own = found.groupBy("digest").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    return found.join(known.join(own, "digest"), "digest")


def dealt(rows: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(h, band, tile, chunk, query, digest, comp, n, wide, hs): every chunk of a bucket's classes outside
    main meets every tile of its classes, where sizes allow a link: similar sets lie in one band of
    sizes or in neighbouring ones, as bands are as wide as the largest ratio of their sizes."""
    # a little wider than the ratio, which rounding can't undo
    width = math.log(100 / settings.percent) * (1 + 1e-9)
    own = ["digest", "comp", "n", "wide", "hs"]
    placed = rows.select("h", F.floor(F.log("n") / width).cast("int").alias("band"), (F.col("comp") != F.col("main")).alias("asks"), *own)
    around = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")
    found = placed.groupBy("h", "band").agg(F.count(F.lit(1)).alias("m"), F.count_if("asks").alias("q"))
    asking = found.select("h", around, "q").groupBy("h", "band").agg(F.sum("q").alias("q"))
    counts = cut(found.select("h", "band", "m").join(asking, ["h", "band"]).where("q > 0"))
    number = lambda n: F.greatest(F.ceil(F.sqrt(n / TILE_ROWS)), F.ceil(n / MOST_ROWS)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), number(n) - 1))
    tile, chunk = F.pmod(F.xxhash64("digest"), number(F.col("m"))), F.pmod(F.xxhash64("digest", F.lit(1)), number(F.col("q")))
    stay = placed.join(counts, ["h", "band"]).select("h", "band", tile.alias("tile"), each(F.col("q")).alias("chunk"), F.lit(0).alias("query"), *own)
    ask = placed.where("asks").select("h", around, *own).join(counts, ["h", "band"]).select("h", "band", each(F.col("m")).alias("tile"), chunk.alias("chunk"), F.lit(1).alias("query"), *own)
    key = ["h", "band", "tile", "chunk"]
    return stay.unionByName(ask).repartition(*key).sortWithinPartitions(*key, "query")


class _Tile:
    """The classes of a tile by the width of their sketches."""

    def __init__(self, h: int, rows: list[tuple[bytes, bytes, int, bytes, list[int]]]) -> None:
        self.h, self.parts = h, []
        for width in {len(r[3]) for r in rows}:
            own = [r for r in rows if len(r[3]) == width]
            self.parts.append(([r[0] for r in own], [r[1] for r in own], np.array([r[2] for r in own], dtype=np.int64), np.frombuffer(b"".join(r[3] for r in own), dtype=np.uint8).reshape(len(own), width), [frozenset(r[4]) for r in own]))

    def partners(self, comp: bytes, n: int, wide: bytes, hs: list[int], which: str, percent: int) -> list[bytes]:
        found: list[tuple[int, bytes, bytes]] = []
        for names, comps, sizes, sketches, buckets in self.parts:
            at, odd = kernels.possible(wide, n, sketches, sizes, percent)
            found += [(o, names[k], comps[k]) for k, o in zip(at.tolist(), odd.tolist()) if comps[k] != comp and next(x for x in hs if x in buckets[k]) == self.h]
        if which == "all":
            return [name for _, name, _ in found]
        if which == "nearest":
            return [min(found)[1]] if found else []
        nearest: dict[bytes, bytes] = {}
        for _, name, other in sorted(found):
            nearest.setdefault(other, name)
        return list(nearest.values())


def candidates(rows: DataFrame, which: str, settings: Settings) -> DataFrame:
    """Distinct pairs (a, b) of different components of a bucket that sizes and wide sketches don't
    reject: all of them, or for each class and tile only the nearest partner, or the nearest one of each
    other component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tile = None, [], None
        for batch in batches:
            out: set[tuple[bytes, bytes]] = set()
            for h, band, t, c, query, digest, comp, n, wide, hs in zip(*(x.to_pylist() for x in batch.columns)):
                if (h, band, t, c) != key:
                    key, held, tile = (h, band, t, c), [], None
                if not query:
                    held.append((digest, comp, n, wide, hs))
                    continue
                tile = tile or _Tile(h, held)
                for other in tile.partners(comp, n, wide, hs, which, settings.percent):
                    out.add((min(digest, other), max(digest, other)))
            pairs = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    return map_arrow(dealt(rows, settings), run, [T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]).distinct()


def all_links(members: DataFrame, classes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links that join every two classes of a bucket that are linked or reach each other by links.

    The leaders' stars come first. What they leave in several components is compared by sketches: at
    first for nearest partners and in some of the bands, which joins most of what lies close together,
    then in all bands for all partners of what is still apart."""
    pairs = cut(star_pairs(members))
    links = cut(confirmed(pairs, classes, sets, settings))
    for which, part in (("nearest", 0), ("each", 1), ("all", None)):
        rows = cut(open_members(members if part is None else members.where(F.pmod(F.col("h"), F.lit(4)) == part), links, sets))
        if rows.isEmpty():
            continue
        new = cut(candidates(rows, which, settings).join(pairs, ["a", "b"], "left_anti"))
        links = cut(links.unionByName(confirmed(new, classes, sets, settings)))
        pairs = pairs.unionByName(new)
    return links


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = SETTINGS) -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    rows = cut(signatures(df, id_col, text_col, settings))
    filled = rows.where("n > 0")
    classes = cut(filled.groupBy("digest").agg(F.min("i").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    buckets = classes.select("digest", F.explode("bands").alias("h"))
    several = buckets.groupBy("h").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("h")
    members = cut(buckets.join(cut(several), "h"))
    wanted = cut(members.select("digest").distinct().join(classes.select("digest", "rep", "sketch"), "digest"))
    sets = cut(whole_sets(df, id_col, text_col, wanted, settings))
    links = all_links(members, wanted, sets, settings)
    linked = cut(connected_components(links).join(classes.select(F.col("digest").alias("node"), "rep"), "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "component").select(F.col("node").alias("digest"), "component_id")
    labels = classes.select("digest", "rep").join(named, "digest", "left").select(F.col("digest").alias("d"), F.coalesce("component_id", "rep").alias("label"))
    joined = filled.select("i", "n", "digest").join(cut(labels), F.col("digest") == F.col("d")).select("i", "n", "label")
    alone = rows.where("n = 0").select("i", "n", F.col("i").alias("label"))
    kept = F.col("i").eqNullSafe(F.col("label")).alias("kept")
    return joined.unionByName(alone).select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"), kept)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = SETTINGS) -> DataFrame:
    """df without the documents that aren't the first of their component. Rows of one id are one
    document."""
    gone = cut(decide(df, id_col, text_col, settings).where("not kept").select(F.col(id_col).alias("gone")).distinct())
    return anti_join(df, id_col, gone, "gone")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 4 THEN [array_to_string(x, ' ')] ELSE list_distinct(list_transform(range(1, len(x) - 2), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] || ' ' || x[i + 3])) END AS sh FROM w),
f AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM e2 UNION SELECT reach.a, e2.b FROM reach JOIN e2 ON reach.b = e2.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(sh) AS n_shingles, coalesce(least(m, s.doc_id), s.doc_id) AS component_id, coalesce(least(m, s.doc_id), s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c USING (doc_id)
"""
