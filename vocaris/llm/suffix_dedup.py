"""Removing every byte of a string of ``length`` bytes that starts anywhere else too.

1. Anchors are positions that all occurrences of a long string pick alike (anchors.py). A window of
   ``length`` bytes can only be repeated if its anchors are.
2. Anchors whose gram occurs once fall out by counting hashes. A Bloom filter of the others keeps the
   second pass's output small.
3. An anchor's context is every byte that a window around it can reach. A context that occurs again
   as a whole is covered by repeated windows.
4. Other contexts of repeated anchors go to shards by their gram, one copy of each, and a suffix array
   of the shard finds which of their windows occur again (shards.py). An anchor with more than
   ``most_contexts`` contexts isn't put into one shard: all its windows are counted by hash instead.
5. The covered stretches of a document are joined and cut out.

Matches never cross documents; positions of the same document count. Equality of grams, contexts and
blocks is that of 64-bit hashes between positions that share an anchor.

Defined cases: a null text is empty; a text under ``length`` bytes loses nothing; repeated rows are
copies of each other and lose everything (if long enough); strings may overlap with themselves, and
are judged on the input; kept bytes may split characters, hence binary; an empty table gives an empty
table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm import anchors, shards
from vocaris.llm.anchors import SETTINGS, Settings
from vocaris.llm.exact_dedup import marked
from vocaris.llm.frames import cut, map_arrow, stored
from vocaris.llm.membership import id_filter, maybe_in, semi_join
from vocaris.llm.textkernels import blocks, rolling_prefix, span_hash, utf8_buffers

_TEXT = [T.StructField("i", T.LongType()), T.StructField("v", T.LongType())]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, v, t): id, hash of the text, text. Rows that agree in i and v are copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("v"), text.alias("t"))


def repeated_grams(docs: DataFrame, settings: Settings) -> DataFrame:
    """(h) of anchors' grams that occur twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors.find(b, settings).gram for b in blocks(batch.column(0), settings.block_bytes)]
            grams, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])

    counted = map_arrow(docs.select("t"), count, [T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType())])
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def contexts(docs: DataFrame, settings: Settings) -> DataFrame:
    """(i, v, h, c, at, left, right) of every anchor; a document's equal contexts are one row, with
    all their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), settings.block_bytes):
                x = anchors.find(block, settings)
                order = np.lexsort((x.at, x.context, x.gram, x.row))
                row, gram, ctx = x.row[order], x.gram[order], x.context[order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])))) if len(row) else np.zeros(0, np.int64)
                pick = order[new]
                ids = pa.array(x.row[pick] + block.first)
                positions = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array(x.at[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(ids),
                        batch.column(1).take(ids),
                        pa.array(x.gram[pick].astype(np.int64)),
                        pa.array(x.context[pick].astype(np.int64)),
                        positions,
                        pa.array(x.left[pick].astype(np.int32)),
                        pa.array(x.right[pick].astype(np.int32)),
                    ],
                    names=["i", "v", "h", "c", "at", "left", "right"],
                )

    more = [T.StructField("h", T.LongType()), T.StructField("c", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType())]
    return map_arrow(docs, run, [*_TEXT, *more])


def raw_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, many, i, v, at, left, bytes) of the wanted contexts (h, n, i, v, at, left, right), read from
    their documents."""
    per_doc = wanted.groupBy(F.col("i").alias("j"), F.col("v").alias("w")).agg(F.collect_list(F.struct("h", (F.col("n") > 1).alias("many"), "at", "left", "right")).alias("x"))
    texts = semi_join(docs, "i", wanted, "i")
    joined = texts.join(per_doc, F.col("i").eqNullSafe(F.col("j")) & (F.col("v") == F.col("w"))).dropDuplicates(["i", "v"]).select("i", "v", F.encode("t", "UTF-8").alias("t"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data, x = batch.column(2)[r].as_py(), batch.column(3)[r].values
                h, many, at, left, right = (x.field(c) for c in ("h", "many", "at", "left", "right"))
                n = len(x)
                pieces = [data[p - a : p + b] for p, a, b in zip(at.to_pylist(), left.to_pylist(), right.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [h, many, pa.array([batch.column(0)[r].as_py()] * n, pa.int64()), pa.array([batch.column(1)[r].as_py()] * n, pa.int64()), at, left, pa.array(pieces, pa.binary())],
                    names=["h", "many", "i", "v", "at", "left", "bytes"],
                )

    fields = [T.StructField("h", T.LongType()), T.StructField("many", T.BooleanType()), *_TEXT, T.StructField("at", T.IntegerType()), T.StructField("left", T.IntegerType()), T.StructField("bytes", T.BinaryType())]
    return map_arrow(joined, run, fields)


def _shard(table: pa.Table, settings: Settings) -> pa.RecordBatch:
    data, offsets = utf8_buffers(table.column("bytes").combine_chunks())
    i, v = table.column("i").to_numpy(zero_copy_only=False), table.column("v").to_numpy()
    i = np.where(np.isnan(i), -1, i).astype(np.int64) if i.dtype.kind == "f" else i
    _, doc = np.unique(np.stack((i, v)), axis=1, return_inverse=True)
    at, left = table.column("at").to_numpy().astype(np.int64), table.column("left").to_numpy().astype(np.int64)
    many = table.column("many").to_numpy(zero_copy_only=False)
    windows = shards.repeated_windows(data, offsets, left, table.column("h").to_numpy().astype(np.uint64), (doc.reshape(-1).astype(np.int64) << 36) + at, many, settings)
    windows[many] = False
    rows, low, high = shards.spans(windows, settings.length)
    return pa.RecordBatch.from_arrays(
        [table.column("i").combine_chunks().take(pa.array(rows)), table.column("v").combine_chunks().take(pa.array(rows)), pa.array((at[rows] + low).astype(np.int32)), pa.array((at[rows] + high).astype(np.int32))],
        names=["i", "v", "s", "e"],
    )


_SPANS = [*_TEXT, T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]


def shard_spans(raw: DataFrame, shard_count: int, settings: Settings) -> DataFrame:
    """(i, v, s, e) of what repeated windows cover in contexts that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield _shard(pa.Table.from_batches(held), settings)
        del held
        pa.default_memory_pool().release_unused()  # workers are reused

    return map_arrow(raw.repartition(shard_count, "h"), run, _SPANS)


def counted_spans(raw: DataFrame, settings: Settings) -> DataFrame:
    """The same for anchors with too many contexts for one shard: every window's hash is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = part.column(6).to_pylist()
                data = np.frombuffer(b"".join(values), dtype=np.uint8)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.int64)
                left, prefix = part.column(5).to_numpy().astype(np.int64), rolling_prefix(data)
                row, start = [], []
                for a in range(settings.before + 1):
                    s = offsets[:-1] + left - a
                    ok = np.flatnonzero((left >= a) & (s + settings.length <= offsets[1:]))
                    row.append(ok)
                    start.append(s[ok])
                r, s = np.concatenate(row), np.concatenate(start)
                w = span_hash(prefix, s, s + settings.length)
                first = part.column(4).to_numpy().astype(np.int64)[r] + (s - offsets[r] - left[r])
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), part.column(1).take(take), part.column(2).take(take), part.column(3).take(take), pa.array(first.astype(np.int32))], names=["w", "many", "i", "v", "s"])

    windows = map_arrow(raw, run, [T.StructField("w", T.LongType()), T.StructField("many", T.BooleanType()), *_TEXT, T.StructField("s", T.IntegerType())])
    windows = stored(windows)
    seen = windows.groupBy("w").agg(F.min(F.struct("i", "v", "s")).alias("x"), F.max(F.struct("i", "v", "s")).alias("y"), F.max("many").alias("m"))
    again = cut(seen.where("m or x <> y").select("w"))
    return windows.where("not many").join(again, "w").select("i", "v", "s", (F.col("s") + settings.length).cast("int").alias("e"))


def repeated_spans(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(i, v, x): for each document (i, v) with anything repeated, stretches (s, e), still unmerged."""
    grams = cut(repeated_grams(docs, settings))
    found = marked(contexts(docs, settings), "h", *id_filter(grams, "h")).where("__maybe").drop("__maybe")
    rows = stored(found)
    one = F.struct("i", "v", F.element_at("at", 1).alias("at"), "left", "right")
    groups = stored(rows.groupBy("h", "c").agg(F.sum(F.size("at")).alias("n"), F.min(one).alias("one")))
    per_gram = groups.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("m")).where("d > 1")
    mixed = stored(groups.join(cut(per_gram.select("h", "d")), "h").select("h", "d", "n", "one.*"))
    raw = stored(raw_contexts(docs, mixed).join(cut(per_gram.where(F.col("d") > settings.most_contexts).select("h", F.lit(True).alias("hot"))), "h", "left"))
    usual, hot = raw.where("hot is null").drop("hot"), raw.where("hot").drop("hot")
    total = usual.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parts = [shard_spans(usual, max(1, -(-total // settings.shard_bytes)), settings)]
    if not hot.isEmpty():
        parts.append(counted_spans(hot, settings))
    whole = groups.where("n > 1").select("h", "c")
    covered = rows.join(whole, ["h", "c"]).select("i", "v", F.explode("at").alias("p"), "left", "right").select("i", "v", (F.col("p") - F.col("left")).alias("s"), (F.col("p") + F.col("right")).alias("e"))
    spans = covered
    for p in parts:
        spans = spans.unionByName(p)
    # one row for each document; as many stretches as it has anchors at most
    return spans.groupBy("i", "v").agg(F.collect_set(F.struct("s", "e")).alias("x"))


def _merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return s[new], e[np.append(new[1:] - 1, len(e) - 1)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = SETTINGS, digest: bool = False) -> DataFrame:
    """id, n_bytes, spans (removed stretches of bytes) and kept (the bytes that are left) of every row;
    with digest, n_removed, n_spans and kept_sha256 instead of spans and kept. Documents without any
    repeat don't shuffle."""
    docs = _keyed(df, id_col, text_col)
    spans = stored(repeated_spans(docs, settings))
    split = maybe_in(docs, "i", spans, "i")
    raw = F.encode("t", "UTF-8")
    id_type = df.schema[id_col].dataType
    alone = split.where("not __maybe")
    some = split.where("__maybe").drop("__maybe").join(spans.select(F.col("i").alias("j"), F.col("v").alias("w"), "x"), F.col("i").eqNullSafe(F.col("j")) & (F.col("v") == F.col("w")), "left").select("i", raw.alias("t"), "x")
    pair = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
    if digest:
        own = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
        whole = alone.select("i", F.octet_length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"))
    else:
        own = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", pair), T.StructField("kept", T.BinaryType())]
        whole = alone.select("i", F.octet_length("t").cast("long").alias("n_bytes"), F.array().cast(pair).alias("spans"), raw.alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                data, x = batch.column(1)[r].as_py(), batch.column(2)[r]
                s = e = np.zeros(0, np.int64)
                if x.is_valid and len(x):
                    s, e = _merged(x.values.field("s").to_numpy().astype(np.int64), x.values.field("e").to_numpy().astype(np.int64))
                kept = b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)]))
                if digest:
                    out.append((len(data), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((len(data), [{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist())], kept))
            types = [f.dataType for f in own]
            kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
            arrow = [kinds.get(t, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k] for o in out], arrow[k]) for k in range(len(own))]], names=["i", *[f.name for f in own]])

    cut_out = map_arrow(some, run, [T.StructField("i", T.LongType()), *own])
    both = whole.unionByName(cut_out)
    return both.select(F.col("i").cast(id_type).alias(id_col), *[f.name for f in own])


#: Counts the 128-bit hashes of all windows.
ORACLE_SQL = """
WITH h AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, unnest(range(0, length(x) // 2 - 199)) AS i FROM h WHERE length(x) >= 400),
k AS (SELECT p.r, i, md5_number(substr(x, 2 * i + 1, 400)) AS w FROM p JOIN h USING (r)),
rep AS (SELECT r, i FROM k JOIN (SELECT w FROM k GROUP BY w HAVING count(*) > 1) USING (w)),
g AS (SELECT r, i, sum(CASE WHEN i <= lag_i + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS lag_i FROM rep)),
sp AS (SELECT r, isl, min(i) AS s, max(i) + 200 AS e FROM g GROUP BY r, isl),
gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b, isl FROM sp UNION ALL SELECT r, max(e), NULL, 1000000000 FROM sp GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN b IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a, isl) AS y FROM gaps JOIN h USING (r) GROUP BY r),
n AS (SELECT r, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM sp GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM h LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
