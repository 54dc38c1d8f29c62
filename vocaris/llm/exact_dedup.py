"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Two texts are equal when they are identical after deleting every white-space character
(``[\\x20\\x09-\\x0D]``); SHA-256 of what remains stands for it. Of equal texts the one with the
most code points in the original stays, then the one with the smallest id.

Pass 1 adds every hash to a blocked Bloom filter that keeps only the cells which two rows or more
touch: cells are counted with map-side combining and packed into 4 KB bitmaps. Pass 2 tests each row
against the filter. Only a row whose cells are all set may have a twin; such rows shuffle by their
hash, and all others pass straight through. A false positive costs a shuffled row, never a wrong
result. The filter has ``bits_per_row`` bits a row, in parts of at most ``max_filter_bytes``, each
broadcast by itself. ``decide`` works on narrow keys: where ``max_parts`` parts aren't enough, it splits
the keys into slices by hash and gives each slice a filter of its own. ``keep_one`` reads whole rows
once and so has one filter of at most ``max_parts`` parts (1 GB: 500 million rows); a table beyond that
has more false positives and the same result.

Defined cases: a null text counts as empty, and all texts of white space only are equal to it; rows
that agree in id, length and hash are repeats of one row, of which one stays; a null id loses to any
other id; an empty table gives an empty table; other input columns are kept by ``keep_one`` and
aren't read by ``decide``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocaris.llm.frames import cut

#: Characters that don't count, in one place: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
_BITMAP_BITS = 32768  # what bitmap_construct_agg packs into one value


@dataclass(frozen=True)
class Settings:
    bits_per_row: int = 16
    max_filter_bytes: int = 32 << 20  # of one broadcast
    max_parts: int = 32  # broadcasts of one filter


SETTINGS = Settings()


def squeezed(text: Column) -> Column:
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def text_key(text_col: str) -> Column:
    """32 bytes that are equal for equal texts."""
    return F.unhex(F.sha2(squeezed(F.col(text_col)).cast("binary"), 256))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _cells(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftright(h, 8).bitwiseAND(_BITMAP_BITS - 1), F.shiftright(h, 40).bitwiseAND(_BITMAP_BITS - 1)]


def filter_size(rows: int, settings: Settings) -> tuple[int, int]:
    """Buckets of a filter for so many rows, and how many parts it is broadcast in."""
    per_part = max(1, settings.max_filter_bytes // (_BITMAP_BITS // 8))
    buckets = min(rows * settings.bits_per_row // _BITMAP_BITS + 1, per_part * settings.max_parts)
    return buckets, -(-buckets // per_part)


def slices_of(rows: int, settings: Settings) -> int:
    """Slices of a table of keys so that each one's filter has its bits for every row."""
    most = settings.max_parts * max(_BITMAP_BITS, settings.max_filter_bytes * 8) // settings.bits_per_row
    return -(-rows // max(1, most)) or 1


def repeated_filter(keys: DataFrame, key_col: str, settings: Settings = SETTINGS) -> tuple[DataFrame, int, int]:
    """Bitmaps (bucket, bits) of the cells that several rows touch, and the numbers of buckets and parts."""
    buckets, parts = filter_size(keys.count(), settings)
    cells = keys.select(_bucket(F.col(key_col), buckets).alias("b"), F.explode(F.array_distinct(F.array(*_cells(F.col(key_col))))).alias("p"))
    shared = cells.groupBy("b", "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bitmaps = shared.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    return (cut(bitmaps) if parts > 1 else bitmaps), buckets, parts


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(position, F.lit(8)))), F.lit(2)) == 1


def marked(df: DataFrame, key_col: str, bitmaps: DataFrame, buckets: int, parts: int = 1) -> DataFrame:
    """df with __maybe: whether the row may have a twin. Each part of the filter is a broadcast of its
    own, at most max_filter_bytes."""
    bucket, joined, found = _bucket(F.col(key_col), buckets), df, []
    per_part = -(-buckets // parts)
    for k in range(parts):
        own = bitmaps.where((F.col("b") >= k * per_part) & (F.col("b") < (k + 1) * per_part)) if parts > 1 else bitmaps
        joined = joined.join(F.broadcast(own.select(F.col("b").alias(f"__b{k}"), F.col("bits").alias(f"__bits{k}"))), bucket == F.col(f"__b{k}"), "left")
        found.append(F.col(f"__bits{k}"))
    bits = F.coalesce(*found)
    maybe = F.coalesce(reduce(lambda a, b: a & b, [_is_set(bits, c) for c in _cells(F.col(key_col))]), F.lit(False))
    return joined.select(*[df[c] for c in df.columns], maybe.alias("__maybe"))


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = SETTINGS) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row. Reads each text once; the narrow
    keys go to the checkpoint folder."""
    keys = cut(df.select(F.col(id_col).alias("i"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), text_key(text_col).alias("k")))
    slices = slices_of(keys.count(), settings)
    each = [keys.where(F.pmod(F.xxhash64("k", F.lit(2)), F.lit(slices)) == s) for s in range(slices)] if slices > 1 else [keys]
    rows = reduce(DataFrame.unionByName, [marked(part, "k", *repeated_filter(part, "k", settings)) for part in each])
    sha = F.lower(F.hex("k")).alias("text_sha256")
    alone = rows.where("not __maybe").select(F.col("i").alias(id_col), F.col("i").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)

    same = rows.where("__maybe").groupBy("k", "n", "i").agg(F.count(F.lit(1)).alias("m"))
    # cut, so that the join below has plain exchanges on both sides and Spark can split a hot group
    groups = cut(same.groupBy("k").agg(F.max(F.struct("n", (-F.col("i")).alias("o"))).alias("best"), F.sum("m").alias("group_size")))
    first = (F.col("n") == F.col("best.n")) & F.col("o").eqNullSafe(F.col("best.o"))
    together = (
        same.withColumn("o", -F.col("i"))
        .join(groups, "k")
        .select("i", "k", "group_size", (-F.col("best.o")).alias("keep_id"), first.alias("first"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
        .select(F.col("i").alias(id_col), "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), sha)
    )
    return alone.unionByName(together)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = SETTINGS) -> DataFrame:
    """Rows of df that stay, with df's columns. Texts that can't have a twin aren't shuffled."""
    keys = cut(df.select(text_key(text_col).alias("k")))
    bitmaps, buckets, parts = repeated_filter(keys, "k", settings)
    bitmaps = cut(bitmaps)
    rows = marked(df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), text_key(text_col).alias("__k")), "__k", bitmaps, buckets, parts)
    row = F.col("__row")
    order = F.struct(F.coalesce(F.length(row[text_col]), F.lit(0)), -row[id_col], F.md5(F.to_json("__row")))
    alone = rows.where("not __maybe").select("__row")
    best = rows.where("__maybe").groupBy("__k").agg(F.max_by("__row", order).alias("__row")).select("__row")
    return alone.unionByName(best).select("__row.*")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept,
       s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""
