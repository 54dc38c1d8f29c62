"""Keeping most rows out of a join's shuffle by a Bloom filter of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocaris.llm.exact_dedup import SETTINGS, Settings, _bucket, _cells, filter_size, marked
from vocaris.llm.frames import cut


def id_filter(ids: DataFrame, id_col: str, settings: Settings = SETTINGS) -> tuple[DataFrame, int, int]:
    """Bitmaps of all ids, and the numbers of buckets and of parts to broadcast them in."""
    buckets, parts = filter_size(ids.count(), settings)
    cells = ids.select(_bucket(F.col(id_col), buckets).alias("b"), F.explode(F.array(*_cells(F.col(id_col)))).alias("p"))
    bitmaps = cells.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    return (cut(bitmaps) if parts > 1 else bitmaps), buckets, parts


def maybe_in(df: DataFrame, id_col: str, ids: DataFrame, ids_col: str, settings: Settings = SETTINGS) -> DataFrame:
    """df with __maybe: false means that the id is surely not among ids."""
    return marked(df, id_col, *id_filter(ids, ids_col, settings))


def semi_join(df: DataFrame, id_col: str, ids: DataFrame, ids_col: str) -> DataFrame:
    """Rows of df whose id is among ids (null-safe). Other rows hardly ever shuffle."""
    likely = maybe_in(df, id_col, ids, ids_col).where("__maybe").drop("__maybe")
    other = ids.select(F.col(ids_col).alias("__id")).distinct()
    return likely.join(other, likely[id_col].eqNullSafe(other["__id"]), "left_semi")


def anti_join(df: DataFrame, id_col: str, ids: DataFrame, ids_col: str) -> DataFrame:
    """Rows of df whose id isn't among ids (null-safe). Rows surely outside pass straight through."""
    rows = maybe_in(df, id_col, ids, ids_col)
    other = ids.select(F.col(ids_col).alias("__id")).distinct()
    likely = rows.where("__maybe").drop("__maybe")
    rest = likely.join(other, likely[id_col].eqNullSafe(other["__id"]), "left_anti")
    return rows.where("not __maybe").drop("__maybe").unionByName(rest)
