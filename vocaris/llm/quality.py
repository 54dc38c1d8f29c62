"""Quality rules: base counts and compression bands.

Base counts say how long a text is and how much of it repeats. The method's verdict comes from
zstandard ratios (compressed / raw UTF-8 bytes): the whole document's must lie inside the band of its
length class, and at least half of its fixed-size chunks must lie inside theirs: full chunks have a
band of their own, and the last partial one takes the band of its length as if it were a document.
Repetitive text falls below a band, random strings (encoded binaries, keys) rise above it. Longer
texts compress better, hence limits by length; texts below the first class aren't judged by ratio,
as the frame's own bytes dominate them.

The bands come from the table itself: one pass counts the ratios of all rows that the base rules keep,
by length class, and the limits are Tukey's fences around the median, with the distance from the median
to the upper quartile as the scale on both sides (repetitive rows widen only the lower half). Below,
the fence is the inner one, 4 such distances; above, the outer one, 7. A class with fewer than
``Fences.least_rows`` rows says too little, and keeps the broad limits of ``BANDS``. In a class that is
mostly copies of one text the quartile is at the median; ``Fences.least_spread`` bounds the scale then.

Defined cases: a null text is empty; no words fails the base rules (n_words < 50); every count covers
the whole text; repeated rows are each judged; an empty table gives an empty table; other input
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm.frames import append_columns, map_arrow, without
from vocaris.llm.textkernels import SPACE, Block, blocks, gram_hashes, mix, rolling_prefix, span_hash, split_words, word_hashes

_U = np.uint64
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True


@dataclass(frozen=True)
class Bands:
    """Ratio limits. whole: (smallest length in bytes, lowest ratio, highest ratio), ascending."""

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0),
        (256, 0.40, 0.95),
        (512, 0.36, 0.85),
        (1024, 0.33, 0.78),
        (2048, 0.31, 0.74),
        (4096, 0.29, 0.72),
        (8192, 0.27, 0.72),
        (16384, 0.25, 0.72),
        (65536, 0.22, 0.72),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.29, 0.74)
    chunk_share: float = 0.5


@dataclass(frozen=True)
class Fences:
    """How learn() sets limits: fences in upper quartile distances, and the length classes."""

    below: float = 4.0
    above: float = 7.0
    least_rows: int = 100
    least_spread: float = 0.005
    classes: tuple[int, ...] = (256, 362, 512, 724, 1024, 1448, 2048, 2896, 4096, 5792, 8192, 16384)


BANDS = Bands()
FENCES = Fences()
_BINS = 10_000  # of a ratio of 1; ratios over 2 count as 2
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(block: Block) -> dict[str, np.ndarray]:
    data, offs, rows = block.data, block.offsets, block.rows
    words = split_words(block)
    out = {
        "n_words": np.diff(words.first).astype(np.int64),
        "word_chars": _per_row(((data & 0xC0) != 0x80) & ~SPACE[data], offs),
        "n_symbols": _per_row(_SYMBOL[data], offs),
    }
    # lines: the bytes between \n, cut at the ends of rows too
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offs)
    start, end = cuts[:-1], cuts[1:]
    line_row = np.searchsorted(offs, start, side="right") - 1
    end = end - ((end > start) & (data[np.maximum(end, 1) - 1] == 10)) if len(data) else end
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, line_row = start[filled], end[filled], line_row[filled]
    prefix = rolling_prefix(data)
    keys = span_hash(prefix, start, end) ^ mix(line_row.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(line_row, minlength=rows) - np.bincount(line_row[first], minlength=rows)
    # words inside 3-word windows that their row has twice or more
    grams = gram_hashes(word_hashes(block, words), 3)
    covered = np.zeros(len(words.start), dtype=bool)
    if len(grams):
        whole = words.row[: len(grams)] == words.row[2:]
        at = np.flatnonzero(whole)
        keys = grams[at] ^ mix(words.row[at].astype(np.uint64))
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        for j in range(3):
            covered[hit + j] = True
    out["n_repeat_words"] = np.bincount(words.row[covered], minlength=rows).astype(np.int64)
    return {k: v.astype(np.int64) for k, v in out.items()}


def ratios(block: Block, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole-document ratio per row, and row, bytes and ratio of every chunk, the last partial one too."""
    whole = np.ones(block.rows)
    row: list[int] = []
    length: list[int] = []
    ratio: list[float] = []
    raw = memoryview(np.ascontiguousarray(block.data))
    size = bands.chunk_bytes
    for i in range(block.rows):
        a, b = int(block.offsets[i]), int(block.offsets[i + 1])
        if b == a:
            continue
        whole[i] = len(zip_.compress(raw[a:b])) / (b - a)
        for start in range(a, b, size) if b - a > size else (a,):
            end = min(start + size, b)
            row.append(i)
            length.append(end - start)
            ratio.append(len(zip_.compress(raw[start:end])) / (end - start) if b - a > size else whole[i])
    return whole, np.array(row, dtype=np.int64), np.array(length, dtype=np.int64), np.array(ratio)


def _inside(length: np.ndarray, ratio: np.ndarray, bands: Bands) -> np.ndarray:
    least, low, high = (np.array(x) for x in zip(*bands.whole))
    cls = np.searchsorted(least, length, side="right") - 1
    return (ratio >= low[cls]) & (ratio <= high[cls])


def _base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def judge(block: Block, bands: Bands, zip_: zstandard.ZstdCompressor) -> dict[str, np.ndarray]:
    out = base_counts(block)
    whole, row, length, ratio = ratios(block, bands, zip_)
    low, high = bands.chunk
    good = np.where(length == bands.chunk_bytes, (ratio >= low) & (ratio <= high), _inside(length, ratio, bands))
    outside = np.bincount(row[~good], minlength=block.rows) / np.maximum(np.bincount(row, minlength=block.rows), 1)
    out["base_failed"] = _base_failed(out)
    out["zstd_ratio"], out["chunks_outside"] = whole, outside
    in_band = _inside(np.diff(block.offsets), whole, bands) & (outside <= bands.chunk_share)
    out["kept"] = ~out["base_failed"] & in_band
    return out


FIELDS = [T.StructField(c, T.LongType()) for c in COLUMNS] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("zstd_ratio", T.DoubleType()),
    T.StructField("chunks_outside", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def _limits(bins: np.ndarray, n: np.ndarray, broad: tuple[float, float], fences: Fences) -> tuple[float, float]:
    """The fences of ratios counted in bins, ascending; broad if there are too few."""
    if n.sum() < fences.least_rows:
        return broad
    middle, upper = (bins[np.searchsorted(np.cumsum(n), q * n.sum())] / _BINS for q in (0.5, 0.75))
    scale = max(upper - middle, fences.least_spread)
    return float(middle - fences.below * scale), float(middle + fences.above * scale)


def learn(df: DataFrame, text_col: str = "text", bands: Bands = BANDS, fences: Fences = FENCES) -> Bands:
    """Bands with limits from the ratios of all rows of df that the base rules keep."""
    edges = np.array(fences.classes)
    whole_chunk = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        total = np.zeros((len(edges) + 1, 2 * _BINS + 1), dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                kept = ~_base_failed(base_counts(block))
                whole, row, length, ratio = ratios(block, bands, zip_)
                cls = np.searchsorted(edges, np.diff(block.offsets), side="right") - 1
                full = kept[row] & (length == bands.chunk_bytes)
                judged = kept & (cls >= 0)
                for c, r in ((cls[judged], whole[judged]), (np.full(full.sum(), whole_chunk), ratio[full])):
                    np.add.at(total, (c, np.minimum(np.rint(r * _BINS).astype(np.int64), 2 * _BINS)), 1)
        c, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(b), pa.array(total[c, b])], names=["c", "b", "n"])

    counted = df.select(text_col).mapInArrow(run, "c long, b long, n long").groupBy("c", "b").agg(F.sum("n").alias("n"))
    found = np.array(sorted(tuple(r) for r in counted.collect()), dtype=np.int64).reshape(-1, 3)  # classes x bins at most
    of = lambda c, broad: _limits(found[found[:, 0] == c, 1], found[found[:, 0] == c, 2], broad, fences)
    broad = [next((low, high) for least, low, high in reversed(bands.whole) if least <= e) for e in fences.classes]
    whole = [(0, 0.0, 9.0)] + [(e, *of(c, broad[c])) for c, e in enumerate(fences.classes)]
    # a last class without enough rows of its own keeps the broad classes inside it
    if found[found[:, 0] == whole_chunk - 1, 2].sum() < fences.least_rows:
        whole += [w for w in bands.whole if w[0] > fences.classes[-1]]
    return replace(bands, whole=tuple(whole), chunk=of(whole_chunk, bands.chunk))


def quality(df: DataFrame, text_col: str = "text", bands: Bands | None = None, carry: list[str] | None = None) -> DataFrame:
    """df (or only its columns named in carry) with the base counts, the ratios and the verdict of
    every whole text. Without bands they are learnt from df, in a pass of its own."""
    bands = bands or learn(df, text_col)
    rest = without(df, *[f.name for f in FIELDS])
    carried = [f for f in rest.schema.fields if carry is None or f.name in carry]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for block in blocks(batch.column(batch.schema.names.index(text_col))):
                found = judge(block, bands, zip_)
                part = batch.select(names).slice(block.first, block.rows)
                yield append_columns(part, **{f.name: pa.array(found[f.name]) for f in FIELDS})

    return map_arrow(rest, run, [*carried, *FIELDS])


def keep_good(df: DataFrame, text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """Rows of df that the rules keep, with df's own columns. The verdict is made and applied inside
    the pass, so that rejected texts aren't sent back. Without bands they are learnt from df."""
    bands = bands or learn(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for block in blocks(batch.column(batch.schema.names.index(text_col))):
                kept = judge(block, bands, zip_)["kept"]
                yield batch.slice(block.first, block.rows).filter(pa.array(kept))

    return map_arrow(df, run, df.schema.fields)
