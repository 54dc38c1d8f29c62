"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to ``max_n`` characters), most frequent
first. A text's own profile is compared with each language's: every n-gram adds the difference of
its two ranks, or the profile length if the language's profile lacks it. The language at the
smallest total distance wins; ties go to the first language by name.

N-grams are exact: characters are lower-cased, everything but letters separates words, a word is
padded with one blank on each side, and up to three 21-bit code points make one 64-bit key.

Profiles come from all labelled rows, however many a language has: n-gram counts are sums, which
Spark combines. Every text is scored whole.

Defined cases: a text that is null, empty or has no letter is ``und`` with score 0; a label set that
is empty makes every text ``und``; repeated rows are each scored; other input columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm.frames import append_columns, map_arrow, without

_U = np.uint64
_BLANK = _U(1)
_HELD = 2_000_000  # n-grams that a task gathers before it adds them up


@dataclass(frozen=True)
class Settings:
    max_n: int = 3
    profile: int = 400


SETTINGS = Settings()


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(text: str, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram keys and how often each occurs; both empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # one blank (code 1, so that " a" and "a" differ) before, after and between words
    clean = np.full(len(points) + 2, _BLANK, dtype=np.uint64)
    clean[1:-1] = np.where(letter, points, _BLANK)
    clean = clean[np.concatenate(([True], (clean[1:] != _BLANK) | (clean[:-1] != _BLANK)))]
    if clean[-1] != _BLANK:
        clean = np.append(clean, _BLANK)
    keys, code = [clean[clean != _BLANK]], clean
    for n in range(2, max_n + 1):
        code = (code[:-1] << _U(21)) | clean[n - 1 :]
        inner = np.ones(len(code), dtype=bool)
        for j in range(1, n - 1):
            inner &= clean[j : len(clean) - n + 1 + j] != _BLANK
        keys.append(code[inner])
    return np.unique(np.concatenate(keys), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    if len(keys) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:size]


class Profiles:
    """Sorted n-gram keys of all profiles with the rank in each language (size if absent)."""

    def __init__(self, profiles: dict[str, np.ndarray], settings: Settings):
        self.settings = settings
        self.languages = sorted(profiles)
        every = [profiles[x] for x in self.languages]
        self.keys = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), settings.profile, dtype=np.int64)
        for i, p in enumerate(every):
            self.ranks[i, np.searchsorted(self.keys, p)] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language, and 1 less its distance as a share of the largest possible one."""
        own = ranked(*gram_counts(text or "", self.settings.max_n), self.settings.profile)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.ranks[:, at]
        missing = ranks == self.settings.profile
        distance = np.where(missing, self.settings.profile, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.settings.profile * len(own)))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", settings: Settings = SETTINGS) -> Profiles:
    """Profiles of the labelled rows of df."""
    labelled = df.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("t is not null and l is not null")
    max_n = settings.max_n

    def added(parts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, found in parts.items():
            keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            total = np.bincount(where, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(total)], names=["l", "g", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tables of counts for each language, as large as the alphabet's n-grams
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                found = gram_counts(text.as_py(), max_n)
                parts.setdefault(lang.as_py(), []).append(found)
                held += len(found[0])
                if held > _HELD:
                    yield from added(parts)
                    parts, held = {}, 0
        yield from added(parts)

    counts = labelled.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    top = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= settings.profile)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("l", "k", "g").collect():  # languages x profile length
        found.setdefault(r.l, []).append((r.k, r.g))
    return Profiles({x: np.array([g for _, g in sorted(v)], dtype=np.int64).astype(np.uint64) for x, v in found.items()}, settings)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df (or only its columns named in carry) with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # languages x profile length
    rest = without(df, "lang_pred", "score")
    carried = [f for f in rest.schema.fields if carry is None or f.name in carry]
    names = [f.name for f in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.schema.names.index(text_col))]
            yield append_columns(batch.select(names), lang_pred=pa.array([x for x, _ in found], pa.string()), score=pa.array([s for _, s in found], pa.float64()))

    return map_arrow(rest, run, [*carried, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def learn_and_identify(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = SETTINGS) -> DataFrame:
    """Id, held_out, lang_pred and score of every row; only rows that aren't held out are learnt from."""
    source = df.select(id_col, text_col, lang_col, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    profiles = learn(source.where("held_out = false"), text_col, lang_col, settings)
    return identify(source.select(id_col, "held_out", text_col), profiles, text_col, carry=[id_col, "held_out"])
