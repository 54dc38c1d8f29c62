"""Spelling variants: words at one edit from each other, by an even-partition pigeonhole join.

Words are counted in Arrow batches with a table of bounded size in each task. Two words are near if one
code point is inserted, deleted or replaced. A word of length l is cut into two even segments, of which
one edit leaves one whole, so that near words share a key (l, which segment, its text): words of length
l give both segments of their own, and words one longer give the substrings where a segment can lie
after a deletion, from the start or shifted by one. Candidates of a key are deduplicated and verified.

A key of more than ``few`` words would give a pair for each two of them. Words of such a key are
refined: the key is kept, and what is left of the word beside the segment must agree but for one code
point, which is left out in each place in turn. Words that share a refined key are near, so that their
number is bounded by the alphabet, and no pair is lost or dropped.

A word's form is its near word of largest count if that has at least ``factor`` times its own; forms of
forms are followed by doubling pointers, which a chain of n steps takes log2(n) rounds for (counts at
least double along it, so that it has at most 63 steps).

Defined cases: null and empty texts have no words; rows with a null id count like id "null"; repeated
rows are counted as often as they come; ties fall to the smaller word by code points; an empty table
gives an empty table; other input columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm.frames import cut, map_arrow, stored


@dataclass(frozen=True)
class Settings:
    least_length: int = 5  # code points
    least_count: int = 3
    factor: int = 2
    few: int = 32  # words of a key that are paired with each other
    held: int = 200_000  # words that a task counts before it passes them on


SETTINGS = Settings()

#: Maximal runs of these characters are words; A-Z are lower-cased before.
LETTERS = "[a-zÀ-ÿ]+"


def plain(doc_id: object, runs: Counter) -> Counter:
    """The words as they are."""
    return runs


def damaged(doc_id: object, runs: Counter) -> Counter:
    """The words of a document, one in 97 with a code point deleted: h is the CRC-32 of ``<id>:<word>``;
    where 97 divides it, the code point h modulo length goes."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), start)
        if h % 97 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def count_words(docs: DataFrame, change: Callable[[object, Counter], Counter] = plain, settings: Settings = SETTINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with at least least_length code points and least_count occurrences.
    change(id, runs) may alter the words of a document."""
    letters, least, held = re.compile(LETTERS), settings.least_length, settings.held

    def batch(words: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                runs = Counter(letters.findall((text.as_py() or "").encode().lower().decode()))  # of bytes, only A-Z are lowered
                for word, n in change(key.as_py(), runs).items():
                    if len(word) >= least:
                        total[word] = total.get(word, 0) + n
                if len(total) > held:
                    yield batch(total)
                    total = {}
        yield batch(total)

    counted = map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, [T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least_count)


def _segments(word: Column, length: Column, shift: int) -> list[Column]:
    """Keys of a word for an index of words of ``length``: its first segment, and the second one from
    ``shift`` places further on; with what is left of the word beside each."""
    half = F.floor(length / 2).cast("int")
    first, second = F.substr(word, F.lit(1), half), F.substr(word, half + 1 + shift)
    one = lambda side, seg, rest: F.struct(F.concat_ws("|", length.cast("string"), F.lit(side), seg).alias("key"), rest.alias("rest"))
    return [one("a", first, F.substr(word, half + 1)), one("b", second, F.substr(word, F.lit(1), half + shift))]


def keys(words: DataFrame) -> DataFrame:
    """(word, key, longer, rest): every word as one of the index, and as one that is a code point longer
    than those it probes."""
    n = F.length("word")
    own = [F.struct(F.lit(False).alias("longer"), s.alias("s")) for s in _segments(F.col("word"), n, 0)]
    probes = [F.struct(F.lit(True).alias("longer"), s.alias("s")) for s in _segments(F.col("word"), n - 1, 1)]
    rows = words.select("word", F.explode(F.array(*own, *probes)).alias("x"))
    return rows.select("word", F.col("x.s.key").alias("key"), F.col("x.longer").alias("longer"), F.col("x.s.rest").alias("rest"))


def _without_one(text: Column, place: str) -> Column:
    """(place, text less one code point) for each code point."""
    each = F.sequence(F.lit(1), F.length(text))
    return F.transform(each, lambda i: F.concat_ws("|", i.cast("string") if place else F.lit(""), F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))))


def _met(rows: DataFrame) -> DataFrame:
    """(a, b), a of the index, of rows (word, key, longer) that share a key."""
    index = rows.where("not longer").select("key", F.col("word").alias("a"))
    other = rows.select("key", "longer", F.col("word").alias("b"))
    return index.join(other, "key").where("longer or a < b").select("a", "b")


def near_pairs(words: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(a, b), each pair of distinct words (word) at one edit once."""
    all_ = keys(words)
    sizes = all_.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > settings.few).select("key")
    # crowded keys are few: at most a share of 4 / few of the words
    marked = all_.join(sizes.withColumn("crowded", F.lit(True)), "key", "left")
    # a key's row count is settled before both ways use it
    marked = stored(marked.withColumn("crowded", F.coalesce("crowded", F.lit(False))))
    # replaced: both of the index, the place counts; inserted: the longer one less a code point is the shorter
    full = F.struct(F.lit(False).alias("longer"), F.concat(F.lit("+|"), F.col("rest")).alias("r"))
    holes = F.transform(_without_one(F.col("rest"), "place"), lambda r: F.struct(F.lit(False).alias("longer"), r.alias("r")))
    shorter = F.transform(_without_one(F.col("rest"), ""), lambda r: F.struct(F.lit(True).alias("longer"), F.concat(F.lit("+"), r).alias("r")))
    kinds = F.when(F.col("longer"), F.array_distinct(shorter)).otherwise(F.concat(F.array(full), holes))
    crowded = marked.where("crowded").select("word", "key", F.explode(kinds).alias("x")).select("word", F.concat_ws("|", "key", "x.r").alias("key"), F.col("x.longer").alias("longer"))
    found = _met(marked.where("not crowded")).unionByName(_met(crowded)).distinct()
    return found.where(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the end, by doubling."""
    state = cut(forms.select("word", F.col("form").alias("to")))
    while True:
        further = state.select(F.col("word").alias("to"), F.col("to").alias("next"))
        joined = cut(state.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        state = joined.select("word", "to")
        if joined.where("moved").isEmpty():
            return state.select("word", F.col("to").alias("root"))


def group(words: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of counted words (word, n), distinct."""
    words = stored(words.select("word", "n"))
    pairs = near_pairs(words.select("word"), settings)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best"))
    strong = -F.col("best.m") >= settings.factor * F.col("n")
    linked = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))
    linked = stored(linked)
    ends = roots(linked.where("form is not null").select("word", "form"))
    return linked.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: levenshtein there counts bytes, so that letters of two bytes get one of their own before.
ORACLE_SQL = """WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
step AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
bytes AS (SELECT doc_id, run, n, list_concat(list_transform(string_split(doc_id || ':', ''), lambda x: CAST(ord(x) AS BIGINT)), flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) - 64 AS BIGINT)] END))) AS b FROM own),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, step),
changed AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
alphabet AS (SELECT string_agg(chr(CAST(192 + i AS INTEGER)), '' ORDER BY i) AS wide, string_agg(chr(CAST(33 + i AS INTEGER)), '' ORDER BY i) AS narrow FROM (SELECT unnest(range(64)) AS i)),
coded AS (SELECT word, n, translate(word, wide, narrow) AS c FROM words, alphabet),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM coded a JOIN coded b ON length(b.c) BETWEEN length(a.c) - 1 AND length(a.c) + 1 AND a.c <> b.c WHERE levenshtein(a.c, b.c) = 1),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
pick AS (SELECT near.word, min(other) AS other, any_value(best.m) AS m FROM near JOIN best ON near.word = best.word AND near.m = best.m GROUP BY near.word),
linked AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN pick.m >= 2 * w.n THEN pick.other END AS form, CASE WHEN pick.m >= 2 * w.n THEN pick.m END AS form_n FROM words w LEFT JOIN best ON best.word = w.word LEFT JOIN pick ON pick.word = w.word),
walk AS (SELECT word, word AS at FROM linked UNION ALL SELECT walk.word, l.form FROM walk JOIN linked l ON l.word = walk.at WHERE l.form IS NOT NULL)
SELECT l.word, l.n, l.n_near, l.form, l.form_n, walk.at AS root FROM linked l JOIN walk ON walk.word = l.word JOIN linked e ON e.word = walk.at AND e.form IS NULL"""
