"""Language-model scores of texts by sharded n-gram tries.

Tokens are lower-cased (A-Z) words and one end for each text. Blocks of texts become n-grams, each the
hashes of a word (64 bits) and of those before it (40 bits each), sorted and packed by shard. A shard is a
share of the predicted words with all their n-grams, about ``shard_tokens`` tokens, so that one task
builds or maps one shard at a time: it merges the training texts' n-grams, writes an Elias-Fano trie with
quantised smoothed probabilities (ngram_trie) to a scratch file of its own, maps it and queries it. What
returns are sums for each text of a block, which are added in the order of shards, so that reruns agree.
No table of words or n-grams goes to the driver or to every executor: only three numbers do, and the words
with at least 1 / ``hot_share`` of all tokens (``hot_share`` at most) with their counts. Such a word's
n-grams are split over shards by the word before, as many as its share asks for.

Words are compared by 64-bit hashes; two of 10**8 words are confused with probability 3e-4. Of the words
before one word, hashes of 40 bits are compared.

Defined cases: null and empty texts are one end token; repeated rows are scored each, and count each
time; a null id is in no fold (``held_out`` null) and not learnt from; without any training text all
tokens are unknown; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocaris.llm import textkernels as tk
from vocaris.llm.frames import cut, map_arrow
from vocaris.llm.ngram_trie import Smoothing, Trie, build

_U = np.uint64
END, BEGIN = _U(0x9A7EC9F1D3B5A241), _U(0x4C1D6E0BF2A98357)
#: Bits of a word's hash where it is a context.
_CONTEXT = _U(24)


@dataclass(frozen=True)
class Settings:
    smoothing: Smoothing = Smoothing()
    shard_tokens: int = 1_000_000
    block_bytes: int = 2 << 20  # of text; a longer text is a block of its own
    hot_share: int = 2048


SETTINGS = Settings()


@dataclass(frozen=True)
class Totals:
    """Tokens and distinct words of the training texts, how many texts, and the hot words' counts."""

    tokens: int
    distinct: int
    texts: int
    hot: dict[int, int] = field(default_factory=dict)


def token_block(block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every token of a block, ends included."""
    words = tk.split_words(block)
    hashes = tk.word_hashes(block, words, lower=True)
    out = np.full(len(hashes) + block.rows, END, dtype=np.uint64)
    out[np.arange(len(hashes)) + words.row] = hashes
    return out, np.repeat(np.arange(block.rows), np.diff(words.first) + 1)


def contexts_of(tokens: np.ndarray, text: np.ndarray, order: int) -> list[np.ndarray]:
    """The order - 1 words before each token, nearest first, in 40 bits; before the first word there are
    beginnings."""
    out, before = [], tokens
    starts = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
    for _ in range(order - 1):
        before = np.r_[BEGIN, before[:-1]] if len(before) else before
        before[starts] = BEGIN
        out.append(before >> _CONTEXT)
    return out


def ranks(roots: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """For each n-gram the number of smaller ones, by root and then contexts."""
    rank = np.unique(roots, return_inverse=True)[1]
    for c in contexts:
        if len(rank) and int(rank.max()) < 1 << 24:
            rank = np.unique((rank.astype(np.uint64) << _U(40)) | c, return_inverse=True)[1]
        else:
            order = np.lexsort((c, rank))
            new = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (c[order][1:] != c[order][:-1])]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new)
    return rank


def shard_of(roots: np.ndarray, contexts: list[np.ndarray], totals: Totals, shards: int, hot_share: int) -> np.ndarray:
    """The shard of each n-gram: by its root, and for hot roots by the nearest context too."""
    part = np.zeros(len(roots), np.uint64)
    if totals.hot:
        words = np.sort(np.array(list(totals.hot), dtype=np.uint64))
        parts = np.array([-(-totals.hot[int(w)] * hot_share // max(1, totals.tokens)) for w in words], dtype=np.uint64)
        at = np.minimum(np.searchsorted(words, roots), len(words) - 1)
        hot = words[at] == roots
        near = contexts[0][hot] if contexts else np.zeros(int(hot.sum()), np.uint64)
        part[hot] = tk.mix(near.copy()) % parts[at[hot]]
    return ((tk.mix(roots.copy()) + part) % _U(shards)).astype(np.int64)


def _bytes(c: np.ndarray) -> bytes:
    """40-bit values, five bytes each."""
    return np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _values(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


#: kind 0: a trie (raw); 1: n-grams of a block; 2: the block's texts (raw: tokens of each).
_FIELDS = [
    T.StructField("shard", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()),
    *[T.StructField(x, T.BinaryType()) for x in ("roots", "sizes", "contexts", "texts", "learnt", "raw")],
]


def _rows(docs: DataFrame, learnt: Column, carry: list[str], text_col: str, totals: Totals, shards: int, settings: Settings) -> DataFrame:
    """docs as rows of _FIELDS and ids, the carried columns of a block's texts."""
    order, hot_share, size = settings.smoothing.order, settings.hot_share, settings.block_bytes
    used = docs.select(F.coalesce(learnt, F.lit(False)).alias("__learnt"), F.col(text_col).alias("__text"), *[F.col(c) for c in carry])
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in used.schema.fields[2:]])
    fields = [*_FIELDS, T.StructField("ids", T.ArrayType(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            learnt_ = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for block in tk.blocks(b.column(1), size):
                out = {f.name: [] for f in fields}

                def add(**values) -> None:
                    for name, column in out.items():
                        column.append(values.get(name))

                own = slice(block.first, block.first + block.rows)
                tokens, text = token_block(block)
                contexts = contexts_of(tokens, text, order)
                shard = shard_of(tokens, contexts, totals, shards, hot_share)
                by = np.lexsort((ranks(tokens, contexts), shard))
                shard = shard[by]
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                for lo, hi in zip(cuts, [*cuts[1:], len(shard)]):
                    at = by[lo:hi]
                    r = tokens[at]
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    add(shard=int(shard[lo]), kind=1, block=number, roots=r[first].tobytes(), sizes=np.diff(np.r_[first, len(r)]).astype("<u4").tobytes(),
                        contexts=b"".join(_bytes(c[at]) for c in contexts), texts=text[at].astype("<u2" if block.rows <= 1 << 16 else "<u4").tobytes(), learnt=np.packbits(learnt_[own]).tobytes())
                ids = pa.StructArray.from_arrays([b.column(i).slice(block.first, block.rows) for i in range(2, b.num_columns)], names=kept.names)
                add(shard=number % shards, kind=2, block=number, raw=np.bincount(text, minlength=block.rows).astype("<i8").tobytes())
                arrays = [pa.array(out[f.name], {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(f.dataType, pa.binary())) for f in fields[:-1]]
                lists = pa.ListArray.from_arrays(pa.array([*[0] * len(out["kind"]), block.rows], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([*arrays, lists], names=[f.name for f in fields])
                number += 1

    return map_arrow(used, run, fields)


def totals(docs: DataFrame, learnt: Column, settings: Settings = SETTINGS, text_col: str = "text") -> Totals:
    """Counts over all training texts. Words are summed by Spark; from each task come its sums and its
    most frequent words."""
    size, share = settings.block_bytes, settings.hot_share
    rows = lambda w, n, v, t: pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), *[pa.array(x, pa.int64()) for x in (n, v, t)]], names=["w", "n", "v", "t"])
    fields = [T.StructField(x, T.LongType()) for x in ("w", "n", "v", "t")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in tk.blocks(b.column(0), size):
                w, n = np.unique(token_block(block)[0], return_counts=True)
                yield rows(w.view(np.int64), n, np.zeros(len(w), np.int64), np.where(w == END, block.rows, 0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = t = 0
        most = np.zeros((0, 2), np.int64)
        for b in batches:
            own = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            n, v, t = n + int(own[:, 1].sum()), v + len(own), t + int(b.column(3).to_numpy().sum())
            most = np.concatenate((most, own))
            most = most[np.argsort(-most[:, 1], kind="stable")[:share]]
        yield rows([None, *most[:, 0]], [n, *most[:, 1]], [v, *[0] * len(most)], [t, *[0] * len(most)])

    counted = map_arrow(docs.where(F.coalesce(learnt, F.lit(False))).select(F.col(text_col)), count, fields).groupBy("w").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("t").alias("t"))
    small = cut(map_arrow(counted, sums, fields))
    n, v, t = (int(x or 0) for x in small.where("w is null").agg(F.sum("n"), F.sum("v"), F.sum("t")).first())
    # at most hot_share words can have this share of all tokens
    hot = {int(r.w) % (1 << 64): int(r.n) for r in small.where(F.col("w").isNotNull() & (F.col("n") * share >= n)).collect()}
    return Totals(n, v, t, hot)


def _unpacked(row: dict, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(roots, contexts, texts, learnt by text) of a packed row."""
    roots = np.repeat(np.frombuffer(row["roots"], "<u8"), np.frombuffer(row["sizes"], "<u4"))
    n = len(roots)
    c = _values(row["contexts"])
    texts = np.frombuffer(row["texts"], "<u2" if len(row["texts"]) == 2 * n else "<u4")
    return roots, [c[k * n : (k + 1) * n] for k in range(order - 1)], texts, np.unpackbits(np.frombuffer(row["learnt"], np.uint8)).astype(bool)


def _trie_of(rows: list[dict], totals_: Totals, smoothing: Smoothing) -> bytes:
    """The trie of the training texts' n-grams in packed rows."""
    roots, contexts = [np.zeros(0, np.uint64)], [[np.zeros(0, np.uint64)] for _ in range(smoothing.order - 1)]
    for row in rows:
        r, c, texts, learnt = _unpacked(row, smoothing.order)
        own = learnt[texts]
        roots.append(r[own])
        for held, x in zip(contexts, c):
            held.append(x[own])
    r, c = np.concatenate(roots), [np.concatenate(x) for x in contexts]
    _, first, counts = np.unique(ranks(r, c), return_index=True, return_counts=True)
    return build(r[first], [x[first] for x in c], counts.astype(np.int64), totals_.tokens, totals_.distinct, smoothing, totals_.hot)


def _mapped(raw: bytes, smoothing: Smoothing) -> Trie:
    """The trie, mapped from a scratch file that vanishes with the mapping."""
    handle, path = tempfile.mkstemp(prefix="trie-")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(raw)
        return Trie(np.memmap(path, dtype=np.uint8, mode="r"), smoothing)
    finally:
        os.unlink(path)


def _sums(rows: list[dict], trie: Trie, totals_: Totals) -> Iterator[tuple]:
    """(block, texts, known, base, score) of packed rows."""
    s = trie.smoothing
    for at in range(0, len(rows), 32):
        some = [(row, *_unpacked(row, s.order)) for row in rows[at : at + 32]]
        roots = np.concatenate([x[1] for x in some])
        contexts = [np.concatenate([x[2][k] for x in some]) for k in range(s.order - 1)]
        by = np.argsort(roots, kind="stable")
        n, score, context = (np.empty(len(by), kind) for kind in (np.int64, np.float64, np.float64))
        n[by], score[by], context[by] = trie.query(roots[by], [c[by] for c in contexts], totals_.hot)
        score -= np.where(roots == END, 0.0, context)
        base = np.log10((n + s.added) / (totals_.tokens + s.added * (totals_.distinct + 1)))
        lo = 0
        for row, r, _, texts, learnt in some:
            hi, size = lo + len(r), int(texts.max()) + 1
            sums = [np.bincount(texts, weights=x[lo:hi], minlength=size) for x in (n > 0, base, score)]
            yield row["block"], sums[0].astype("<u4").tobytes(), sums[1].astype("<f8").tobytes(), sums[2].astype("<f4").tobytes()
            lo = hi


def _shard_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(shard, rows) of sorted rows, one shard at a time."""
    at, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if row["shard"] != at:
                if held:
                    yield at, held
                at, held = row["shard"], []
            held.append(row)
    if held:
        yield at, held


@dataclass(frozen=True)
class Model:
    """Tries (shard, raw) and what is known of all training texts."""

    tries: DataFrame
    totals: Totals
    shards: int


def _shards(totals_: Totals, settings: Settings) -> int:
    return max(1, -(-totals_.tokens // settings.shard_tokens))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "kind", "block")


def train(docs: DataFrame, learnt: Column | None = None, settings: Settings = SETTINGS, text_col: str = "text") -> Model:
    """A model of the texts where learnt holds (all)."""
    learnt = F.lit(True) if learnt is None else learnt
    t = totals(docs, learnt, settings, text_col)
    shards, smoothing = _shards(t, settings), settings.smoothing
    own = docs.where(F.coalesce(learnt, F.lit(False))).select(F.col(text_col), F.lit(1).alias("__one"))
    rows = _rows(own, F.lit(True), ["__one"], text_col, t, shards, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _shard_groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([_trie_of(held, t, smoothing)], pa.binary())], names=["shard", "raw"])

    tries = map_arrow(_dealt(rows.where("kind = 1").drop("ids")), run, [_FIELDS[0], _FIELDS[-1]])
    return Model(tries, t, shards)


def _scored(rows: DataFrame, t: Totals, shards: int, settings: Settings) -> DataFrame:
    """The carried columns, n_tokens, n_known, base_score and score of each text of _rows. A shard that
    comes with a trie is queried in it, another one in the trie of its own training texts."""
    smoothing = settings.smoothing
    carried = rows.schema["ids"]
    fields = [T.StructField("block", T.LongType()), T.StructField("shard", T.LongType()), *[T.StructField(x, T.BinaryType()) for x in ("raw", "known", "base", "score")], T.StructField("ids", carried.dataType)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(shard: int, held: list[dict]) -> pa.RecordBatch:
            raw = next((r["raw"] for r in held if r["kind"] == 0), None)
            grams = [r for r in held if r["kind"] == 1]
            trie = _mapped(_trie_of(grams, t, smoothing) if raw is None else raw, smoothing)
            out = [(b, shard, None, *x) for b, *x in _sums(grams, trie, t)]
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.nulls(len(out), ids_type)], names=[f.name for f in fields])

        ids_type = None
        at, held = None, []
        for b in batches:
            ids_type = b.schema.field("ids").type
            kind = b.column(1).to_numpy()
            for k in np.flatnonzero(kind == 2):  # a block's texts pass through
                row = b.slice(k, 1)
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([row.column("block"), pa.array([-1], pa.int64()), row.column("raw"), none, none, none, row.column("ids")], names=[f.name for f in fields])
            for row in b.filter(pa.array(kind != 2)).drop_columns(["ids"]).to_pylist():
                if row["shard"] != at:
                    if held:
                        yield answer(at, held)
                    at, held = row["shard"], []
                held.append(row)
        if held:
            yield answer(at, held)

    answers = map_arrow(_dealt(rows), ask, fields)
    names = carried.dataType.elementType.names
    numbers = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    start = t.texts + smoothing.mass  # D of the beginnings before a text
    for _ in range(smoothing.order - 2):
        start = t.texts + smoothing.share * start
    first = float(np.log10(start))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokens = None

        def whole() -> pa.RecordBatch:
            columns = [ids.field(k) for k in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(tokens), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score - first)], names=[*names, *[f.name for f in numbers]])

        for b in batches:
            for k in range(b.num_rows):
                if b.column(1)[k].as_py() < 0:
                    if ids is not None:
                        yield whole()
                    ids, tokens = b.column("ids")[k].values, np.frombuffer(b.column("raw")[k].as_py(), "<i8")
                    known, base, score = np.zeros(len(tokens)), np.zeros(len(tokens)), np.zeros(len(tokens))
                    continue
                for total, name, kind in ((known, "known", "<u4"), (base, "base", "<f8"), (score, "score", "<f4")):
                    x = np.frombuffer(b.column(name)[k].as_py(), kind)
                    total[: len(x)] += x
        if ids is not None:
            yield whole()

    inner = [T.StructField(f.name, f.dataType) for f in carried.dataType.elementType.fields]
    return map_arrow(answers.repartition("block").sortWithinPartitions("block", "shard"), add, [*inner, *numbers]).withColumn("train_tokens", F.lit(t.tokens).cast("long"))


def score(docs: DataFrame, model: Model, carry: list[str], settings: Settings = SETTINGS, text_col: str = "text") -> DataFrame:
    """Scores of docs by a trained model; settings as in training."""
    rows = _rows(docs, F.lit(False), carry, text_col, model.totals, model.shards, settings)
    tries = model.tries.select("shard", "raw", F.lit(0).alias("kind"))
    return _scored(rows.unionByName(tries, allowMissingColumns=True), model.totals, model.shards, settings)


def learn_and_score(docs: DataFrame, held_out: Column, settings: Settings = SETTINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): learns from texts that aren't
    held out and scores all, in one pass over the n-grams."""
    used = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col))
    t = totals(used, ~F.col("held_out"), settings, text_col)
    shards = _shards(t, settings)
    rows = _rows(used, ~F.col("held_out"), [id_col, "held_out"], text_col, t, shards, settings)
    found = _scored(rows, t, shards, settings)
    return found.select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
