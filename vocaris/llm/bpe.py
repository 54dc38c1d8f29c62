"""Byte-level BPE encoding and decoding against a published rank file.

A text is cut into pre-tokens by the vocabulary's pattern; each one is encoded alone:

* tier 1 - a minimal perfect hash over the whole vocabulary (as many slots as tokens, two array
  reads and one comparison of bytes) resolves a pre-token that is itself a token;
* tier 2 - any other pre-token starts as linked single bytes; a heap of adjacent pairs, ordered by
  (rank, position), merges the lowest one until no pair is a token.

Both tiers feed a bounded memo of pre-tokens, as texts repeat their words. Special tokens are never
produced. Decoding concatenates the tokens' bytes, so decode(encode(text)) is the text's UTF-8.

Defined cases: a null text encodes like the empty text, to an empty list; a null list decodes to
empty bytes; texts of any length are encoded whole; rows are never merged or dropped, equal or not;
an empty table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vocaris.llm.frames import append_columns, map_arrow, without

#: Pre-tokens that a worker remembers; beyond it the memo starts anew.
MEMO_ENTRIES = 400_000


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


_M64 = (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M64
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _M64
    return ((x >> 32) * n) >> 32


@dataclass
class MinimalPerfectHash:
    """Hash and displace: a key's bucket names the displacement that sends it to its own slot.

    ``displacement[b] < 0`` is the slot itself, for buckets of one key; ``ids[slot]`` is the key's
    id. There are exactly as many slots as keys.
    """

    displacement: list[int]
    ids: list[int]

    @classmethod
    def build(cls, keys: list[bytes]) -> MinimalPerfectHash:
        n = len(keys)
        buckets: list[list[int]] = [[] for _ in range(max(1, n // 4))]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % len(buckets)].append(i)
        ids, displacement = [-1] * n, [0] * len(buckets)
        order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
        free: Iterator[int] | None = None
        for b in order:
            group = buckets[b]
            if len(group) > 1:
                d = 0
                while True:
                    slots = {_slot(hashes[i], d, n) for i in group}
                    if len(slots) == len(group) and all(ids[s] < 0 for s in slots):
                        break
                    d += 1
                for i in group:
                    ids[_slot(hashes[i], d, n)] = i
                displacement[b] = d
            elif group:
                free = free or iter([s for s in range(n) if ids[s] < 0])
                s = next(free)
                ids[s], displacement[b] = group[0], -s - 1
        return cls(displacement, ids)

    def candidate(self, key: bytes) -> int:
        """The only id that the key can have; the caller compares the bytes."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % len(self.displacement)]
        return self.ids[-d - 1 if d < 0 else _slot(h, d, len(self.ids))]


class Codec:
    """Vocabulary, pattern and both tiers; one per Python worker."""

    def __init__(self, tokens: list[bytes], table: MinimalPerfectHash, pattern: str):
        self.tokens, self.table = tokens, table
        self.split = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.longest = max(map(len, tokens), default=0)
        self.memo: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Tier 2. after[i] is where the part that starts at i ends, -1 if i starts none."""
        n, rank_of, longest = len(piece), self.ranks.get, self.longest
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            j = after[i]
            if j < 0 or j >= n or after[j] != e:
                continue
            after[i], after[j] = e, -1
            if e < n:
                before[e] = i
                end = after[e]
                if end - i <= longest and (r := rank_of(piece[i:end])) is not None:
                    heappush(heap, (r, i, end))
            p = before[i]
            if p >= 0 and e - p <= longest and (r := rank_of(piece[p:e])) is not None:
                heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def resolve(self, pretoken: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        piece = pretoken.encode("utf-8", "surrogatepass")
        i = self.table.candidate(piece)
        ids = [i] if i >= 0 and self.tokens[i] == piece else self.merge(piece)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        memo = self.memo
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            if len(memo) > MEMO_ENTRIES:
                memo = self.memo = {}
            for p in set(pieces):
                if p not in memo:
                    memo[p] = self.resolve(p)
            return b"".join([memo[p] for p in pieces])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode_batch(codec: Codec, batch: pa.RecordBatch, text_col: str, ids_col: str) -> pa.RecordBatch:
    texts = batch.column(batch.schema.names.index(text_col))
    rows = [codec.encode(t.as_py() or "") for t in texts]
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    values = np.frombuffer(b"".join(rows), dtype="<i4")
    return append_columns(batch, **{ids_col: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))})


def decode_batch(codec: Codec, batch: pa.RecordBatch, ids_col: str, out_col: str) -> pa.RecordBatch:
    lists = batch.column(batch.schema.names.index(ids_col))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    out = [codec.decode(values[a:b]) if ok else b"" for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]
    return append_columns(batch, **{out_col: pa.array(out, type=pa.binary())})


def digest_batch(batch: pa.RecordBatch, ids_col: str, decoded_col: str, drop: list[str]) -> pa.RecordBatch:
    """n_tokens, ids_sha256 and decoded_sha256 beside what isn't dropped."""
    lists = batch.column(batch.schema.names.index(ids_col))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
    hashed = [hashlib.sha256(values[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
    decoded = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(batch.schema.names.index(decoded_col))]
    return append_columns(batch.drop_columns(drop), n_tokens=pa.array(np.diff(offsets).astype(np.int64)), ids_sha256=pa.array(hashed, type=pa.string()), decoded_sha256=pa.array(decoded, type=pa.string()))


class Vocabulary:
    """Read and hashed once on the driver, broadcast to the workers (a fixed size: the rank file's)."""

    def __init__(self, df: DataFrame, path: str, pattern: str):
        tokens, table = _prepared(path)
        self.shared = df.sparkSession.sparkContext.broadcast((tokens, table.displacement, table.ids, pattern))

    def codec(self) -> Codec:
        tokens, displacement, ids, pattern = self.shared.value
        return Codec(tokens, MinimalPerfectHash(displacement, ids), pattern)


@lru_cache(maxsize=4)
def _prepared(path: str) -> tuple[list[bytes], MinimalPerfectHash]:
    tokens = load_ranks(path)
    return tokens, MinimalPerfectHash.build(tokens)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """df with the token ids of every whole text."""
    vocabulary, rest = Vocabulary(df, path, pattern), without(df, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for part in slices(batch):
                yield encode_batch(codec, part, text_col, ids_col)

    return map_arrow(rest, run, [*rest.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for."""
    vocabulary, rest = Vocabulary(df, path, pattern), without(df, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for part in slices(batch):
                yield decode_batch(codec, part, ids_col, out_col)

    return map_arrow(rest, run, [*rest.schema.fields, T.StructField(out_col, T.BinaryType())])


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """Id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, and the ids themselves if
    ids_col names them: encode, then decode, then digest in one pass, so that the decoded bytes
    needn't leave the Python worker."""
    vocabulary = Vocabulary(df, path, pattern)
    source = df.select(id_col, text_col)
    ids = ids_col or "__ids"
    drop = ["__bytes"] if ids_col else ["__bytes", ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for part in slices(batch):
                encoded = encode_batch(codec, part, text_col, ids)
                decoded = decode_batch(codec, encoded.drop_columns([text_col]), ids, "__bytes")
                yield digest_batch(decoded, ids, "__bytes", drop)

    own = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] if ids_col else []
    digests = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_arrow(source, run, [source.schema[id_col], *own, *digests])
