import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from vocaris.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "Hello  world\n\n it's 12345 ünïcödé été 漢字 🙂", " ", "a" * 3000, "x1 " * 5000, "<|endoftext|>", "\x00\x1c\x85 tab\t\tend \r\n", "dup", "dup"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, token_ids string, N_Tokens int")


def test_encode_equals_the_library_and_decodes_back(spark):
    want = reference()
    coded = bpe.encode(frame(spark), PATH, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "N_Tokens", "token_ids"]
    rows = bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.token_ids == want.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_round_trip_digests(spark):
    want = reference()
    for r in bpe.round_trip(frame(spark), PATH, public_tokenizers.PATTERN).collect():
        ids = want.encode_ordinary(TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_empty_table_and_null_ids(spark):
    assert bpe.round_trip(frame(spark).limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [0, 1])], "doc_id long, token_ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, PATH, public_tokenizers.PATTERN).collect()}
    assert got[1] == b"" and len(got[2]) == 2


def test_perfect_hash_is_minimal():
    tokens = bpe.load_ranks(PATH)
    table = bpe.MinimalPerfectHash.build(tokens)
    assert sorted(table.ids) == list(range(len(tokens)))
    assert all(table.candidate(t) == i for i, t in enumerate(tokens))
