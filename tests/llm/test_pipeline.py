import base64
import pathlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import zstandard
from test_exact_dedup import brute as exact_brute
from test_mixing import brute_targets, words
from test_near_dedup import brute as near_brute
from test_quality import brute as quality_brute

from vocaris.llm import suffix_dedup
from vocaris.llm.frames import shared_folder

pipeline = pytest.importorskip("corpus_pipeline")


def made():
    rnd = random.Random(11)
    syllables = ["th", "er", "on", "an", "re", "in", "ed", "nd", "ha", "st", "é", "ou"]
    vocabulary = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(3000)]
    prose = lambda: [rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 200))]
    texts = []
    for _ in range(60):
        base = prose()
        texts.append(" ".join(base))
        if rnd.random() < 0.4:
            texts.append("\n".join(base))
        if rnd.random() < 0.4:
            texts.append(" ".join(base + [rnd.choice(vocabulary)]))
    texts += [None, "", "too short", "again and again " * 80]
    return [(i, t, "en", rnd.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]


def test_run_equals_brute_force(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] or "" for r in rows}
    good = [(i, t) for i, t in text.items() if not quality_brute(t)[-1]]
    zip_ = zstandard.ZstdCompressor(level=3)
    assert all(len(zip_.compress(t.encode())) / len(t.encode()) > 0.4 for _, t in good)  # so no band rejects one
    one = [(i, text[i]) for i, _, _, kept, _ in exact_brute(good) if kept]
    left = {i for i, _, _, kept in near_brute(one) if kept}
    source = {r[0]: r[3] for r in rows}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i in left:
        sizes[source[i]] += words(text[i])
        largest[source[i]] = max(largest[source[i]], words(text[i]))
    copies = Counter(r.doc_id for r in out)
    assert set(copies) <= left and max(copies.values()) <= 3
    for i, n in copies.items():
        taken[source[i]] += n * words(text[i])
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    for s, want in brute_targets([(s, sizes[s]) for s in order]).items():
        assert abs(taken[s] - want) <= largest[s]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.token_ids == library.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in out)


def test_stages_keep_columns_and_take_empty_tables(spark):
    df = spark.createDataFrame([r + ("x",) for r in made()[:3]], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for docs in (df, df.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").schema.names == df.columns
            stage(spark, docs, "").count()
        assert "token_ids" in pipeline.STAGES[-1][1](spark, docs, "").columns
    assert re.fullmatch(r"[a-z_]+", pipeline.STAGES[0][0])


def test_run_deletes_its_own_tables_only(spark, tmp_path):
    rows = made()[:40]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    unfinished = suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "documents.parquet")), digest=True)
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {p for p in shared.iterdir() if re.match("table-|pipeline-", p.name)}
    out = pipeline.run(spark, str(tmp_path))
    left = {p for p in shared.iterdir() if re.match("table-|pipeline-", p.name)} - before
    assert [len(list(p.iterdir())) for p in left] == [1]  # the last stage's rows
    assert unfinished.count() == len(rows) and out.count() > 0
