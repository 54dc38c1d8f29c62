"""Segmentation operators against plain folds over each recording."""

import random

from pyspark.sql import functions as F

from vocaris.operators import framing, turns, vad
from vocaris.plans import catalog


def fold_vad(scores, samples, c=vad.VAD):
    out, start, quiet = [], None, None
    for i, p in enumerate(scores):
        at = i * c.frame
        if p >= c.threshold:
            quiet = None
            start = at if start is None else start
        elif p < c.threshold - c.negative_gap and start is not None:
            quiet = at if quiet is None else quiet
            if at - quiet >= c.min_silence:
                if quiet - start > c.min_speech:
                    out.append((start, quiet))
                start = quiet = None
    if start is not None:
        out.append((start, samples))
    return out


def fold_pad(speech, samples, c=vad.VAD):
    speech = [list(x) for x in speech]
    for k, x in enumerate(speech):
        if k == 0:
            x[0] = max(0, x[0] - c.pad)
        if k + 1 < len(speech):
            gap = speech[k + 1][0] - x[1]
            if gap < 2 * c.pad:
                x[1] += gap // 2
                speech[k + 1][0] = max(0, speech[k + 1][0] - gap // 2)
            else:
                x[1] += c.pad
        else:
            x[1] = min(samples, x[1] + c.pad)
    return [tuple(x) for x in speech]


def scored(seed=1, n=120):
    rnd = random.Random(seed)
    return {r: [rnd.uniform(0, 1) if rnd.random() < 0.6 else rnd.uniform(0.3, 0.55) for _ in range(rnd.randrange(1, 60))] for r in range(n)}


def frames(spark, data):
    return spark.createDataFrame([(r, i, p) for r, ps in data.items() for i, p in enumerate(ps)], "rec long, i long, p double")


def by_rec(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(tuple(r)[2:])
    return out


def test_hysteresis_and_padding_equal_the_fold(spark):
    data = scored()
    lengths = {r: len(ps) * 1536 - (r % 1000) for r, ps in data.items()}
    length_df = spark.createDataFrame(list(lengths.items()), "rec long, samples long")
    for config in (vad.VAD, vad.VadConfig(min_silence=0, pad=1500)):
        speech = vad.hysteresis(frames(spark, data), length_df, config)
        want = {r: fold_vad(ps, lengths[r], config) for r, ps in data.items()}
        assert by_rec(speech.collect()) == {r: x for r, x in want.items() if x}
        padded = vad.pad(speech, length_df, config)
        assert by_rec(padded.collect()) == {r: fold_pad(x, lengths[r], config) for r, x in want.items() if x}


def test_runs_index_mask_and_smoothing(spark):
    data = scored(2, 40)
    df = frames(spark, data)
    runs = by_rec(vad.runs(df, F.col("p") >= 0.5).collect())
    index = {(r.rec, r.i): r.pos for r in vad.speech_index(df, F.col("p") >= 0.5).collect()}
    smooth = {(r.rec, r.i): r.p for r in vad.smooth(df, "p", 5).collect()}
    mask = {(r.rec, r.i): r.speech for r in vad.frame_mask(df, vad.runs(df, F.col("p") >= 0.5), 7).collect()}
    for r, ps in data.items():
        want, n = [], 0
        for i, p in enumerate(ps):
            if p >= 0.5:
                n += 1
                if want and want[-1][1] == i - 1:
                    want[-1][1] = i
                else:
                    want.append([i, i])
            assert index[r, i] == (n if p >= 0.5 else 0)
            h = min(2, i, len(ps) - 1 - i)
            assert abs(smooth[r, i] - sum(ps[i - h : i + h + 1]) / (2 * h + 1)) < 1e-9
        assert runs.get(r, []) == [tuple(x) for x in want]
        assert [mask[r, i] for i in range(len(ps))] == [int(any(a <= i < b for a, b in want)) for i in range(len(ps))]


def fold_overlaps(windows):
    out = []
    for s, e, label in windows:
        if out and s <= out[-1][1]:
            if out[-1][2] == label:
                out[-1][1] = e
                continue
            middle = s + (out[-1][1] - s) // 2
            out[-1][1] = middle
            s = middle
        out.append([s, e, label])
    return [tuple(x) for x in out]


def fold_merge(turn_list, tolerance):
    out = []
    for s, e, label in turn_list:
        if out and out[-1][2] == label and out[-1][1] + tolerance >= s:
            out[-1][1] = e
        else:
            out.append([s, e, label])
    return [tuple(x) for x in out]


def test_overlaps_and_merging_equal_the_fold(spark):
    rnd = random.Random(3)
    data = {}
    for r in range(100):
        at, data[r] = 0, []
        for _ in range(rnd.randrange(1, 25)):
            at += rnd.choice([0, 12000, 12000, 24000, 30000, 72000])
            data[r].append((at, at + rnd.choice([24000, 20001, 3]), rnd.choice("ab")))
    df = spark.createDataFrame([(r, k, *w) for r, ws in data.items() for k, w in enumerate(ws)], "rec long, k int, s long, e long, label string")
    turned = turns.resolve_overlaps(df)
    want = {r: fold_overlaps(w) for r, w in data.items()}
    assert by_rec(turned.collect()) == want
    assert by_rec(turns.merge_same_speaker(turned, 48000).collect()) == {r: fold_merge(w, 48000) for r, w in want.items()}


def test_projection_modes_and_numbering(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.004, "b"), (1, 2, 1.0, 2.0, "a"), (1, 3, 2.0, 3.004, "b")], "rec long, seg int, s double, e double, label string")
    assert [(r.seg_id, r.spk_id, r.seg_begin, r.seg_end) for r in turns.wire_segments(df, 2).orderBy("seg_id").collect()] == [(1, "spk1", 0.0, 1.0), (2, "spk2", 1.0, 2.0), (3, "spk1", 2.0, 3.0)]
    want = {"windowed": 2.01, "neural": 2.008, "legacy": 2.0}
    for mode, duration in want.items():
        got = {r.spk_id: (r.duration, r.nbr_seg) for r in turns.speaker_stats(df, mode).collect()}
        assert got == {"spk1": (duration, 2), "spk2": (1.0, 1)}
    assert turns.json_result(df).first().result.startswith('{"speakers":[{"spk_id":"spk1","duration":2.01,"nbr_seg":2}')


def test_frame_labels_and_transcript(spark):
    labels = [1] * 5 + [0] * 3 + [1] * 4 + [2] * 2 + [1] * 3 + [2] * 6
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "rec long, i int, label int")
    assert [tuple(r)[2:] for r in turns.frame_labels_to_turns(df, 2).orderBy("turn").collect()] == [(0, 17, 1), (17, 6, 2)]
    segments = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "rec long, seg int, e double")
    words = spark.createDataFrame([(1, k, k + 0.5, w) for k, w in enumerate("a b c d e".split())], "rec long, w int, e double, text string")
    assert [r.text for r in turns.transcript(segments, words).orderBy("seg").collect()] == ["a", "b c d e"]


def fold_transcript(rows):
    last = lambda *keys: tuple((k is None, k) for k in keys)
    out = {}
    for rec in {r[0] for r in rows}:
        said = sorted((r[1:] for r in rows if r[0] == rec), key=lambda r: last(*r))
        words = [x[-1] for x in sorted((last(*r), p, x) for r in said for p, x in enumerate((r[2] or "").split(" ")))]
        end = lo = 0
        for seg, r in enumerate(said, 1):
            end += len(r[2] or "") // 4 + 1
            cut = max(sum((n + 1) * 2 < end for n in range(len(words))) - 1, 0)
            out[rec, seg] = " ".join(words[lo : None if seg == len(said) else cut]) if rec is not None else ""
            lo = cut
    return out


def shuffled(plan):
    """Bytes of the rows that an executed plan has sent through exchanges."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_transcript_of_odd_rows(spark, tmp_path):
    """Nulls come last in a conversation, as in the SQL; equal rows give their words in turns."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["a", "bb", "", "dé", "wörds"]) for _ in range(n))
    rows = []
    for rec in [*range(12), None]:
        for _ in range(r.randint(1, 7)):
            rows += [(rec, r.choice([0, 1, None]), r.choice(["user", "assistant", None]), r.choice([None, "", text(2), text(40), text(700)]))] * r.choice([1, 1, 3])
    rows += [(20, k // 2, "user", r.choice([None, "yes no", text(9)])) for k in range(200)] + [(21, 0, "user", text(3000))]
    spark.createDataFrame(rows, CONVERSATIONS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["transcript_align"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {(x.rec, x.seg): x.text for x in got} == fold_transcript(rows)


def test_transcript_moves_texts_not_words(spark, tmp_path):
    """A text isn't repeated for each of its words."""
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(k // 5, k % 5, "user", text) for k in range(300)]
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    df = catalog.QUERIES["transcript_align"](spark, str(tmp_path))
    assert sum(x.text.count(" ") + 1 for x in df.collect()) == 300 * 400
    assert shuffled(df._jdf.queryExecution().executedPlan()) < 40 * 300 * len(text)


def test_transcript_of_runs(spark):
    """Runs of words as their words alone, blocks of any length."""
    r = random.Random(4)
    words, runs, segments = [], [], []
    for rec in range(8):
        n, at = 0, 0.0
        for _ in range(r.randint(0, 9)):
            run = [(at := at + r.choice([0.0, 0.5, 1.0]), r.choice(["a", "b c", "", None])) for _ in range(r.choice([1, 3, 50]))]
            words += [(rec, n + p, e, x) for p, (e, x) in enumerate(run)]
            runs.append((rec, n, [e for e, _ in run], [x for _, x in run]))
            n, at = n + len(run), at + 0.5
        segments += [(rec, k, e) for k, e in enumerate(sorted(r.uniform(0, at + 2) // 0.5 * 0.5 for _ in range(r.choice([1, 4, 30]))), 1)]
    segments, words, runs = spark.createDataFrame(segments, "rec long, seg int, e double"), spark.createDataFrame(words, "rec long, w int, e double, text string"), spark.createDataFrame(runs, "rec long, n long, ends array<double>, texts array<string>")
    want = {(x.rec, x.seg): x.text for x in turns.transcript(segments, words).collect()}
    for block in (1, 7, 256):
        got = turns.transcript_of_runs(segments, runs, block).collect()
        assert len(got) == len(want) and {(x.rec, x.seg): x.text for x in got} == want


def test_windows_segments_and_budgets(spark):
    utt = spark.createDataFrame([(1, 1, 100, 100 + 50000), (1, 2, 70000, 80000), (1, 3, 90000, 114000)], "rec long, utt int, s long, e long")

    def fold(n):
        out, at = [], 0
        while at + 24000 < n:
            out.append((at, at + 24000))
            at += 12000
        return [*out, (at, n - 1)]

    want = [(s + a, s + b) for s, e in ((100, 50100), (70000, 80000), (90000, 114000)) for a, b in fold(e - s)]
    assert [(r.s, r.e) for r in framing.sliding_windows(utt).orderBy("k").collect()] == want
    runs = spark.createDataFrame([(1, 1, 0, 250), (1, 2, 300, 300)], "rec long, run int, first long, last long")
    assert [tuple(r)[2:] for r in framing.segment_table(runs).orderBy("beg").collect()] == [(0, 0, 99, 199), (0, 100, 199, 250), (100, 200, 250, 250)]
    clips = spark.createDataFrame([(1, "a", 1, 0.0, 100.0), (1, "a", 2, 0.0, 120.0), (1, "a", 3, 0.0, 5.0)], "rec long, spk string, seg int, s double, e double")
    assert [(r.seg, r["take"]) for r in framing.select_longest(clips, 10, 180).orderBy("seg").collect()] == [(1, 600), (2, 1200)]
    assert framing.frames(spark.createDataFrame([(1, 1537)], "rec long, samples long")).count() == 2
