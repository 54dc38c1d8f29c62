"""Queries over the shared tables, one for each operator, with their SQL.

Adapters read the tables as recordings: ``events`` as frame scores and labelled intervals,
``lineitem`` as frame scores at scale, ``conversations`` as turns and transcripts, ``embeddings`` as
windows (fifty to a recording) and voiceprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocaris.functions import ids
from vocaris.operators import binary_keys, clustering, framing, graphs, identify, requests, similarity, stitching, store, turns, vad, vector_index
from vocaris.plans import pipelines
from vocaris.sources import results, shared
from vocaris.streaming import speech

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _epoch(ts):
    return F.unix_timestamp(ts.cast("timestamp"))


# --- adapters --------------------------------------------------------------------------------


def frames(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(s, d, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.least(F.lit(1.0), F.col("value") / 100).alias("p"))


def many_frames(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return _table(s, d, "lineitem").select(F.col("l_suppkey").alias("rec"), (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("l_quantity") / 50).alias("p"))


def intervals(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = _epoch(F.col("ts"))
    return _table(s, d, "events").select(F.col("user_id").alias("rec"), F.row_number().over(w).cast("long").alias("k"), at.alias("s"), (at + F.floor(F.col("value") * 600) + 1).alias("e"), F.col("event_type").alias("label"))


def conversation_turns(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = _table(s, d, "conversations").select(F.col("conv_id").alias("rec"), F.row_number().over(w).cast("long").alias("seg"), F.col("role").alias("label"), (F.length(F.coalesce("text", F.lit(""))) / 15.0).alias("dur"))
    before = Window.partitionBy("rec").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("s", F.coalesce(F.sum("dur").over(before), F.lit(0.0))).withColumn("e", F.col("s") + F.col("dur")).drop("dur")


def windows(s: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return _table(s, d, "embeddings").select(F.floor(v / 50).alias("rec"), (v % 50).cast("int").alias("k"), "embedding")


def voiceprints(s: SparkSession, d: str) -> DataFrame:
    label = F.col("label").cast("string")
    return _table(s, d, "embeddings").select(F.col("vec_id").alias("point"), F.col("embedding").alias("vector"), F.concat(F.lit("label:"), label).alias("speaker_id"), F.concat(F.lit("Name "), label).alias("name"))


def search_queries(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector, against all of them."""
    return _table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


_FRAMES = "frames AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, least(1.0, value / 1e2) AS p FROM events)"
_MANY = "frames AS (SELECT l_suppkey AS rec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS i, l_quantity / 5e1 AS p FROM lineitem)"
_INTERVALS = """iv AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s,
  CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 600) AS BIGINT) + 1 AS e, event_type AS label FROM events)"""
_TURNS = """t0 AS (SELECT conv_id AS rec, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seg, role AS label, length(coalesce(text, '')) / 1.5e1 AS dur FROM conversations),
turns AS (SELECT rec, seg, label, s, s + dur AS e FROM (SELECT *, coalesce(sum(dur) OVER (PARTITION BY rec ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS s FROM t0))"""
_NAMED = _TURNS + """,
fst AS (SELECT rec, label, min(seg) AS f FROM turns GROUP BY ALL),
nm AS (SELECT rec, label, 'spk' || row_number() OVER (PARTITION BY rec ORDER BY f) AS spk_id FROM fst),
named AS (SELECT turns.*, spk_id FROM turns JOIN nm USING (rec, label))"""
_LENGTHS = "lengths AS (SELECT rec, (max(i) + 1) * 1536 AS samples FROM frames GROUP BY rec)"
_SPEECH = """g0 AS (SELECT *, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp, max(i) OVER (PARTITION BY rec) AS last FROM frames),
g1 AS (SELECT rec, grp, min(i) AS h, min(i) FILTER (WHERE p < 0.5e0 - 0.15e0) AS l1, max(i) FILTER (WHERE p < 0.5e0 - 0.15e0) AS l2, max(last) AS last FROM g0 WHERE grp > 0 GROUP BY rec, grp),
g2 AS (SELECT *, coalesce((l2 - l1) * 1536 >= 1600, false) AS closed FROM g1),
g3 AS (SELECT *, coalesce(sum(CASE WHEN closed THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM g2),
g4 AS (SELECT rec, isl, min(h) AS h, max(CASE WHEN closed THEN l1 END) AS l1, max(last) AS last FROM g3 GROUP BY rec, isl),
speech AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY isl) AS utt, h * 1536 AS s, coalesce(l1 * 1536, (last + 1) * 1536) AS e FROM g4 WHERE l1 IS NULL OR (l1 - h) * 1536 > 4000)"""
_PADDED = _LENGTHS + """,
pd0 AS (SELECT speech.*, samples, lead(s) OVER w AS nx, lag(e) OVER w AS pv FROM speech JOIN lengths USING (rec) WINDOW w AS (PARTITION BY rec ORDER BY utt)),
padded AS (SELECT rec, utt,
  CAST(CASE WHEN pv IS NULL THEN greatest(0, s - 480) WHEN s - pv < 960 THEN greatest(0, s - floor((s - pv) / 2.0)) ELSE s END AS BIGINT) AS s,
  CAST(CASE WHEN nx IS NULL THEN least(samples, e + 480) WHEN nx - e < 960 THEN e + floor((nx - e) / 2.0) ELSE e + 480 END AS BIGINT) AS e FROM pd0)"""
_WIN = "win AS (SELECT vec_id // 50 AS rec, CAST(vec_id % 50 AS INTEGER) AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = _WIN + ", cos AS (SELECT a.rec, a.k AS i, b.k AS j, list_cosine_similarity(a.v, b.v) AS c FROM win a JOIN win b USING (rec))"
_HALF = _COS + ", aff AS (SELECT rec, i, j, (c + 1) / 2 AS w FROM cos)"
_HITS = """q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
pt AS (SELECT vec_id AS point, CAST(embedding AS DOUBLE[]) AS pv, 'label:' || label AS speaker_id, 'Name ' || label AS name FROM embeddings),
h0 AS (SELECT query, point, speaker_id, name, list_cosine_similarity(qv, pv) AS score FROM q, pt),
hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, point) AS rank FROM h0 QUALIFY rank <= 10)"""


def _with(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join(ctes) + "\n" + last


def _r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- projections -----------------------------------------------------------------------------


@query("label_renumber", _with(_NAMED, "SELECT rec, seg, label, spk_id FROM named"))
def label_renumber(s, d):
    return turns.renumber(conversation_turns(s, d)).select("rec", "seg", "label", "spk_id")


def _stats_sql(duration: str) -> str:
    return _with(_NAMED, f"SELECT rec, spk_id, {duration} AS duration, count(*) AS nbr_seg FROM named GROUP BY rec, spk_id")


@query("speaker_stats", _stats_sql("round(sum(e - s), 2)"))
def speaker_stats(s, d):
    return turns.speaker_stats(conversation_turns(s, d), "windowed")


@query("speaker_stats_neural", _stats_sql("round(sum(round(e - s, 3)), 3)"))
def speaker_stats_neural(s, d):
    return turns.speaker_stats(conversation_turns(s, d), "neural")


@query("speaker_stats_legacy", _stats_sql("list_reduce(list_prepend(0e0, list(round(e - s, 2) ORDER BY seg)), lambda a, x: round(a + x, 2))"))
def speaker_stats_legacy(s, d):
    return turns.speaker_stats(conversation_turns(s, d), "legacy")


@query("wire_segments", _with(_NAMED, "SELECT rec, seg AS seg_id, spk_id, round(s, 2) AS seg_begin, round(e, 2) AS seg_end FROM named"))
def wire_segments(s, d):
    return turns.wire_segments(conversation_turns(s, d), 2).withColumn("seg_id", F.col("seg_id").cast("long"))


@query("wire_segments_neural", _with(_NAMED, "SELECT rec, seg AS seg_id, spk_id, round(s, 3) AS seg_begin, round(e, 3) AS seg_end FROM named"))
def wire_segments_neural(s, d):
    return turns.wire_segments(conversation_turns(s, d), 3).withColumn("seg_id", F.col("seg_id").cast("long"))


@query("json_result", _with(_NAMED, """sp AS (SELECT rec, string_agg('{"spk_id":"' || spk_id || '","duration":' || CAST(dur AS VARCHAR) || ',"nbr_seg":' || n || '}', ',' ORDER BY CAST(substr(spk_id, 4) AS INTEGER)) AS x FROM (SELECT rec, spk_id, round(sum(e - s), 2) AS dur, count(*) AS n FROM named GROUP BY rec, spk_id) GROUP BY rec),
sx AS (SELECT rec, string_agg('{"seg_id":' || seg || ',"spk_id":"' || spk_id || '","seg_begin":' || CAST(round(s, 2) AS VARCHAR) || ',"seg_end":' || CAST(round(e, 2) AS VARCHAR) || '}', ',' ORDER BY seg) AS x FROM named GROUP BY rec)""", """SELECT rec, '{"speakers":[' || sp.x || '],"segments":[' || sx.x || ']}' AS result FROM sp JOIN sx USING (rec)"""))
def json_result(s, d):
    return turns.json_result(conversation_turns(s, d))


@query("rttm_lines", _with(_INTERVALS, "SELECT rec, k, 'SPEAKER ' || rec || ' 0 ' || s || '.000 ' || (e - s) || '.000 <NA> <NA> ' || label || ' <NA> <NA>' AS line FROM iv"))
def rttm_lines(s, d):
    return intervals(s, d).select("rec", "k", results.rttm_line(F.col("rec"), F.col("s").cast("double"), F.col("e").cast("double"), F.col("label")).alias("line"))


# --- signal to segments ----------------------------------------------------------------------


def _lengths(f: DataFrame) -> DataFrame:
    return f.groupBy("rec").agg(((F.max("i") + 1) * 1536).alias("samples"))


def _utt(df: DataFrame) -> DataFrame:
    return df.withColumn("utt", F.col("utt").cast("long"))


@query("vad_hysteresis", _with(_FRAMES, _SPEECH, "SELECT rec, utt, s, e FROM speech"))
def vad_hysteresis(s, d):
    return _utt(vad.hysteresis(frames(s, d)))


@query("vad_hysteresis_scale", _with(_MANY, _SPEECH, "SELECT rec, utt, s, e FROM speech"))
def vad_hysteresis_scale(s, d):
    return _utt(vad.hysteresis(many_frames(s, d)))


@query("vad_online", _with(_FRAMES, _SPEECH, "SELECT rec, s, e FROM speech"))
def vad_online(s, d):
    """The frames as files of a stream, in four parts that are out of order, and a row that moves the clock
    on; what the stream gives is a table of the shared folder."""
    folder = shared.new_folder(s, "vad-online")
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("i") * 96)
    rows = frames(s, d).withColumn("ts", at)
    rows.withColumn("part", F.col("i") % 4).write.partitionBy("part").parquet(f"{folder}/in")
    clock = s.range(1).select(F.lit(None).cast(rows.schema["rec"].dataType).alias("rec"), F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("p"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts"), F.lit(4).alias("part"))
    clock.write.mode("append").partitionBy("part").parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).parquet(f"{folder}/in")
    found = speech.run_once(speech.online_vad(stream, late="3650 days"), folder, "speech")
    shared.delete(s, f"{folder}/in")
    return found


@query("vad_padding", _with(_FRAMES, _SPEECH, _PADDED, "SELECT rec, utt, s, e FROM padded"))
def vad_padding(s, d):
    f = frames(s, d)
    return _utt(vad.pad(vad.hysteresis(f), _lengths(f)))


_RUNS = "r0 AS (SELECT rec, i, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS isl FROM frames WHERE p >= 0.5), runs AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY min(i)) AS run, min(i) AS first, max(i) AS last FROM r0 GROUP BY rec, isl)"


def _speech_runs(s, d):
    return vad.runs(frames(s, d), F.col("p") >= 0.5).withColumn("run", F.col("run").cast("long"))


@query("mask_runs", _with(_FRAMES, _RUNS, "SELECT rec, run, first, last FROM runs"))
def mask_runs(s, d):
    return _speech_runs(s, d)


@query("speech_index_map", _with(_FRAMES, "SELECT rec, i, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS speech, CASE WHEN p >= 0.5 THEN CAST(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS pos FROM frames"))
def speech_index_map(s, d):
    return vad.speech_index(frames(s, d), F.col("p") >= 0.5)


@query("frame_mask", _with(_FRAMES, _RUNS, "SELECT f.rec, f.i, CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.rec = f.rec AND f.i >= r.first AND f.i < r.last) THEN 1 ELSE 0 END AS speech FROM frames f"))
def frame_mask(s, d):
    return vad.frame_mask(frames(s, d), _speech_runs(s, d))


@query("legacy_segment_table", _with(_FRAMES, _RUNS, "b AS (SELECT rec, run, first, last, unnest(range(first, last, 3)) AS beg FROM runs WHERE last > first)", 'SELECT rec, run, greatest(beg - 2, first) AS bbeg, beg, least(beg + 2, last) AS "end", least(least(beg + 2, last) + 2, last) AS eend FROM b'))
def legacy_segment_table(s, d):
    return framing.segment_table(_speech_runs(s, d), length=3, step=3, context=2)


@query("smooth_shrinking", _with(_FRAMES, "n AS (SELECT rec, i, p, row_number() OVER (PARTITION BY rec ORDER BY i) AS rn, count(*) OVER (PARTITION BY rec) AS n FROM frames)", "SELECT a.rec, a.i, round(avg(b.p), 6) AS p FROM n a JOIN n b ON a.rec = b.rec AND abs(a.rn - b.rn) <= least(3, a.rn - 1, a.n - a.rn) GROUP BY a.rec, a.i"))
def smooth_shrinking(s, d):
    return _r6(vad.smooth(frames(s, d), "p", 7), "p")


@query("frame_chunks", _with(_FRAMES, _LENGTHS, "SELECT rec, unnest(range(0, samples, 1536)) // 1536 AS i, unnest(range(0, samples, 1536)) AS s, unnest(range(0, samples, 1536)) + 1536 AS e FROM lengths"))
def frame_chunks(s, d):
    return framing.frames(_lengths(frames(s, d)))


@query("sliding_windows", _with(_FRAMES, _SPEECH, """u AS (SELECT rec, utt, s, e, CASE WHEN e - s > 24000 THEN (e - s - 24000 - 1) // 12000 + 1 ELSE 0 END AS n FROM speech WHERE e > s),
x AS (SELECT *, unnest(range(0, CAST(n + 1 AS BIGINT))) AS j FROM u)""", """
SELECT rec, utt, row_number() OVER (PARTITION BY rec ORDER BY utt, j) AS k, s + j * 12000 AS s, CASE WHEN j < n THEN s + j * 12000 + 24000 ELSE e - 1 END AS e FROM x"""))
def sliding_windows(s, d):
    return _utt(framing.sliding_windows(vad.hysteresis(frames(s, d)))).withColumn("k", F.col("k").cast("long"))


_JOINED = """j0 AS (SELECT *, lag(e) OVER w AS pe, lag(label) OVER w AS pl FROM iv WINDOW w AS (PARTITION BY rec ORDER BY k)),
j1 AS (SELECT *, CASE WHEN s <= pe AND label = pl THEN 0 ELSE 1 END AS new, CASE WHEN s <= pe AND label <> pl THEN s + CAST(floor((pe - s) / 2.0) AS BIGINT) END AS cut FROM j0),
j2 AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY k ROWS UNBOUNDED PRECEDING) AS isl FROM j1),
j3 AS (SELECT rec, isl, arg_min(s, k) AS fs, arg_max(e, k) AS le, min(label) AS label, max(cut) FILTER (WHERE new = 1) AS cut FROM j2 GROUP BY rec, isl),
joined AS (SELECT rec, CAST(isl AS INTEGER) AS turn, coalesce(cut, fs) AS s, coalesce(lead(cut) OVER (PARTITION BY rec ORDER BY isl), le) AS e, label FROM j3)"""
_MERGED = """m0 AS (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(e) OVER w + 3600 >= s THEN 0 ELSE 1 END AS new FROM joined WINDOW w AS (PARTITION BY rec ORDER BY turn)),
m1 AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isl FROM m0),
merged AS (SELECT rec, CAST(isl AS INTEGER) AS turn, arg_min(s, turn) AS s, arg_max(e, turn) AS e, min(label) AS label FROM m1 GROUP BY rec, isl)"""


@query("join_segments", _with(_INTERVALS, _JOINED, "SELECT rec, turn, s, e, label FROM joined"))
def join_segments(s, d):
    return turns.resolve_overlaps(intervals(s, d))


@query("merge_same_speaker", _with(_INTERVALS, _JOINED, _MERGED, "SELECT rec, turn, s, e, label FROM merged"))
def merge_same_speaker(s, d):
    return turns.merge_same_speaker(turns.resolve_overlaps(intervals(s, d)), 3600)


@query("collar_merge", _with(_INTERVALS, """c0 AS (SELECT *, max(e) OVER (PARTITION BY rec, label ORDER BY s, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
c1 AS (SELECT *, sum(CASE WHEN pe + 7200 >= s THEN 0 ELSE 1 END) OVER (PARTITION BY rec, label ORDER BY s, e, k ROWS UNBOUNDED PRECEDING) AS isl FROM c0)""", "SELECT rec, label, CAST(isl AS INTEGER) AS part, min(s) AS s, max(e) AS e FROM c1 GROUP BY rec, label, isl"))
def collar_merge(s, d):
    return turns.collar_merge(intervals(s, d).withColumnRenamed("k", "seg"), 7200)


@query("frame_labels_to_turns", _with("""fr AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS label FROM events)""", """a AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY rec ORDER BY i) = label THEN 0 ELSE 1 END AS new FROM fr),
b AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT rec, run, min(i) AS first, max(i) AS last, min(label) AS label FROM b GROUP BY rec, run HAVING min(label) <> 0 AND max(i) - min(i) + 1 > 1),
e AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY rec ORDER BY run) = label THEN 0 ELSE 1 END AS new FROM c),
f AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY run ROWS UNBOUNDED PRECEDING) AS isl FROM e)""", "SELECT rec, CAST(isl AS INTEGER) AS turn, min(first) AS first, max(last) - min(first) + 1 AS n, min(label) AS label FROM f GROUP BY rec, isl"))
def frame_labels_to_turns(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(0)
    fr = _table(s, d, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(w) - 1).cast("long").alias("i"), label.alias("label"))
    return turns.frame_labels_to_turns(fr, min_frames=1)


_CLIPS = "cl AS (SELECT rec, label AS spk, k AS seg, s, e, e - s AS n FROM iv)"


@query("select_longest_budget", _with(_INTERVALS, _CLIPS, """o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rec, spk ORDER BY n DESC, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM cl)""", "SELECT rec, spk, seg, CAST(least(n, 100000 - bf) AS BIGINT) AS take FROM o WHERE bf < 100000"))
def select_longest_budget(s, d):
    clips = intervals(s, d).select("rec", F.col("label").alias("spk"), F.col("k").alias("seg"), "s", "e")
    return framing.select_longest(clips, rate=1, seconds=100000).select("rec", "spk", "seg", "take")


@query("concat_budget", _with(_INTERVALS, _CLIPS, """o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rec ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM cl)""", "SELECT rec, seg, CAST(least(n, 150000 - bf) AS BIGINT) AS take FROM o WHERE bf < 150000"))
def concat_budget(s, d):
    clips = intervals(s, d).select("rec", F.col("k").alias("seg"), (F.col("e") - F.col("s")).alias("n"))
    return framing.within_budget(clips, ["rec"], "n", [F.col("seg")], 150000).select("rec", "seg", "take")


# --- vectors and graphs ----------------------------------------------------------------------


@query("cosine_topk", _with(_HITS, "SELECT query, point, rank, round(score, 6) AS score FROM hits"))
def cosine_topk(s, d):
    hits = similarity.top_k(search_queries(s, d), voiceprints(s, d))
    return _r6(hits, "score").withColumn("rank", F.col("rank").cast("long"))


@query("cosine_topk_by_collection", _with(_HITS, "c AS (SELECT *, row_number() OVER (PARTITION BY query, speaker_id ORDER BY round(score, 12) DESC, point) AS r FROM h0)", "SELECT query, speaker_id, point, r AS rank, round(score, 6) AS score FROM c WHERE r <= 3"))
def cosine_topk_by_collection(s, d):
    hits = similarity.top_k(search_queries(s, d), voiceprints(s, d), 3, partition="speaker_id")
    return _r6(hits.withColumnRenamed("part", "speaker_id"), "score").withColumn("rank", F.col("rank").cast("long"))


#: Cells of a few dozen points at these sizes; as the vectors hardly cluster, a recall of 0.9 takes 18 of them.
_IVF = vector_index.IndexConfig(cells=32)


def _ivf(s, d, probes):
    folder = shared.new_folder(s, "vectors")
    vector_index.build(voiceprints(s, d).select("point", "vector"), folder, _IVF)
    found = vector_index.search(search_queries(s, d), folder, 10, probes, _IVF)
    return _r6(found, "score").withColumn("rank", F.col("rank").cast("long"))


@query("ivf_topk")
def ivf_topk(s, d):
    return _ivf(s, d, 20)


@query("ivf_topk_whole", _with(_HITS, "SELECT query, point, rank, round(score, 6) AS score FROM hits"))
def ivf_topk_whole(s, d):
    """All cells probed: the index leaves no point out."""
    return _ivf(s, d, _IVF.cells)


def _cos(s, d):
    return similarity.pairs(windows(s, d))


def _half(s, d):
    return similarity.affinity_half(_cos(s, d))


_MATRIX = "SELECT rec, i, j, round(w, 6) AS w FROM "


@query("affinity_half", _with(_HALF, _MATRIX + "aff"))
def affinity_half(s, d):
    return _r6(_half(s, d), "w")


@query("affinity_minmax", _with(_COS, "x AS (SELECT *, min(c) OVER w AS lo, max(c) OVER w AS hi FROM cos WINDOW w AS (PARTITION BY rec, j))", "SELECT rec, i, j, round(CASE WHEN hi > lo THEN (c - lo) / (hi - lo) ELSE 0 END, 6) AS w FROM x"))
def affinity_minmax(s, d):
    return _r6(similarity.affinity_minmax(_cos(s, d)), "w")


_PG = "k0 AS (SELECT rec, i, j FROM aff QUALIFY row_number() OVER (PARTITION BY rec, i ORDER BY round(w, 12) DESC, j DESC) <= 5), pg AS (SELECT rec, i, j, count(*) * 0.5e0 AS w FROM (SELECT * FROM k0 UNION ALL SELECT rec, j, i FROM k0) GROUP BY ALL)"


@query("p_graph", _with(_HALF, _PG, "SELECT rec, i, j, w FROM pg"))
def p_graph(s, d):
    return similarity.p_graph(_half(s, d), 5)


@query("laplacian", _with(_HALF, _PG, "SELECT rec, i, j, -w AS w FROM pg WHERE i <> j UNION ALL SELECT rec, i, i, sum(abs(w)) FROM pg WHERE i <> j GROUP BY rec, i"))
def laplacian(s, d):
    return similarity.laplacian(similarity.p_graph(_half(s, d), 5))


_REACH = "reach AS (SELECT DISTINCT rec, i, i AS j FROM pg UNION SELECT r.rec, r.i, pg.j FROM reach r JOIN pg ON pg.rec = r.rec AND pg.i = r.j)"


@query("graph_components", "WITH RECURSIVE " + ",\n".join([_HALF, _PG.replace("<= 5", "<= 2"), _REACH]) + "\nSELECT rec, i, min(j) AS component FROM reach GROUP BY rec, i")
def graph_components(s, d):
    return graphs.components(windows(s, d).select("rec", F.col("k").alias("i")), similarity.p_graph(_half(s, d), 2))


@query("least_connecting", "WITH RECURSIVE " + ",\n".join([
    _HALF, "rk AS (SELECT rec, i, j, row_number() OVER (PARTITION BY rec, i ORDER BY round(w, 12) DESC, j DESC) AS r FROM aff)",
    "ed AS (SELECT rec, i, j, r FROM rk UNION ALL SELECT rec, j, i, r FROM rk)",
    "reach AS (SELECT rec, p, min(i) AS j FROM (SELECT rec, i, unnest(range(1, 51)) AS p FROM aff) GROUP BY rec, p UNION SELECT q.rec, q.p, ed.j FROM reach q JOIN ed ON ed.rec = q.rec AND ed.i = q.j AND ed.r <= q.p)",
]) + "\nSELECT rec, CAST(min(p) AS INTEGER) AS p FROM (SELECT rec, p, count(*) AS n FROM reach GROUP BY rec, p) JOIN (SELECT rec, count(DISTINCT i) AS m FROM aff GROUP BY rec) USING (rec) WHERE n = m GROUP BY rec")
def least_connecting(s, d):
    return graphs.least_connecting(_half(s, d))


# vectors as chunks of 16 frames of four local speakers, a new one every four frames
_ACTS = """act AS (SELECT vec_id // 50 AS rec, CAST(vec_id % 50 AS INTEGER) AS chunk, (generate_subscripts(embedding, 1) - 1) // 4 AS pos, CAST((generate_subscripts(embedding, 1) - 1) % 4 AS INTEGER) AS i, unnest(list_transform(embedding, lambda x: least(1e0, abs(CAST(x AS DOUBLE)) * 4))) AS a FROM embeddings)"""
_LINKS = """sa AS (SELECT rec, chunk, i, sum(a) AS t FROM act WHERE pos >= 4 AND (rec, chunk + 1) IN (SELECT (rec, chunk) FROM act) GROUP BY rec, chunk, i),
sb AS (SELECT rec, chunk - 1 AS chunk, i AS j, sum(a) AS t FROM act WHERE pos < 12 GROUP BY rec, chunk, i),
dt AS (SELECT x.rec, x.chunk, x.i, y.i AS j, sum(x.a * y.a) AS t FROM act x JOIN act y ON y.rec = x.rec AND y.chunk = x.chunk + 1 AND x.pos = y.pos + 4 GROUP BY ALL),
sh AS (SELECT dt.rec, dt.chunk, i, j, dt.t / greatest(sa.t, sb.t, 1e-12) AS share FROM dt JOIN sa USING (rec, chunk, i) JOIN sb USING (rec, chunk, j)),
pm AS (SELECT a.x * 1000 + b.x * 100 + c.x * 10 + d.x AS id, [a.x, b.x, c.x, d.x] AS js FROM (SELECT unnest(range(4)) AS x) a, (SELECT unnest(range(4)) AS x) b, (SELECT unnest(range(4)) AS x) c, (SELECT unnest(range(4)) AS x) d WHERE len(list_distinct([a.x, b.x, c.x, d.x])) = 4),
tt AS (SELECT rec, chunk, id, js, sum(share) AS total FROM sh JOIN pm ON js[i + 1] = j GROUP BY ALL),
bp AS (SELECT rec, chunk, js FROM tt QUALIFY row_number() OVER (PARTITION BY rec, chunk ORDER BY round(total, 12) DESC, id) = 1),
lk AS (SELECT sh.rec, sh.chunk, i, j, share FROM sh JOIN bp ON bp.rec = sh.rec AND bp.chunk = sh.chunk AND js[i + 1] = j WHERE share >= 0.35)"""
_TRACKS = """nd AS (SELECT DISTINCT rec, chunk * 64 + i AS n FROM act),
eg AS (SELECT rec, chunk * 64 + i AS a, (chunk + 1) * 64 + j AS b FROM lk UNION ALL SELECT rec, (chunk + 1) * 64 + j, chunk * 64 + i FROM lk),
rh AS (SELECT rec, n, n AS m FROM nd UNION SELECT rh.rec, rh.n, eg.b FROM rh JOIN eg ON eg.rec = rh.rec AND eg.a = rh.m),
tk AS (SELECT rec, n // 64 AS chunk, n % 64 AS i, min(m) AS track FROM rh GROUP BY rec, n),
wt AS (SELECT act.*, chunk * 4 + pos AS f, (1e0 + least(pos, 15 - pos)) / 16 AS w FROM act),
wh AS (SELECT rec, f, sum(w) AS whole FROM (SELECT DISTINCT rec, chunk, f, w FROM wt) GROUP BY rec, f),
ow AS (SELECT rec, track, f, sum(wa) AS wa FROM (SELECT rec, track, f, chunk, max(w * a) AS wa FROM wt JOIN tk USING (rec, chunk, i) GROUP BY ALL) GROUP BY rec, track, f),
oa AS (SELECT rec, track, f, wa / whole AS p FROM ow JOIN wh USING (rec, f))"""


def _acts(s, d):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.lit(1.0), F.abs(x) * 4))
    frames_ = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice(v, k * 4 + 1, 4))
    return windows(s, d).select("rec", F.col("k").alias("chunk"), (F.col("k") * 4).cast("long").alias("start"), frames_.alias("act"))


@query("speaker_links", _with(_ACTS, _LINKS, "SELECT rec, chunk, i, CAST(j AS INTEGER) AS j, round(share, 6) AS agreement FROM lk"))
def speaker_links(s, d):
    return _r6(stitching.links(_acts(s, d), 0.35), "agreement")


@query("overlap_add", "WITH RECURSIVE " + ",\n".join([_ACTS, _LINKS, _TRACKS]) + "\nSELECT rec, track, f, round(p, 6) AS p FROM oa")
def overlap_add(s, d):
    act = _acts(s, d)
    return _r6(stitching.overlap_add(act, stitching.tracks(act, stitching.links(act, 0.35))), "p")


@query("overlapping_turns", "WITH RECURSIVE " + ",\n".join([_ACTS, _LINKS, _TRACKS, "rn AS (SELECT rec, track, f, f - row_number() OVER (PARTITION BY rec, track ORDER BY f) AS isl FROM oa WHERE round(p, 9) >= 0.4), sp AS (SELECT rec, 'track' || track AS label, round(min(f) * 0.01, 6) AS s, round((max(f) + 1) * 0.01, 6) AS e FROM rn GROUP BY rec, track, isl)"]) + "\nSELECT rec, label, s, e FROM sp")
def overlapping_turns(s, d):
    act = _acts(s, d)
    scores = stitching.overlap_add(act, stitching.tracks(act, stitching.links(act, 0.35)))
    return _r6(stitching.overlapping_turns(scores, stitching.StitchConfig(onset=0.4)).select("rec", "label", "s", "e"), "s", "e")


_FILLED = "fd AS (SELECT rec, i, j, CASE WHEN i = j THEN greatest(coalesce(max(CASE WHEN i <> j THEN w END) OVER (PARTITION BY rec, i), 0), 0) ELSE w END AS w FROM aff)"


@query("fill_diagonal", _with(_HALF, _FILLED, _MATRIX + "fd"))
def fill_diagonal(s, d):
    return _r6(similarity.fill_diagonal(_half(s, d)), "w")


_THRESHOLDED = "th AS (SELECT rec, i, j, CASE WHEN w < lim THEN w * 0.01e0 ELSE w END AS w FROM fd JOIN (SELECT rec, i, quantile_cont(w, 0.95) AS lim FROM fd GROUP BY rec, i) USING (rec, i))"


@query("row_threshold", _with(_HALF, _FILLED, _THRESHOLDED, _MATRIX + "th"))
def row_threshold(s, d):
    return _r6(similarity.row_threshold(similarity.fill_diagonal(_half(s, d))), "w")


_SYM = "sy AS (SELECT a.rec, a.i, a.j, greatest(a.w, b.w) AS w FROM th a JOIN th b ON a.rec = b.rec AND a.i = b.j AND a.j = b.i)"


@query("symmetrize", _with(_HALF, _FILLED, _THRESHOLDED, _SYM, _MATRIX + "sy"))
def symmetrize(s, d):
    return _r6(similarity.symmetrize(similarity.row_threshold(similarity.fill_diagonal(_half(s, d)))), "w")


_DIFF = "df AS (SELECT a.rec, a.i, b.i AS j, sum(a.w * b.w) AS w FROM sy a JOIN sy b ON a.rec = b.rec AND a.j = b.j GROUP BY a.rec, a.i, b.i)"


@query("diffusion", _with(_HALF, _FILLED, _THRESHOLDED, _SYM, _DIFF, _MATRIX + "df"))
def diffusion(s, d):
    return _r6(similarity.diffuse(similarity.symmetrize(similarity.row_threshold(similarity.fill_diagonal(_half(s, d))))), "w")


_NORM = "nr AS (SELECT rec, df.i, df.j, df.w / m AS w FROM df JOIN (SELECT rec, i AS j, max(w) AS m FROM df GROUP BY rec, i) USING (rec, j))"


@query("enhance_affinity", _with(_HALF, _FILLED, _THRESHOLDED, _SYM, _DIFF, _NORM, _MATRIX + "nr"))
def enhance_affinity(s, d):
    return _r6(similarity.enhance(_half(s, d)), "w")


@query("row_max_norm", _with(_HALF, "SELECT rec, aff.i, aff.j, round(aff.w / m, 6) AS w FROM aff JOIN (SELECT rec, i AS j, max(w) AS m FROM aff GROUP BY rec, i) USING (rec, j)"))
def row_max_norm(s, d):
    return _r6(similarity.row_max_norm(_half(s, d)), "w")


@query("p_prune", _with(_HALF, "SELECT rec, i, j, round(CASE WHEN row_number() OVER (PARTITION BY rec, i ORDER BY round(w, 12), j) <= floor(count(*) OVER (PARTITION BY rec, i) * (1 - 0.25e0)) THEN 0 ELSE w END, 6) AS w FROM aff"))
def p_prune(s, d):
    return _r6(similarity.prune(_half(s, d), 0.25), "w")


def _scales(s, d):
    iv = intervals(s, d).select("rec", F.col("k").alias("idx"), "s", "e")
    w = Window.partitionBy("rec").orderBy("idx")
    coarse = iv.select("rec", "s", "e", "idx", F.floor((F.row_number().over(w) - 1) / 3).alias("g")).groupBy("rec", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return iv, coarse.select("rec", F.col("g").alias("idx"), "s", "e")


_SCALES = "base AS (SELECT rec, k AS idx, s, e FROM iv), coarse AS (SELECT rec, (k - 1) // 3 AS idx, min(s) AS s, max(e) AS e FROM iv GROUP BY rec, (k - 1) // 3), near AS (SELECT b.rec, b.idx, c.idx AS other FROM base b JOIN coarse c USING (rec) QUALIFY row_number() OVER (PARTITION BY b.rec, b.idx ORDER BY abs((b.s + b.e) / 2.0 - (c.s + c.e) / 2.0), c.idx) = 1)"


@query("nearest_midpoint", _with(_INTERVALS, _SCALES, "SELECT rec, idx, other FROM near"))
def nearest_midpoint(s, d):
    return similarity.nearest_midpoint(*_scales(s, d))


@query("repeat_counts", _with(_INTERVALS, _SCALES, "SELECT c.rec, c.idx, count(n.idx) AS n FROM coarse c LEFT JOIN near n ON n.rec = c.rec AND n.other = c.idx GROUP BY c.rec, c.idx"))
def repeat_counts(s, d):
    base, coarse = _scales(s, d)
    return similarity.repeat_counts(similarity.nearest_midpoint(base, coarse), coarse)


_COARSE = """cv AS (SELECT rec, k // 2 AS k, d, avg(x) AS x FROM (SELECT rec, k, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM win) GROUP BY ALL),
cw AS (SELECT rec, k, list(x ORDER BY d) AS v FROM cv GROUP BY rec, k),
c2 AS (SELECT a.rec, a.k AS i, b.k AS j, (list_cosine_similarity(a.v, b.v) + 1) / 2 AS w FROM cw a JOIN cw b USING (rec))"""


@query("multiscale_fusion", _with(_HALF, _COARSE, "SELECT a.rec, a.i, a.j, round((2e0 * a.w + 1e0 * b.w) / 3e0, 6) AS w FROM aff a JOIN c2 b ON a.rec = b.rec AND a.i // 2 = b.i AND a.j // 2 = b.j"))
def multiscale_fusion(s, d):
    """The coarse scale's windows are the means of two neighbouring ones each, over all windows."""
    w = windows(s, d)
    half = F.floor(F.col("k") / 2).cast("int")
    each = w.select("rec", half.alias("k"), F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    means = each.groupBy("rec", "k", "d").agg(F.avg("x").alias("x")).groupBy("rec", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda y: y.x).alias("embedding"))
    coarse = similarity.affinity_half(similarity.pairs(means))
    fine = w.select("rec", F.col("k").alias("idx"), F.col("k").alias("other"))
    return _r6(similarity.fuse_scales([(_half(s, d), fine, 2.0), (coarse, w.select("rec", F.col("k").alias("idx"), half.alias("other")), 1.0)]), "w")


_EIG = "ev AS (SELECT vec_id AS rec, unnest(list_sort(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)))) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)"


@query("eigengap_count", _with(_EIG, "g AS (SELECT rec, k, lead(v) OVER (PARTITION BY rec ORDER BY k) - v AS gap FROM ev)", "SELECT rec, CAST(k AS INTEGER) AS speakers FROM g WHERE gap IS NOT NULL AND k <= 25 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(gap, 12) DESC, k) = 1"))
def eigengap_count(s, d):
    v = F.sort_array(F.transform(F.col("embedding").cast("array<double>"), F.abs))
    ev = _table(s, d, "embeddings").select(F.col("vec_id").alias("rec"), F.posexplode(v).alias("k", "v")).withColumn("k", F.col("k") + 1)
    return similarity.eigengap_count(ev)


@query("eigenratio_count", _with(_EIG, """dv AS (SELECT rec, 65 - k AS k, v FROM ev),
r AS (SELECT rec, k - 1 AS k, lag(v) OVER w / v AS ratio, lag(v) OVER w AS pv FROM dv WINDOW w AS (PARTITION BY rec ORDER BY k)),
b AS (SELECT rec, k FROM r WHERE pv >= 1e-2 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(ratio, 12) DESC, k) = 1)""", "SELECT x.rec, CAST(coalesce(b.k, 1) AS INTEGER) AS speakers FROM (SELECT DISTINCT rec FROM ev) x LEFT JOIN b USING (rec)"))
def eigenratio_count(s, d):
    v = F.sort_array(F.transform(F.col("embedding").cast("array<double>"), F.abs), asc=False)
    ev = _table(s, d, "embeddings").select(F.col("vec_id").alias("rec"), F.posexplode(v).alias("k", "v")).withColumn("k", F.col("k") + 1)
    return similarity.eigenratio_count(ev)


# --- binary keys -----------------------------------------------------------------------------


def _features(s, d):
    return windows(s, d).select("rec", F.col("k").alias("i"), F.col("embedding").cast("array<double>").alias("x"))


_FEAT = "feat AS (SELECT vec_id // 50 AS rec, CAST(vec_id % 50 AS INTEGER) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)"
_POOL = """n0 AS (SELECT rec, max(i) + 1 AS n FROM feat GROUP BY rec),
pool AS (SELECT rec, g, d, avg(x) AS mu, stddev_pop(x) AS sd FROM (SELECT feat.rec, d, x, unnest(range(CAST(greatest(ceil((i - 10 + 1) / 4.0), 0) AS BIGINT), CAST(least(i // 4, (n - 10) // 4) AS BIGINT) + 1)) AS g FROM feat JOIN n0 ON n0.rec = feat.rec) GROUP BY rec, g, d)"""
_LL = "ll AS (SELECT f.rec, f.i, p.g, sum(-0.5e0 * (ln(2 * pi() * sd) + (x - mu) ** 2 / sd)) AS ll FROM feat f JOIN pool p USING (rec, d) WHERE sd > 0 GROUP BY f.rec, f.i, p.g)"
_TOP = "top AS (SELECT rec, i, g, row_number() OVER (PARTITION BY rec, i ORDER BY round(ll, 9) DESC, g) AS r FROM ll QUALIFY r <= 5)"


@query("kbm_pool_stats", _with(_FEAT, _POOL, "SELECT rec, g, CAST(d AS INTEGER) AS d, round(mu, 6) AS mu, round(sd, 6) AS sd FROM pool"))
def kbm_pool_stats(s, d):
    pool = binary_keys.pool(_features(s, d), 10, 4)
    return _r6(pool.select("rec", "g", F.posexplode(F.arrays_zip("mu", "sd")).alias("d", "x")).select("rec", "g", "d", "x.mu", "x.sd"), "mu", "sd")


@query("top_gaussians", _with(_FEAT, _POOL, _LL, _TOP, "SELECT rec, i, g, r FROM top"))
def top_gaussians(s, d):
    f = _features(s, d)
    return binary_keys.top_gaussians(f, binary_keys.pool(f, 10, 4)).withColumn("r", F.col("r").cast("long"))


@query("binary_keys", _with(_FEAT, _POOL, _LL, _TOP, """sg AS (SELECT rec, unnest(range(0, max(i), 10)) // 10 AS seg, max(i) AS m FROM feat GROUP BY rec),
h AS (SELECT sg.rec, seg, g, count(*) AS n FROM sg JOIN top ON top.rec = sg.rec AND i BETWEEN seg * 10 AND seg * 10 + 14 GROUP BY sg.rec, seg, g)""", "SELECT rec, seg, g, round(n / sum(n) OVER (PARTITION BY rec, seg), 6) AS cv, row_number() OVER (PARTITION BY rec, seg ORDER BY n DESC, g) <= 2 AS bit FROM h"))
def binary_key_vectors(s, d):
    f = _features(s, d)
    top = binary_keys.top_gaussians(f, binary_keys.pool(f, 10, 4))
    seg = f.groupBy("rec").agg(F.max("i").alias("m")).where("m > 0").select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / 10))).alias("seg"))
    return _r6(binary_keys.keys(seg.select("rec", "seg", (F.col("seg") * 10).alias("bbeg"), (F.col("seg") * 10 + 14).alias("eend")), top, 10, bin_frames=10), "cv")


# --- identification --------------------------------------------------------------------------


def _hits(s, d):
    points = voiceprints(s, d)
    found = similarity.top_k(search_queries(s, d), points).join(points.select("point", "speaker_id", "name"), "point")
    return found.withColumn("ord", F.col("rank"))


def _vote_sql(extra: str = "") -> str:
    return _with(_HITS, f"""v AS (SELECT query, speaker_id, sum(score) AS votes, min(rank) AS f, arg_max(name, score) AS name FROM hits WHERE score >= 0.2 {extra} GROUP BY query, speaker_id)""", "SELECT query, speaker_id, name, round(votes, 6) AS votes FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(votes, 12) DESC, f) = 1")


@query("vote_aggregate", _vote_sql())
def vote_aggregate(s, d):
    return _r6(identify.votes(_hits(s, d), 0.2), "votes")


@query("allow_list", _vote_sql("AND speaker_id IN (SELECT 'label:' || n_nationkey FROM nation WHERE n_regionkey <> 1)"))
def allow_list(s, d):
    allowed = _table(s, d, "nation").where("n_regionkey <> 1").select(F.concat(F.lit("label:"), F.col("n_nationkey").cast("string")).alias("speaker_id"))
    return _r6(identify.votes(_hits(s, d), 0.2, allowed=allowed), "votes")


@query("exclude_list", _vote_sql("AND speaker_id NOT IN (SELECT 'label:' || r_regionkey FROM region)"))
def exclude_list(s, d):
    out = _table(s, d, "region").select(F.concat(F.lit("label:"), F.col("r_regionkey").cast("string")).alias("speaker_id"))
    return _r6(identify.votes(_hits(s, d), 0.2, excluded=out), "votes")


def _tag_names(s, d):
    """Names and a score for the event types that a user has twice or more."""
    iv = intervals(s, d).groupBy("rec", F.col("label").alias("spk")).agg((F.count(F.lit(1)) / 100.0).alias("score")).where("score >= 0.02")
    return iv.withColumn("name", F.when(F.col("spk").isin("click", "view"), "Ann").otherwise(F.concat(F.lit("Name "), "spk")))


_TAGS = "nm AS (SELECT rec, label AS spk, count(*) / 1e2 AS score, CASE WHEN label IN ('click', 'view') THEN 'Ann' ELSE 'Name ' || label END AS name FROM iv GROUP BY rec, label HAVING count(*) >= 2)"


@query("identify_map", _with(_INTERVALS, _TAGS, "SELECT iv.rec, iv.k AS seg, iv.label AS spk, coalesce(name, iv.label) AS who FROM iv LEFT JOIN nm ON nm.rec = iv.rec AND nm.spk = iv.label"))
def identify_map(s, d):
    seg = intervals(s, d).select("rec", F.col("label").alias("spk"), F.col("k").alias("seg"))
    return identify.map_names(seg, _tag_names(s, d)).select("rec", "seg", "spk", "who")


@query("identified_stats", _with(_INTERVALS, _TAGS, """tg AS (SELECT iv.rec, iv.label AS spk, coalesce(name, iv.label) AS who, sum(e - s) AS total, min(k) AS f, count(*) AS n, any_value(score) AS score FROM iv LEFT JOIN nm ON nm.rec = iv.rec AND nm.spk = iv.label GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY rec, who ORDER BY total, f DESC) AS r FROM tg)""", "SELECT rec, who, round(CAST(sum(total) AS DOUBLE), 3) AS duration, CAST(sum(n) AS BIGINT) AS nbr_seg, round(max(CASE WHEN r = 1 THEN score END), 3) AS spk_id_score FROM o GROUP BY rec, who"))
def identified_stats(s, d):
    seg = intervals(s, d).select("rec", F.col("label").alias("spk"), F.col("k").alias("seg"), F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"))
    return identify.stats_by_name(seg, _tag_names(s, d))


@query("greedy_exclusive_identify", "WITH RECURSIVE " + _HITS + """,
tg AS (SELECT query // 500 AS rec, query AS spk, row_number() OVER (PARTITION BY query // 500 ORDER BY (query * 7) % 450 DESC, query) AS n FROM q WHERE query IN (SELECT query FROM hits)),
v AS (SELECT tg.rec, tg.n, tg.spk, speaker_id, sum(score) AS votes, min(rank) AS f, arg_min(name, rank) AS name FROM tg JOIN hits ON hits.query = tg.spk WHERE score >= 0.2 GROUP BY ALL),
w AS (SELECT rec, 0 AS n, CAST(NULL AS BIGINT) AS spk, CAST(NULL AS VARCHAR) AS speaker_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS votes, CAST([] AS VARCHAR[]) AS taken FROM tg GROUP BY rec
  UNION ALL SELECT * FROM (SELECT w.rec, w.n + 1 AS n, tg.spk, v.speaker_id, v.name, v.votes, CASE WHEN v.speaker_id IS NULL THEN w.taken ELSE list_append(w.taken, v.speaker_id) END AS taken
    FROM w JOIN tg ON tg.rec = w.rec AND tg.n = w.n + 1 LEFT JOIN v ON v.rec = w.rec AND v.n = w.n + 1 AND NOT list_contains(w.taken, v.speaker_id)
    QUALIFY row_number() OVER (PARTITION BY w.rec ORDER BY round(v.votes, 12) DESC NULLS LAST, v.f) = 1))
SELECT rec, CAST(spk AS VARCHAR) AS spk, speaker_id, name, round(votes, 6) AS votes FROM w WHERE speaker_id IS NOT NULL""")
def greedy_exclusive_identify(s, d):
    hits = _hits(s, d)
    rec = F.floor(F.col("query") / 500)
    named = hits.select(rec.alias("rec"), F.col("query").cast("string").alias("spk"), "ord", "score", "speaker_id", "name")
    # speech times that don't follow the order of first appearance
    spk = F.col("spk").cast("long")
    tags = named.select("rec", "spk").distinct().withColumn("total", F.pmod(spk * 7, F.lit(450)).cast("double")).withColumn("first", spk)
    return _r6(identify.identify_exclusive(tags, named, 0.2), "votes")


@query("identification_accuracy", _with(_HITS, """v AS (SELECT query, speaker_id, sum(score) AS votes, min(rank) AS f FROM hits WHERE score >= 0.2 GROUP BY query, speaker_id),
w AS (SELECT query, speaker_id FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(votes, 12) DESC, f) = 1)""", "SELECT round(avg(CASE WHEN w.speaker_id = pt.speaker_id THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM q JOIN pt ON pt.point = q.query LEFT JOIN w ON w.query = q.query"))
def identification_accuracy(s, d):
    truth = voiceprints(s, d).select(F.col("point").alias("query"), "speaker_id").join(search_queries(s, d).select("query"), "query")
    return identify.accuracy(truth, identify.votes(_hits(s, d), 0.2)).select(F.round("accuracy", 6).alias("accuracy"))


@query("transcript_align", _with("""w0 AS (SELECT conv_id AS rec, turn, role, text, unnest(string_split(coalesce(text, ''), ' ')) AS word, generate_subscripts(string_split(coalesce(text, ''), ' '), 1) AS p FROM conversations),
w AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY turn, role, text, p) - 1 AS n, word FROM w0),
sg AS (SELECT conv_id AS rec, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seg, sum(length(coalesce(text, '')) // 4 + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM conversations),
c AS (SELECT sg.rec, seg, greatest((SELECT count(*) FROM w WHERE w.rec = sg.rec AND (n + 1) * 2 < sg.e) - 1, 0) AS cut FROM sg),
b AS (SELECT rec, seg, coalesce(lag(cut) OVER x, 0) AS lo, CASE WHEN lead(seg) OVER x IS NULL THEN 1099511627776 ELSE cut END AS hi FROM c WINDOW x AS (PARTITION BY rec ORDER BY seg))""", "SELECT b.rec, b.seg, coalesce(string_agg(w.word, ' ' ORDER BY n), '') AS text FROM b LEFT JOIN w ON w.rec = b.rec AND n >= lo AND n < hi GROUP BY b.rec, b.seg"))
def transcript_align(s, d):
    # equal rows of a conversation give their words in turns: each first word, then each second
    w = Window.partitionBy("conv_id").orderBy(*(F.col(k).asc_nulls_last() for k in ("turn", "role", "text")))
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    said = F.coalesce("text", F.lit(""))
    size = F.length(said) - F.length(F.replace(said, F.lit(" "))) + 1
    c = _table(s, d, "conversations").select(
        F.col("conv_id").alias("rec"), said.alias("text"), size.cast("long").alias("size"), F.row_number().over(w).alias("seg"),
        F.sum(F.floor(F.length(said) / 4) + 1).over(before).cast("double").alias("e"), F.sum(size).over(before).alias("upto"),
        (F.row_number().over(w) - F.rank().over(w)).cast("long").alias("i"), F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)).alias("equal"),
    )
    n = F.col("upto") - (F.col("i") + 1) * F.col("size")
    words = F.split("text", " ")
    one = F.array(F.struct(n.alias("n"), words.alias("texts")))
    each = F.transform(words, lambda x, p: F.struct((n + p * F.col("equal") + F.col("i")).alias("n"), F.array(x).alias("texts")))
    runs = c.select("rec", F.inline(F.when(F.col("equal") == 1, one).otherwise(each)))
    ends = F.transform("texts", lambda _, p: ((F.col("n") + p + 1) * 2).cast("double"))
    return turns.transcript_of_runs(c.select("rec", "seg", "e"), runs.select("rec", "n", ends.alias("ends"), "texts")).withColumn("seg", F.col("seg").cast("long"))


# --- names, requests, store ------------------------------------------------------------------

_HEX = "substr(md5(CAST(c_custkey AS VARCHAR)), 1, 24)"
_NAMES = f"nm AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'spkid_' || upper({_HEX}) || '_' || {_HEX} WHEN 2 THEN 'other_' || {_HEX} ELSE 'spkid_' || {_HEX} || '_' || reverse({_HEX}) END AS name FROM customer)"


def _collection_names(s, d):
    h = F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 24)
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.lit("spkid_"), F.upper(h), F.lit("_"), h)).when(k == 2, F.concat(F.lit("other_"), h)).otherwise(F.concat(F.lit("spkid_"), h, F.lit("_"), F.reverse(h)))
    return _table(s, d, "customer").select("c_custkey", name.alias("name"))


@query("collection_parse", _with(_NAMES, "SELECT c_custkey, CASE WHEN regexp_full_match(coalesce(name, ''), 'spkid_[0-9a-f]{24}_[0-9a-f]{24}') THEN substr(name, 7, 24) END AS organization_id, CASE WHEN regexp_full_match(coalesce(name, ''), 'spkid_[0-9a-f]{24}_[0-9a-f]{24}') THEN substr(name, 32, 24) END AS studio_collection_id, regexp_full_match(coalesce(name, ''), 'spkid_[0-9a-f]{24}_[0-9a-f]{24}') AS valid FROM nm"))
def collection_parse(s, d):
    return _collection_names(s, d).select("c_custkey", ids.parse_collection(F.col("name")).alias("x")).select("c_custkey", "x.*")


@query("point_uuid5", """WITH h AS (SELECT c_custkey, sha1(unhex('b8a9cf6e0000400080005370656b4944') || encode('user:' || c_name)) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(strpos('0123456789abcdef', substr(h, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_uuid5(s, d):
    return _table(s, d, "customer").select("c_custkey", ids.speaker_point_id(F.concat(F.lit("user:"), F.col("c_name"))).alias("point_id"))


@query("payload_coalesce", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'P' || c_custkey WHEN c_custkey % 3 = 1 THEN c_name END AS name FROM customer")
def payload_coalesce(s, d):
    k = F.col("c_custkey") % 3
    return _table(s, d, "customer").select("c_custkey", ids.payload_name(F.when(k == 0, "").when(k == 1, F.col("c_name")), F.when(k == 0, F.concat(F.lit("P"), F.col("c_custkey").cast("string")))).alias("name"))


@query("resolve_collections", """WITH ex AS (SELECT DISTINCT c_nationkey AS collection FROM customer WHERE c_nationkey <> 3),
md AS (SELECT c_nationkey AS collection, arg_min(c_mktsegment, c_custkey) AS model_id FROM customer WHERE c_nationkey NOT IN (1, 5, 9) GROUP BY ALL)
SELECT n_nationkey AS collection, n_regionkey AS pos FROM nation JOIN ex ON ex.collection = n_nationkey LEFT JOIN md ON md.collection = n_nationkey WHERE model_id IS NULL OR model_id = 'BUILDING'""")
def resolve_collections(s, d):
    c = _table(s, d, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_mktsegment").alias("model_id"), F.col("c_custkey").alias("point_id"))
    asked = _table(s, d, "nation").select(F.col("n_nationkey").alias("collection"), F.col("n_regionkey").alias("pos"))
    return store.usable(asked, c.where("collection <> 3"), store.model_ids(c.where("collection not in (1, 5, 9)")), "BUILDING")


@query("threshold_resolution", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10) / 1e1 END, 0.3) AS min_similarity FROM orders")
def threshold_resolution(s, d):
    given = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 10) / 10.0)
    return _table(s, d, "orders").select("o_orderkey", identify.resolve_threshold(given, "0.3").alias("min_similarity"))


@query("request_normalise", "SELECT o_orderkey, CAST(coalesce(nullif(o_orderkey % 4, 0), -1) AS INTEGER) AS speaker_count, CAST(CASE WHEN o_orderkey % 4 = 0 THEN coalesce(nullif(o_orderkey % 3, 0), 50) ELSE -1 END AS INTEGER) AS max_speaker FROM orders")
def request_normalise(s, d):
    k = F.col("o_orderkey")
    jobs = requests.normalise_counts(_table(s, d, "orders").select("o_orderkey", (k % 4).cast("int").alias("speaker_count"), (k % 3).cast("int").alias("max_speaker")), 50)
    return jobs.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("speaker_count", "max_speaker")})


@query("spec_validate", """WITH sp AS (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders)
SELECT o_orderkey, k IN (0, 1, 2) AS valid, CASE k WHEN 2 THEN 0.25e0 END AS min_similarity FROM sp""")
def spec_validate(s, d):
    name = "spkid_" + "a1" * 12 + "_" + "b2" * 12
    forms = [
        f'{{"collections": ["{name}"]}}',
        f'{{"collections": ["{name}"], "speakers": "*"}}',
        f'{{"collections": ["{name}"], "speakers": ["x", "y"], "minSimilarity": 0.25}}',
        '{"collections": []}',
        f'{{"collections": ["{name}"], "other": 1}}',
        f'{{"collections": ["{name}"], "minSimilarity": 1.5}}',
        f'{{"collections": ["{name}"], "minSimilarity": true}}',
        '{"collections": ["spkid_1_2"]}',
    ]
    spec = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return requests.check_specs(_table(s, d, "orders").select("o_orderkey", spec.alias("spec"))).select("o_orderkey", "valid", "min_similarity")


@query("upsert_latest", """WITH u AS (SELECT o_custkey AS collection, o_orderpriority AS point_id, o_orderdate AS updated_at, o_orderkey AS v, 0 AS n FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_custkey, o_orderpriority, o_orderdate, o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT collection, point_id, updated_at, max(v) AS v FROM (SELECT *, rank() OVER (PARTITION BY collection, point_id ORDER BY updated_at DESC, n DESC) AS r FROM u) WHERE r = 1 GROUP BY ALL""")
def upsert_latest(s, d):
    o = _table(s, d, "orders").groupBy(F.col("o_custkey").alias("collection"), F.col("o_orderpriority").alias("point_id"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderkey") % 3 == 0).alias("new")).agg(F.max("o_orderkey").alias("v"))
    return store.upsert(o.where("not new").drop("new"), o.where("new").drop("new"))


_IDS = "wanted AS (SELECT DISTINCT n_nationkey AS collection, n_nationkey * 7 + r AS point_id FROM nation, (SELECT unnest(range(0, 40)) AS r)), pts AS (SELECT c_nationkey AS collection, c_custkey AS point_id FROM customer)"


def _wanted(s, d):
    return _table(s, d, "nation").select(F.col("n_nationkey").alias("collection"), F.explode(F.sequence((F.col("n_nationkey") * 7).cast("long"), (F.col("n_nationkey") * 7 + 39).cast("long"))).alias("point_id"))


@query("delete_points", _with(_IDS, "SELECT collection, point_id FROM pts ANTI JOIN wanted USING (collection, point_id)"))
def delete_points(s, d):
    pts = _table(s, d, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_custkey").alias("point_id"))
    return store.delete(pts, _wanted(s, d))[0]


@query("delete_counts", _with(_IDS, "SELECT w.collection, count(p.point_id) AS deleted FROM wanted w LEFT JOIN pts p USING (collection, point_id) GROUP BY w.collection"))
def delete_counts(s, d):
    pts = _table(s, d, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_custkey").alias("point_id"))
    return store.delete(pts, _wanted(s, d))[1]


@query("ensure_collections", "SELECT n_nationkey AS collection, n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AS created FROM nation")
def ensure_collections(s, d):
    there = _table(s, d, "supplier").select(F.col("s_nationkey").alias("collection")).distinct().withColumns({"dim": F.lit(192), "distance": F.lit("COSINE")})
    return store.ensure(there, _table(s, d, "nation").select(F.col("n_nationkey").alias("collection")))[1]


@query("drop_collections", "SELECT r_regionkey AS collection, r_regionkey IN (SELECT c_nationkey FROM customer) AS existed FROM region")
def drop_collections(s, d):
    return store.drop(_table(s, d, "customer").select(F.col("c_nationkey").alias("collection")), _table(s, d, "region").select(F.col("r_regionkey").alias("collection")))[1]


@query("registry_merge", "SELECT user_id AS host_name, max(epoch_us(ts)) AS last_alive FROM events GROUP BY user_id")
def registry_merge(s, d):
    beats = _table(s, d, "events").select(F.col("user_id").alias("host_name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("last_alive"))
    return store.heartbeat(beats.limit(0), beats)


@query("result_cache_key", "SELECT o_orderkey, md5(md5(o_orderpriority) || '|' || CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE '' END || '|' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '9' END) AS key FROM orders")
def result_cache_key(s, d):
    count = F.when(F.col("o_orderkey") % 2 == 0, 2)
    return _table(s, d, "orders").select("o_orderkey", store.cache_key(F.col("o_orderpriority").cast("binary"), count, F.lit(9)).alias("key"))


@query("enrollment_gate", _with(_INTERVALS, _CLIPS, """o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rec ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM cl WHERE seg % 2 = 1)""", "SELECT rec AS speaker, round(sum(least(n, 200000 - bf)) / 1e3, 3) AS duration_used, count(*) AS files_used, CASE WHEN sum(least(n, 200000 - bf)) < 50000 THEN 'audio_too_short' END AS error FROM o WHERE bf < 200000 GROUP BY rec"))
def enrollment_gate(s, d):
    clips = intervals(s, d).select(F.col("rec").alias("speaker"), F.col("k").alias("pos"), F.when(F.col("k") % 2 == 1, F.col("e") - F.col("s")).alias("samples"))
    return requests.enrollment_audio(clips, rate=1000, most=200, least=50)


# --- clustering: partitions are up to renaming, so there is no SQL ----------------------------


@query("nme_sc_cluster")
def nme_sc_cluster(s, d):
    return clustering.cluster(windows(s, d), "auto_spectral")


@query("spectral_cluster")
def spectral_cluster(s, d):
    return clustering.cluster(windows(s, d), "spectral")


@query("ahc_cluster")
def ahc_cluster(s, d):
    return clustering.cluster(windows(s, d), "agglomerative")


@query("diarize")
def diarize(s, d):
    w = windows(s, d).withColumn("s", F.col("k").cast("long") * 12000).withColumn("e", F.col("s") + 24000)
    return pipelines.diarize(w)


@query("gmm_resegment")
def gmm_resegment(s, d):
    w = windows(s, d)
    f = w.select("rec", F.col("k").alias("i"), F.col("embedding").cast("array<double>").alias("mfcc"))
    return binary_keys.resegment(f, clustering.cluster(w, "agglomerative", 3).withColumnRenamed("k", "i"), window=5)


@query("identify_speakers", _with(_HITS, "v AS (SELECT query, speaker_id, sum(score) AS votes, min(rank) AS f, arg_max(name, score) AS name FROM hits WHERE score >= 0.2 GROUP BY query, speaker_id)", "w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(votes, 12) DESC, f) = 1)", "SELECT q.query, speaker_id, name, round(votes, 6) AS votes FROM q LEFT JOIN w ON w.query = q.query"))
def identify_speakers(s, d):
    return _r6(pipelines.identify_speakers(search_queries(s, d), voiceprints(s, d), 0.2), "votes")


# --- lookups, payloads, reports --------------------------------------------------------------


def _enrolled(s, d):
    return _table(s, d, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_custkey").alias("point_id"), F.col("c_mktsegment").alias("name"))


@query("speaker_names", "SELECT DISTINCT c_nationkey AS collection, c_mktsegment AS name FROM customer WHERE c_mktsegment IS NOT NULL")
def speaker_names(s, d):
    return store.names(_enrolled(s, d))


@query("point_lookup", _with(_IDS, "SELECT w.collection, w.point_id, c_mktsegment AS name FROM wanted w LEFT JOIN customer c ON c_nationkey = w.collection AND c_custkey = w.point_id"))
def point_lookup(s, d):
    return store.lookup(_enrolled(s, d), _wanted(s, d))


@query("point_lookup_by_name", """WITH n AS (SELECT c_nationkey AS collection, c_mktsegment AS name, min(c_custkey) AS p, count(*) AS n FROM customer GROUP BY ALL)
SELECT n_nationkey AS collection, 'BUILDING' AS name, CAST(CASE WHEN n = 1 THEN p END AS VARCHAR) AS point_id, coalesce(n, 0) AS found FROM nation LEFT JOIN n ON n.collection = n_nationkey AND n.name = 'BUILDING'""")
def point_lookup_by_name(s, d):
    return store.lookup_name(_enrolled(s, d), _table(s, d, "nation").select(F.col("n_nationkey").alias("collection"), F.lit("BUILDING").alias("name"))).withColumn("point_id", F.col("point_id").cast("string"))


@query("first_model_id", "SELECT c_nationkey AS collection, arg_min(c_mktsegment, c_custkey) AS model_id FROM customer GROUP BY c_nationkey")
def first_model_id(s, d):
    return store.model_ids(_enrolled(s, d).withColumnRenamed("name", "model_id"))


@query("bulk_enrollment", "SELECT c_nationkey AS collection, c_name AS name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS VARCHAR) AS point_id FROM customer")
def bulk_enrollment(s, d):
    return store.numbered_points(_table(s, d, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_name").alias("name")))


@query("payload_build", _with(_NAMES, "SELECT c_custkey, 'user:' || c_custkey AS speaker_id, CASE WHEN regexp_full_match(coalesce(name, ''), 'spkid_[0-9a-f]{24}_[0-9a-f]{24}') THEN substr(name, 7, 24) END AS organization_id, 'm' AS model_id, '2024-01-01' AS updated_at FROM nm"))
def payload_build(s, d):
    who = F.concat(F.lit("user:"), F.col("c_custkey").cast("string"))
    built = store.payload(F.col("name"), who, F.lit("n"), F.lit("m"), F.lit("2024-01-01"))
    return _collection_names(s, d).select("c_custkey", built.alias("p")).select("c_custkey", "p.speaker_id", "p.organization_id", "p.model_id", "p.updated_at")


@query("service_info", """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{"identification":"true","n":"' || n_nationkey || '"}' ELSE '{"identification":"true"}' END AS info FROM nation""")
def service_info(s, d):
    k = F.col("n_nationkey")
    given = F.when(k % 2 == 0, F.format_string('{"n": %d, "identification": "no"}', k)).otherwise(F.lit("[1, 2]"))
    return _table(s, d, "nation").select("n_nationkey", store.service_info(given, {"identification": "true"}).alias("info"))


@query("unknown_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM events")
def unknown_keys(s, d):
    keys = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("collections"), F.lit("other"))).otherwise(F.array(F.lit("speakers")))
    return _table(s, d, "events").select("event_id", F.size(F.array_except(keys, F.array(F.lit("collections"), F.lit("speakers"), F.lit("minSimilarity")))).alias("n"))


@query("vad_seconds", _with(_FRAMES, _SPEECH, "SELECT rec, utt, round(s / 16e3, 1) AS s, round(e / 16e3, 1) AS e FROM speech"))
def vad_seconds(s, d):
    return _utt(vad.in_seconds(vad.hysteresis(frames(s, d))))


@query("run_seconds", _with(_FRAMES, _RUNS, "SELECT rec, run, round(first / 1e2, 6) AS s, round((last + 1) / 1e2, 6) AS e FROM runs WHERE last > first"))
def run_seconds(s, d):
    return _r6(vad.run_seconds(_speech_runs(s, d), 100.0), "s", "e")


@query("plot_data", _with(_MANY, "SELECT rec, i // 10 AS bucket, min(p) AS low, max(p) AS high FROM frames GROUP BY rec, i // 10"))
def plot_data(s, d):
    return vad.plot_data(many_frames(s, d), "p", 10)


@query("vad_plot", _with(_MANY, "SELECT rec, (i // 25) * 25 * CAST(0.096 AS DOUBLE) AS t, min(p) AS low, max(p) AS high FROM frames GROUP BY rec, i // 25"))
def vad_plot(s, d):
    return vad.probability_plot(many_frames(s, d), 0.096, 25)


@query("wire_segments_cli", _with(_NAMED, "SELECT rec, seg AS seg_id, spk_id, round(s, 0) AS seg_begin, round(e, 0) AS seg_end FROM named"))
def wire_segments_cli(s, d):
    return turns.wire_segments(conversation_turns(s, d), 0).withColumn("seg_id", F.col("seg_id").cast("long"))


@query("speech_order", _with(_INTERVALS, "SELECT rec, label, CAST(sum(e - s) AS BIGINT) AS total, row_number() OVER (PARTITION BY rec ORDER BY sum(e - s) DESC, min(k)) AS pos FROM iv GROUP BY rec, label"))
def speech_order(s, d):
    tags = identify.speech_order(intervals(s, d).select("rec", F.col("label").alias("spk"), F.col("k").alias("seg"), "s", "e"))
    return tags.select("rec", F.col("spk").alias("label"), "total", F.col("pos").cast("long").alias("pos"))


@query("segments_by_tag", _with(_INTERVALS, "SELECT rec, label AS spk, min(k) AS first, string_agg(s || '-' || e, ';' ORDER BY k) AS segments FROM iv GROUP BY rec, label"))
def segments_by_tag(s, d):
    tags = identify.segments_by_tag(intervals(s, d).select("rec", F.col("label").alias("spk"), F.col("k").alias("seg"), "s", "e"))
    return tags.withColumn("segments", F.array_join(F.transform("segments", lambda x: F.array_join(x.cast("array<string>"), "-")), ";"))


@query("votes_by_name", _with(_HITS, """v AS (SELECT query, name, sum(score) AS votes, min(rank) AS f FROM hits WHERE score >= 0.2 GROUP BY query, name)""", "SELECT query, name, round(votes, 6) AS votes FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(votes, 12) DESC, f) = 1"))
def votes_by_name(s, d):
    return _r6(identify.votes_by_name(_hits(s, d), 0.2), "votes")


@query("hits_in_collection_order", _with(_HITS, "c AS (SELECT *, row_number() OVER (PARTITION BY query, speaker_id ORDER BY round(score, 12) DESC, point) AS r FROM h0)", "SELECT query, speaker_id AS collection, point, row_number() OVER (PARTITION BY query ORDER BY length(speaker_id), speaker_id, round(score, 12) DESC, point) AS ord FROM c WHERE r <= 3"))
def hits_in_collection_order(s, d):
    points = voiceprints(s, d)
    hits = similarity.top_k(search_queries(s, d), points, 3, partition="speaker_id").withColumnRenamed("part", "collection")
    asked = points.select(F.col("speaker_id").alias("collection")).distinct()
    asked = asked.withColumn("pos", F.struct(F.length("collection"), "collection"))
    return identify.in_collection_order(hits, asked).select("query", "collection", "point", F.col("ord").cast("long").alias("ord"))


@query("key_jaccard", "WITH k AS (SELECT vec_id // 50 AS rec, CAST(vec_id % 50 AS INT) AS k, list_filter(range(1, len(embedding) + 1), lambda x: embedding[x] > 0) AS b FROM embeddings) SELECT x.rec, x.k AS i, y.k AS j, round(CASE WHEN len(x.b) + len(y.b) = 0 THEN 1e0 ELSE len(list_intersect(x.b, y.b)) / CAST(len(list_distinct(list_concat(x.b, y.b))) AS DOUBLE) END, 6) AS w FROM k x JOIN k y USING (rec)")
def key_jaccard(s, d):
    bits = F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return _r6(similarity.jaccard(windows(s, d).select("rec", "k", bits.alias("bits"))), "w")


@query("laplacian_normalised", _with(_HALF, _PG, "dg AS (SELECT rec, i, sum(CASE WHEN i <> j THEN w ELSE 0 END) AS d FROM pg GROUP BY rec, i)", "SELECT pg.rec, pg.i, pg.j, round(-w / (sqrt(a.d) * sqrt(b.d)), 6) AS w FROM pg JOIN dg a ON a.rec = pg.rec AND a.i = pg.i JOIN dg b ON b.rec = pg.rec AND b.i = pg.j WHERE pg.i <> pg.j UNION ALL SELECT rec, i, i, CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END FROM dg"))
def laplacian_normalised(s, d):
    return _r6(similarity.laplacian_normalised(similarity.p_graph(_half(s, d), 5)), "w")


@query("registry_unregister", "SELECT s_suppkey AS host_name, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def registry_unregister(s, d):
    services = _table(s, d, "supplier").select(F.col("s_suppkey").alias("host_name"), "s_nationkey")
    gone = services.join(_table(s, d, "nation").where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return store.unregister(services, gone)


@query("cache_write", "SELECT n_nationkey AS key, CASE WHEN n_regionkey IN (1, 2) THEN 'new ' ELSE 'old ' END || n_name AS result FROM nation WHERE n_regionkey <> 4")
def cache_write(s, d):
    row = lambda text: (F.col("n_nationkey").alias("key"), F.concat(F.lit(text), F.col("n_name")).alias("result"))
    nation = _table(s, d, "nation")
    return store.put_results(nation.where("n_regionkey in (0, 2, 3)").select(*row("old ")), nation.where("n_regionkey in (1, 2)").select(*row("new ")))


@query("legacy_rows", _with(_INTERVALS, "SELECT rec, k AS seg, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, CAST(length(label) AS VARCHAR) AS label FROM iv WHERE label <> 'error'"))
def legacy_rows(s, d):
    label = F.when(F.col("label") == "error", -1).otherwise(F.length("label"))
    rows = intervals(s, d).select("rec", F.col("k").alias("seg"), F.col("s").cast("double").alias("start"), (F.col("e") - F.col("s")).cast("double").alias("duration"), label.alias("label"))
    return turns.of_legacy(rows)


@query("mask_of_seconds", _with(_FRAMES, "sg AS (SELECT rec, round_even(i * 0.0107e0 / 0.01e0, 0) AS a, round_even((i * 0.0107e0 + 0.0149e0) / 0.01e0, 0) AS b FROM frames WHERE p > 0.9e0)", "SELECT rec, i, CASE WHEN EXISTS (SELECT 1 FROM sg WHERE sg.rec = frames.rec AND frames.i >= a AND frames.i < b) THEN 1 ELSE 0 END AS speech FROM frames"))
def mask_of_seconds(s, d):
    f = frames(s, d)
    start = F.col("i") * 0.0107
    return vad.mask_of_seconds(f, f.where("p > 0.9").select("rec", start.alias("s"), (start + 0.0149).alias("e")))


@query("window_steps", "SELECT l_orderkey, l_linenumber, CAST(greatest(1, floor(l_linenumber / 8e0 * l_suppkey)) AS BIGINT) AS step FROM lineitem")
def window_steps(s, d):
    return _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", requests.step_samples(F.col("l_linenumber") / F.lit(8.0), F.col("l_suppkey")).alias("step"))


@query("label_histogram", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_histogram(s, d):
    return _table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("estimate_mode", "WITH c AS (SELECT user_id AS rec, event_type AS estimate, count(*) AS n FROM events GROUP BY ALL) SELECT rec, estimate FROM c QUALIFY row_number() OVER (PARTITION BY rec ORDER BY n DESC, estimate) = 1")
def estimate_mode(s, d):
    n = _table(s, d, "events").groupBy(F.col("user_id").alias("rec"), F.col("event_type").alias("estimate")).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("n"), "estimate"))
    return n.withColumn("r", first).where("r = 1").select("rec", "estimate")


@query("uncached_jobs", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 30000 AND o_custkey IS NOT NULL)")
def uncached_jobs(s, d):
    o = _table(s, d, "orders").select("o_orderkey", F.md5(F.col("o_custkey").cast("string").cast("binary")).alias("key"), "o_totalprice")
    return store.uncached(o, o.where("o_totalprice < 30000")).select("o_orderkey")


@query("cluster_by_size")
def cluster_by_size(s, d):
    return clustering.cluster(windows(s, d), "by_size")


@query("cluster_multiscale")
def cluster_multiscale(s, d):
    """Two scales: windows, and the means of neighbouring ones over the same stretch of time."""
    w = windows(s, d).select("rec", "k", (F.col("k") * 12000).alias("s"), (F.col("k") * 12000 + 24000).alias("e"), "embedding")
    each = w.select("rec", F.floor(F.col("k") / 2).cast("int").alias("k"), "s", "e", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    means = each.groupBy("rec", "k", "d").agg(F.avg("x").alias("x"), F.min("s").alias("s"), F.max("e").alias("e"))
    coarse = means.groupBy("rec", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda y: y.x).cast("array<float>").alias("embedding"))
    both = coarse.withColumn("scale", F.lit(0)).unionByName(w.withColumn("scale", F.lit(1)))
    return clustering.cluster_scales(both, {0: 1.0, 1: 1.0})


@query("legacy_diarize")
def legacy_diarize(s, d):
    f = windows(s, d).select("rec", F.col("k").alias("i"), F.col("embedding").cast("array<double>").alias("mfcc"))
    return binary_keys.diarize(f, window=10, least=10, segment=5, context=5, smooth=5)
