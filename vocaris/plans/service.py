"""A service's work as jobs over tables: requests answered as each of them asks, folders written as
RTTM, and the collection that a folder of samples gives at the start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocaris.operators import identify, similarity, store, turns
from vocaris.plans.pipelines import DIARIZE, DiarizeConfig
from vocaris.plans.recordings import Model, diarize_audio, tag_vectors, voiceprints, with_rec
from vocaris.settings import Settings
from vocaris.sources import audio, results
from vocaris.sources.shared import cut

#: The document of a recording in which nobody speaks.
NOBODY = '{"speakers":[],"segments":[]}'


@dataclass(frozen=True)
class Service:
    """Models, and where voices are known: points (collection, point_id, speaker_id, name, vector, model_id)
    and collections (collection); without points nobody is identified. ``answer`` is the work of a
    streaming.jobs.JobStream."""

    speech: Model
    voice: Model
    model_id: str
    points: DataFrame | None = None
    collections: DataFrame | None = None
    settings: Settings = Settings()
    config: DiarizeConfig = DIARIZE
    digits: int = 2
    hits: int = 10  # of each collection

    def answer(self, jobs: DataFrame) -> DataFrame:
        """(key, result) of jobs (key, content, speaker_count, max_speaker, collections, speakers,
        min_similarity): each recording has its own numbers of speakers, and is identified in its own
        collections (null: not at all), among its own speakers (null: everybody), from its own similarity.
        Content that isn't a WAV file has no row, a recording without speech an empty document, and a
        job without a usable collection keeps the tags. A key is answered once."""
        once = jobs.dropDuplicates(["key"]).withColumn("rec", F.xxhash64("key"))
        known = cut(once.drop("content", "path"))
        read = cut(audio.decoded(once.select(F.col("key").alias("path"), "content")).where("samples is not null").select("path", "samples"))
        counts = known.select("rec", F.col("speaker_count").alias("speakers"), F.col("max_speaker").alias("most"))
        found = cut(diarize_audio(read, self.speech, self.voice, self.config, counts))
        names, asked = self._names(known, read, found)
        plain = turns.json_result(found.join(asked, "rec", "left_anti"), self.digits)
        named = identify.named_result(self._tags(found.join(asked, "rec", "left_semi")), names)
        documents = plain.unionByName(named)
        return with_rec(read.select("path")).join(documents, "rec", "left").select(F.col("path").alias("key"), F.coalesce("result", F.lit(NOBODY)).alias("result"))

    def _tags(self, found: DataFrame) -> DataFrame:
        """Segments (rec, seg, spk, s, e) as the wire format gives them."""
        wire = turns.wire_segments(found, self.digits)
        return wire.select("rec", F.col("seg_id").alias("seg"), F.col("spk_id").alias("spk"), F.col("seg_begin").alias("s"), F.col("seg_end").alias("e"))

    def _names(self, known: DataFrame, read: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rec, spk, name, score) of tags that were found, and the recordings (rec) that have a usable
        collection."""
        spark = known.sparkSession
        if self.points is None or self.collections is None:
            return spark.createDataFrame([], "rec long, spk string, name string, score double"), spark.createDataFrame([], "rec long")
        listed = known.select("rec", F.posexplode("collections").alias("pos", "collection")).groupBy("rec", "collection").agg(F.min("pos").alias("pos"))
        open_ = store.usable(listed.select("collection", F.lit(0).alias("pos")).distinct(), self.collections, store.model_ids(self.points), self.model_id).select("collection")
        wanted = cut(listed.join(open_.distinct(), "collection"))
        asked = wanted.select("rec").distinct()
        tags = cut(self._tags(found.join(asked, "rec", "left_semi")))
        recordings = with_rec(read).join(asked, "rec", "left_semi").select("path", "samples")
        vectors = tag_vectors(recordings, tags.withColumnRenamed("spk", "label"), self.voice)
        vectors = cut(vectors.withColumn("query", F.xxhash64("rec", "spk")))  # the model runs once
        voices = self.points.join(wanted.select("collection").distinct(), "collection", "left_semi").withColumn("point", F.xxhash64("collection", "point_id"))
        close = similarity.top_k(vectors.select("query", "vector"), voices.select("point", "vector", "collection"), self.hits, partition="collection")
        least = identify.resolve_threshold(F.col("min_similarity"), self.settings.min_similarity)
        everybody_or = F.col("speakers").isNull() | F.array_contains("speakers", F.col("speaker_id"))
        mine = close.join(vectors.select("query", "rec", "spk"), "query").join(wanted.withColumnRenamed("collection", "part"), ["rec", "part"])
        order = Window.partitionBy("query").orderBy("pos", F.round("score", 12).desc(), "point")
        placed = mine.withColumn("ord", F.row_number().over(order)).join(voices.select("point", "speaker_id", "name"), "point")
        heard = placed.join(known.select("rec", "speakers", least.alias("least")), "rec").where((F.col("score") >= F.col("least")) & everybody_or)
        if self.settings.identify_twice:
            won = identify.votes(heard, F.col("least")).where("speaker_id is not null").join(vectors.select("query", "rec", "spk"), "query")
        else:
            speech = identify.speech_order(tags).select("rec", "spk", "total", "first")
            won = identify.identify_exclusive(speech, heard.select("rec", "spk", "ord", "score", "speaker_id", "name"), -2.0)
        return cut(won.select("rec", "spk", "name", F.col("votes").alias("score"))), asked


def write_folder(spark: SparkSession, folder: str, out: str, speech: Model, voice: Model, config: DiarizeConfig = DIARIZE) -> None:
    """RTTM lines of all WAV files under a folder. A file is named by its path in the folder, without the
    extension, white space as ``_``; one that can't be read, or in which nobody speaks, has no line."""
    read = cut(audio.read(spark, folder).where("samples is not null").select("path", "samples"))
    inner = F.regexp_replace(F.substring_index("path", folder.rstrip("/"), -1), r"^/+|\.[^./]*$", "")
    named = with_rec(read.select("path")).select(F.col("rec").alias("id"), F.regexp_replace(inner, r"\s", "_").alias("rec"))
    found = diarize_audio(read, speech, voice, config).withColumnRenamed("rec", "id")
    results.write_rttm(found.join(named, "id").select("rec", "s", "e", "label"), out)


def start(spark: SparkSession, settings: Settings, points: DataFrame, collections: DataFrame, samples: str | None, voice: Model, model_id: str, dim: int = 192, again: bool = False) -> tuple[DataFrame, DataFrame, str, DataFrame | None]:
    """Points, collections, what was done, and (speaker, error) of the samples' speakers, null where nothing
    was read. A folder of samples fills the settings' one collection, a speaker for each folder or file in
    it, where that collection isn't there yet or is to be made again. Done is ``off`` (no store is set),
    ``no samples``, ``no collection`` (samples, but no collection to put them in), ``kept`` or ``enrolled``.
    Speakers whose samples can't be used aren't stored."""
    if not settings.can_identify:
        return points, collections, "off", None
    if samples is None:
        return points, collections, "no samples", None
    if settings.legacy_collection is None:
        return points, collections, "no collection", None
    name = spark.createDataFrame([(settings.legacy_collection,)], "collection string")
    if not collections.join(name, "collection", "left_semi").isEmpty():
        if not again:
            return points, collections, "kept", None
        points, collections = store.drop(points, name)[0], store.drop(collections, name)[0]
    files = cut(audio.read(spark, samples).select("path", "samples"))
    clips = audio.speakers(files, samples).join(files, "path").select("speaker", "pos", "samples")
    prints = cut(voiceprints(clips, voice, model_id, most=settings.most_enrollment, least=settings.least_enrollment))
    stored = prints.where("error is null").select(F.lit(settings.legacy_collection).alias("collection"), F.trim("speaker").alias("name"), "vector", "model_id")
    collections, _ = store.ensure(collections, name, dim)
    return points.unionByName(store.numbered_points(stored), allowMissingColumns=True), collections, "enrolled", prints.select("speaker", "error")
