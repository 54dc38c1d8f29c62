"""Voiceprint collections and service registry as tables: every change returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocaris.functions.ids import parse_collection, speaker_point_id
from vocaris.operators.requests import enrollable


def upsert(points: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("collection", "point_id"), version: str = "updated_at") -> DataFrame:
    """The last version of each key wins; at equal versions, new over old."""
    both = points.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r", "__new")


def delete(points: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points without ids (collection, point_id), and per collection how many of the ids existed.
    Asking twice for an id counts once."""
    wanted = ids.select("collection", "point_id").distinct()
    existed = wanted.join(points.select("collection", "point_id").distinct(), ["collection", "point_id"], "left_semi")
    counts = wanted.select("collection").distinct().join(existed.groupBy("collection").agg(F.count(F.lit(1)).alias("deleted")), "collection", "left")
    return points.join(wanted, ["collection", "point_id"], "left_anti"), counts.select("collection", F.coalesce("deleted", F.lit(0)).alias("deleted"))


def ensure(collections: DataFrame, names: DataFrame, dim: int = 192) -> tuple[DataFrame, DataFrame]:
    """The registry with every name in it, and (collection, created)."""
    wanted = names.select("collection").distinct()
    missing = wanted.join(collections.select("collection"), "collection", "left_anti")
    new = missing.select("collection", F.lit(dim).alias("dim"), F.lit("COSINE").alias("distance"))
    flags = wanted.join(missing.withColumn("m", F.lit(True)), "collection", "left").select("collection", F.coalesce("m", F.lit(False)).alias("created"))
    return collections.unionByName(new, allowMissingColumns=True), flags


def drop(table: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without the named collections, and (collection, existed)."""
    wanted = names.select("collection").distinct()
    there = wanted.join(table.select("collection").distinct().withColumn("x", F.lit(True)), "collection", "left")
    return table.join(wanted, "collection", "left_anti"), there.select("collection", F.coalesce("x", F.lit(False)).alias("existed"))


def model_ids(points: DataFrame) -> DataFrame:
    """(collection, model_id) of each collection's first point."""
    return points.groupBy("collection").agg(F.min_by("model_id", "point_id").alias("model_id"))


def usable(requested: DataFrame, collections: DataFrame, models: DataFrame, expected: str) -> DataFrame:
    """Requested (collection, pos) that exist and whose model is the expected one or unknown."""
    known = requested.join(collections.select("collection").distinct(), "collection", "left_semi").join(models, "collection", "left")
    return known.where(F.col("model_id").isNull() | (F.col("model_id") == expected)).select("collection", "pos")


def heartbeat(services: DataFrame, beats: DataFrame) -> DataFrame:
    """Registry rows by host, with the freshest heartbeat."""
    return upsert(services, beats, keys=("host_name",), version="last_alive")


def unregister(services: DataFrame, hosts: DataFrame) -> DataFrame:
    """The registry without the named hosts (host_name); unknown ones don't matter."""
    return services.join(hosts.select("host_name").distinct(), "host_name", "left_anti")


def put_results(cache: DataFrame, done: DataFrame) -> DataFrame:
    """The cache (key, result) with new results; a new result replaces an old one."""
    return cache.join(done.select("key").distinct(), "key", "left_anti").select("key", "result").unionByName(done.select("key", "result"))


def enroll(points: DataFrame, collections: DataFrame, new: DataFrame, model_id: str, dim: int = 192) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, collections, and (collection, point_id, status, created_collection, error) after storing
    new points (collection, speaker_id, name, vector, model_id, updated_at). Points that don't fit the
    model or whose collection has no well-formed name are refused; ids derive from the
    speaker's, so that enrolling a speaker again replaces."""
    checked = enrollable(new.withColumn("point_id", speaker_point_id(F.col("speaker_id"))), model_id, dim)
    named = checked.withColumn("error", F.coalesce("error", F.when(parse_collection(F.col("collection")).organization_id.isNull(), F.lit("bad_collection"))))
    good = named.where("error is null").drop("error")
    after, created = ensure(collections, good.select("collection"), dim)
    status = named.join(created, "collection", "left").select("collection", "point_id", F.when(F.col("error").isNull(), "stored").otherwise("refused").alias("status"), (F.coalesce("created", F.lit(False)) & F.col("error").isNull()).alias("created_collection"), "error")
    return upsert(points, good.select(*points.columns)), after, status


def cache_key(content: Column, speaker_count: Column, max_speaker: Column) -> Column:
    """Key of a memoised result: the content's hash and the counts that matter."""
    return F.md5(F.concat_ws("|", F.md5(content), F.coalesce(speaker_count.cast("string"), F.lit("")), F.coalesce(F.when(speaker_count.isNull(), max_speaker).cast("string"), F.lit(""))))


def uncached(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    return jobs.join(cache.select("key").distinct(), "key", "left_anti")


def names(points: DataFrame) -> DataFrame:
    """(collection, name) of everybody enrolled."""
    return points.select("collection", "name").where("name is not null").distinct()


def lookup(points: DataFrame, ids: DataFrame) -> DataFrame:
    """(collection, point_id, name) for each asked id; name is null if there is no such point."""
    asked = ids.select("collection", "point_id").distinct()
    return asked.join(points.select("collection", "point_id", "name"), ["collection", "point_id"], "left")


def lookup_name(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(collection, name, point_id, found) for each asked name: point_id only if exactly one has it."""
    n = points.groupBy("collection", "name").agg(F.min("point_id").alias("p"), F.count(F.lit(1)).alias("found"))
    joined = asked.select("collection", "name").distinct().join(n, ["collection", "name"], "left")
    return joined.select("collection", "name", F.when(F.col("found") == 1, F.col("p")).alias("point_id"), F.coalesce("found", F.lit(0)).alias("found"))


def payload(collection: Column, speaker_id: Column, name: Column, model_id: Column, updated_at: Column | None = None) -> Column:
    """A point's payload; the time defaults to now, as an ISO 8601 text in UTC."""
    parsed = parse_collection(collection)
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return F.struct(
        speaker_id.alias("speaker_id"), name.alias("name"), parsed.organization_id.alias("organization_id"), parsed.studio_collection_id.alias("studio_collection_id"),
        model_id.alias("model_id"), (now if updated_at is None else updated_at).alias("updated_at"),
    )


def numbered_points(voiceprints: DataFrame) -> DataFrame:
    """Points (point_id, name, vector) of a bulk enrollment: one for each name, numbered from 1 inside
    each collection in order of names."""
    order = Window.partitionBy("collection").orderBy("name")
    return voiceprints.withColumn("point_id", F.row_number().over(order).cast("string"))


def service_info(info: Column, extra: dict[str, str]) -> Column:
    """Registered JSON: the configured object (anything else counts as empty) with extra keys over it."""
    own = F.from_json(F.when(F.trim(info).startswith("{"), info), "map<string,string>")
    keys = F.array(*[F.lit(k) for k in extra])
    kept = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(keys, k))
    added = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), F.lit(v))])
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, added)))))
