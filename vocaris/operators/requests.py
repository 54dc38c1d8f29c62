"""Checking and normalising requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocaris.functions.ids import COLLECTION


def normalise_counts(jobs: DataFrame, ceiling: int | None = None) -> DataFrame:
    """0 means not given; speaker_count wins over max_speaker; with a ceiling, it stands in where
    neither is given."""
    count, most = F.nullif("speaker_count", F.lit(0)), F.nullif("max_speaker", F.lit(0))
    most = F.when(count.isNotNull(), F.lit(None)).otherwise(most if ceiling is None else F.coalesce(most, F.lit(ceiling)))
    return jobs.withColumns({"speaker_count": count.cast("int"), "max_speaker": most.cast("int")})


# The keys of a specification.
_ALLOWED = ("collections", "speakers", "minSimilarity")


def check_specs(specs: DataFrame, column: str = "spec") -> DataFrame:
    """specs with valid, collections, speakers (null: everybody) and min_similarity of each JSON spec:
    an object of collections (a non-empty list of well-formed names), speakers (absent, null, "*", or a
    list of non-empty strings, which may be empty and then fits nobody) and minSimilarity (a number
    from 0 to 1, not a boolean)."""
    v = F.try_parse_json(F.col(column))
    kind = lambda path: F.schema_of_variant(F.variant_get(v, path, "variant"))
    keys = F.json_object_keys(F.col(column))
    names = F.try_variant_get(v, "$.collections", "array<string>")
    listed = F.try_variant_get(v, "$.speakers", "array<string>")
    strings = lambda path: kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>")
    score = F.try_variant_get(v, "$.minSimilarity", "double")
    numeric = kind("$.minSimilarity").rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT)$")
    ok_names = strings("$.collections") & (F.size(names) > 0) & F.forall(names, lambda n: n.rlike(COLLECTION) & ~n.contains("\n"))
    text = F.try_variant_get(v, "$.speakers", "string")
    given = kind("$.speakers")
    everybody = given.isNull() | (given == "VOID") | ((given == "STRING") & (text == "*"))
    ok_speakers = everybody | (strings("$.speakers") & F.forall(listed, lambda s: s.isNotNull() & (F.length(s) > 0)))
    missing = kind("$.minSimilarity")
    ok_score = missing.isNull() | (missing == "VOID") | (numeric & score.between(0, 1))
    known = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in _ALLOWED]))) == 0
    valid = F.coalesce(known & ok_names & ok_speakers & ok_score, F.lit(False))
    return specs.withColumn("valid", valid).withColumns({"collections": F.when(valid, names), "speakers": F.when(valid & ~everybody, listed), "min_similarity": F.when(valid, score)})


def expand_speakers(specs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name) of lists like ``a|b|c`` or JSON: names, numbers, and ranges {"start", "end"} over the
    positions (pos from 1) of known (pos, name); unknown ones come with found = false,
    and ``*`` stays as it is."""
    v = F.try_parse_json("spec")
    items = F.try_variant_get(v, "$", "array<variant>")
    as_list = F.coalesce(items, F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)))
    json_items = specs.where(F.trim("spec") != "*").select("id", F.explode(as_list).alias("x"))
    typed = json_items.select("id", F.schema_of_variant("x").alias("t"), F.try_variant_get("x", "$.start", "int").alias("a"), F.try_variant_get("x", "$.end", "int").alias("b"), F.try_variant_get("x", "$", "string").alias("s"))
    ranged = typed.where("a is not null and b is not null").select("id", F.explode(F.sequence("a", "b")).alias("pos"))
    single = typed.where("t = 'BIGINT'").select("id", F.col("s").cast("int").alias("pos"))
    by_pos = ranged.unionByName(single).join(known, "pos", "left").select("id", F.coalesce("name", F.col("pos").cast("string")).alias("name"), F.col("name").isNotNull().alias("found"))
    quoted = typed.where("t = 'STRING' and a is null").select("id", F.col("s").alias("name"))
    plain = specs.where(as_list.isNull() & (F.trim("spec") != "*")).select("id", F.explode(F.split("spec", "\\|")).alias("name")).select("id", F.trim("name").alias("name"))
    asked = quoted.unionByName(plain).where("name <> ''")
    by_name = asked.join(known.select("name", F.lit(True).alias("f")), "name", "left").select("id", "name", F.coalesce("f", F.lit(False)).alias("found"))
    everybody = specs.where(F.trim("spec") == "*").select("id", F.lit("*").alias("name"), F.lit(True).alias("found"))
    return by_pos.unionByName(by_name).unionByName(everybody)


def enrollable(rows: DataFrame, model_id: str, dim: int = 192) -> DataFrame:
    """rows (vector, model_id, ...) with error: null where the point may be stored."""
    return rows.withColumn("error", F.when(~F.col("model_id").eqNullSafe(F.lit(model_id)), "model_mismatch").when(F.coalesce(F.size("vector") != dim, F.lit(True)), "bad_vector"))


def enrollment_audio(clips: DataFrame, rate: int = 16000, most: int = 180, least: int = 3) -> DataFrame:
    """(speaker, duration_used, files_used, error) of clips (speaker, pos, samples): clips in order up to
    the budget, the last one cut; null samples are files that couldn't be read."""
    readable = clips.where("samples is not null")
    before = F.coalesce(F.sum("samples").over(Window.partitionBy("speaker").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("samples"), F.lit(rate * most) - before))
    used = readable.withColumn("take", take).where("take > 0").groupBy("speaker").agg(F.sum("take").alias("n"), F.count(F.lit(1)).alias("files_used"))
    joined = clips.select("speaker").distinct().join(used, "speaker", "left")
    error = F.when(F.col("n").isNull(), "no_valid_audio").when(F.col("n") < rate * least, "audio_too_short")
    return joined.select("speaker", F.round(F.coalesce("n", F.lit(0)) / float(rate), 3).alias("duration_used"), F.coalesce("files_used", F.lit(0)).alias("files_used"), error.alias("error"))


def step_samples(ratio: Column, window: Column) -> Column:
    """Samples between two windows: a usable ratio of the window's length, else an error."""
    return F.when(positive_ratio(ratio), F.greatest(F.lit(1), F.floor(ratio * window))).otherwise(F.raise_error(F.lit("the step must be above 0 and at most 1"))).cast("long")


def positive_ratio(value: Column) -> Column:
    """Whether a window step ratio is usable: above 0, at most 1."""
    return (value > 0) & (value <= 1)
