"""Who speaks: votes over search hits, mapping to names, and statistics by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def votes(hits: DataFrame, min_similarity: Column | float, allowed: DataFrame | None = None, excluded: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """(query, speaker_id, name, votes) of the winner among a query's hits (query, ord, score,
    speaker_id, name). Scores of one id are summed, ties go to the id met first, the name is that of
    the best hit. allowed and excluded (speaker_id) apply to hits, that is after the search's own
    limit. With queries (query), those without a winner come out as nulls."""
    least = min_similarity if isinstance(min_similarity, Column) else F.lit(min_similarity)
    counted = hits.where(F.col("speaker_id").isNotNull() & (F.col("speaker_id") != "") & (F.col("score") >= least))
    if allowed is not None:
        counted = counted.join(allowed.select("speaker_id").distinct(), "speaker_id", "left_semi")
    if excluded is not None:
        counted = counted.join(excluded.select("speaker_id").distinct(), "speaker_id", "left_anti")
    summed = counted.groupBy("query", "speaker_id").agg(F.sum("score").alias("votes"), F.min("ord").alias("first"), F.max_by("name", F.struct("score", -F.col("ord"))).alias("name"))
    order = Window.partitionBy("query").orderBy(F.round("votes", 12).desc(), "first")
    won = summed.withColumn("r", F.row_number().over(order)).where("r = 1").select("query", "speaker_id", "name", "votes")
    return won if queries is None else queries.select("query").distinct().join(won, "query", "left")


def votes_by_name(hits: DataFrame, min_similarity: float = 0.5, allowed: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """The same for one collection without ids (query, ord, score, name): scores are summed by name,
    after the excluded names, the threshold and the allowed names."""
    by_name = hits.select("query", "ord", "score", F.col("name").alias("speaker_id"), "name")
    names = lambda df: None if df is None else df.select(F.col("name").alias("speaker_id"))
    return votes(by_name, min_similarity, names(allowed), names(excluded)).select("query", "name", "votes")


def in_collection_order(hits: DataFrame, collections: DataFrame) -> DataFrame:
    """hits (query, collection, score, point, ...) with ord: collections (collection, pos) in the order
    asked for, then the best hits of each, ties by point."""
    order = Window.partitionBy("query").orderBy("pos", F.round("score", 12).desc(), "point")
    return hits.join(collections.select("collection", "pos"), "collection").withColumn("ord", F.row_number().over(order)).drop("pos")


def segments_by_tag(segments: DataFrame) -> DataFrame:
    """(rec, spk, first, segments): each tag's [start, end] pairs in the order of segments (rec, spk, seg,
    s, e), and the number of the tag's first segment, which orders tags."""
    each = F.sort_array(F.collect_list(F.struct("seg", "s", "e")))
    return segments.groupBy("rec", "spk").agg(F.min("seg").alias("first"), F.transform(each, lambda x: F.array(x.s, x.e)).alias("segments"))


def speech_order(segments: DataFrame) -> DataFrame:
    """(rec, spk, total, first, pos): tags by speech time, longest first, ties by first segment."""
    tags = segments.groupBy("rec", "spk").agg(F.sum(F.col("e") - F.col("s")).alias("total"), F.min("seg").alias("first"))
    return tags.withColumn("pos", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("total"), "first")))


def map_names(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Segments (rec, spk, ...) with who: the identified name of (rec, spk), or the tag itself."""
    return segments.join(names.select("rec", "spk", "name"), ["rec", "spk"], "left").withColumn("who", F.coalesce("name", "spk")).drop("name")


def stats_by_name(segments: DataFrame, names: DataFrame) -> DataFrame:
    """(rec, who, duration, nbr_seg, spk_id_score): tags with one name are one speaker. Where several
    tags share a name, the one processed last counts for the score: tags go by speech time, longest
    first, ties by first appearance. The score is null for tags that weren't identified."""
    mapped = map_names(segments, names).withColumn("d", F.col("e") - F.col("s"))
    tags = mapped.groupBy("rec", "spk", "who").agg(F.sum("d").alias("total"), F.min("seg").alias("first"), F.sum(F.round("d", 3)).alias("d"), F.count(F.lit(1)).alias("n"))
    scored = tags.join(names.select("rec", "spk", "score"), ["rec", "spk"], "left")
    last = F.min_by("score", F.struct(F.round("total", 9), -F.col("first")))
    return scored.groupBy("rec", "who").agg(F.round(F.sum("d"), 3).alias("duration"), F.sum("n").alias("nbr_seg"), F.round(last, 3).alias("spk_id_score"))


def named_result(segments: DataFrame, names: DataFrame) -> DataFrame:
    """(rec, result): the wire document of segments (rec, seg, spk, s, e) under the names (rec, spk, name,
    score) that were found; tags without one keep their own. Speakers are in order of their first
    segments, and only found ones have a score."""
    mapped = map_names(segments, names)
    parts = F.struct(F.col("seg").alias("seg_id"), F.col("who").alias("spk_id"), F.col("s").alias("seg_begin"), F.col("e").alias("seg_end"))
    segs = mapped.groupBy("rec").agg(F.sort_array(F.collect_list(parts)).alias("segments"))
    first = mapped.groupBy("rec", "who").agg(F.min("seg").alias("first"))
    stats = stats_by_name(segments, names).join(first, ["rec", "who"])
    each = F.struct("first", F.col("who").alias("spk_id"), "spk_id_score", "duration", "nbr_seg")
    bare = F.transform(F.sort_array(F.collect_list(each)), lambda x: x.dropFields("first"))
    return stats.groupBy("rec").agg(bare.alias("speakers")).join(segs, "rec").select("rec", F.to_json(F.struct("speakers", "segments")).alias("result"))


def identify_exclusive(tags: DataFrame, hits: DataFrame, min_similarity: float) -> DataFrame:
    """(rec, spk, speaker_id, name, votes) where no speaker is found twice in a recording: tags (rec,
    spk, total, first) go by speech time, and each winner is out for the later ones. hits: (rec, spk,
    ord, score, speaker_id, name). One recording's tags and hits, a few tens, are one group."""
    joined = tags.join(hits, ["rec", "spk"]).select("rec", "spk", "total", "first", "ord", "score", "speaker_id", "name")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        out, taken = [], set()
        group = group[(group.score >= min_similarity) & group.speaker_id.notna()].sort_values(["total", "first", "ord"], ascending=[False, True, True], kind="stable")
        for (total, first, spk), own in group.groupby(["total", "first", "spk"], sort=False):
            own = own[~own.speaker_id.isin(taken)]
            if own.empty:
                continue
            sums = own.groupby("speaker_id", sort=False).score.sum()
            winner = sums.round(12).idxmax()
            taken.add(winner)
            best = own[own.speaker_id == winner].sort_values(["score", "ord"], ascending=[False, True]).iloc[0]
            out.append((group.rec.iloc[0], spk, winner, best["name"], float(sums[winner])))
        return pd.DataFrame(out, columns=["rec", "spk", "speaker_id", "name", "votes"])

    return joined.groupBy("rec").applyInPandas(one, "rec long, spk string, speaker_id string, name string, votes double")


def resolve_threshold(spec: Column, configured: str | None, default: float = 0.5) -> Column:
    """The request's value, else the configured one unless empty, else the default."""
    return F.coalesce(spec.cast("double"), F.lit(float(configured)) if configured else F.lit(None).cast("double"), F.lit(default))


def accuracy(truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: share of queries whose winner is the true speaker_id; for impostors, whose true id is
    null, of those without a winner."""
    joined = truth.select("query", F.col("speaker_id").alias("t")).join(found.select("query", F.col("speaker_id").alias("f")), "query", "left")
    right = F.when(F.col("t").eqNullSafe(F.col("f")), 1.0).otherwise(0.0)
    return joined.agg(F.avg(F.when(F.col("t").isNotNull(), right)).alias("accuracy"), F.avg(F.when(F.col("t").isNull(), right)).alias("rejection"))


