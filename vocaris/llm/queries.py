"""The corpus queries opN_<name> and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocaris.llm import bpe, exact_dedup, html_extract, langid, lm, mixing, near_dedup, negatives, quality, spelling, suffix_dedup, toxicity, url_filter
from vocaris.llm.frames import crc32_of_id, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.decide(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.learn(pages), carry=["page_id", "url"])


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of_id(), F.lit(4)) == 2
    return langid.learn_and_identify(table(spark, sf_dir, "documents"), held_out)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return negatives.mine(rows, F.col("id") % 100 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.count_words(table(spark, sf_dir, "documents"), spelling.damaged))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc32_of_id(), F.lit(10)) == 0
    return lm.learn_and_score(table(spark, sf_dir, "documents"), held_out)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_toxicity": op2_toxicity,
        "op3_mixing": op3_mixing,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_html": op6_html,
        "op7_langid": op7_langid,
        "op8_url_filter": op8_url_filter,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality": op10_quality,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_spelling": op12_spelling,
        "op13_lm_scores": op13_lm_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op5_near_dedup": near_dedup.ORACLE_SQL,
        "op8_url_filter": url_filter.ORACLE_SQL,
        "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op11_hard_negatives": negatives.ORACLE_SQL,
        "op12_spelling": spelling.ORACLE_SQL,
    }
