"""Result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rttm_line(rec: Column, start: Column, end: Column, label: Column, channel: int = 0) -> Column:
    return F.concat_ws(" ", F.lit("SPEAKER"), rec.cast("string"), F.lit(str(channel)), F.format_string("%.3f", start), F.format_string("%.3f", end - start), F.lit("<NA> <NA>"), label, F.lit("<NA> <NA>"))


def write_rttm(turns: DataFrame, path: str) -> None:
    """One line per turn (rec, s, e, label), a recording's lines in order."""
    ordered = turns.repartition("rec").sortWithinPartitions("rec", "s", "e")
    ordered.select(rttm_line(F.col("rec"), F.col("s"), F.col("e"), F.col("label")).alias("value")).write.mode("overwrite").text(path)


def read_rttm(spark, path: str) -> DataFrame:
    parts = F.split("value", r"\s+")
    lines = spark.read.text(path).where(F.col("value").startswith("SPEAKER"))
    start = parts[3].cast("double")
    return lines.select(parts[1].alias("rec"), start.alias("s"), (start + parts[4].cast("double")).alias("e"), parts[7].alias("label"))
