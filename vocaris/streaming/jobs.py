"""Requests as a stream: files of JSON lines in, a table of results by content and a table of statuses out.

Each batch of requests is checked, given keys by content and counts, and freed of what earlier batches have
answered; the rest is worked on once for each key. A batch writes its results and statuses to parts that
carry its number, results first, so that a batch that is done again after a failure writes the same parts
anew: no job is lost and none is there twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vocaris.operators import requests, store
from vocaris.sources.shared import cut

#: A request: the file to work on, counts (0: not given), and the specification of speakers (JSON), if any.
REQUESTS = "request_id string, path string, speaker_count int, max_speaker int, speaker_names string"
_RESULTS = "key string, result string, batch long"
_STATUS = "request_id string, path string, key string, status string, message string, batch long"

Work = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class JobStream:
    """folder: shared, for results, statuses and the stream's progress. content gives requests a column
    ``content`` (null: the file isn't there). work answers jobs (key, path, content, speaker_count,
    max_speaker, collections, speakers, min_similarity) with (key, result); a job without a row, or with a
    null result, has failed, and is tried again when it is asked for again."""

    folder: str
    content: Work
    work: Work
    ceiling: int | None = None

    def submit(self, spark: SparkSession, intake: str, **options: str) -> DataFrame:
        """The stream of request files in a folder."""
        return spark.readStream.schema(REQUESTS).options(**options).json(intake)

    def start(self, stream: DataFrame, once: bool = True) -> StreamingQuery:
        """Work on a stream of requests: what is there now, or for ever."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/progress")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def process(self, batch: DataFrame, number: int) -> None:
        """One batch; the same number again replaces what it wrote before."""
        spark = batch.sparkSession
        checked = cut(self._checked(batch))  # the batch's files are read once
        answered = self.results(spark).where(F.col("batch") < number).select("key")
        jobs = checked.where("status = 'todo'").dropDuplicates(["key"]).join(answered.distinct(), "key", "left_anti")
        kept = ["key", "path", "content", "speaker_count", "max_speaker", "collections", "speakers", "min_similarity"]
        found = self.work(jobs.select(*kept)).where("result is not null").select("key", "result").dropDuplicates(["key"])
        found.write.mode("overwrite").parquet(f"{self.folder}/results/batch={number}")
        done = self.results(spark).where(F.col("batch") <= number).select("key", F.lit(True).alias("there")).distinct()
        status = F.when(F.col("status") != "todo", F.col("status")).when(F.col("there"), "done").otherwise("failed")
        message = F.when(status == "failed", "no result").otherwise(F.col("message"))
        out = checked.join(done, "key", "left").select("request_id", "path", "key", status.alias("status"), message.alias("message"))
        out.write.mode("overwrite").parquet(f"{self.folder}/status/batch={number}")

    def _checked(self, batch: DataFrame) -> DataFrame:
        """Requests with content, key, what the specification says, and status todo or rejected with a message."""
        there = self.content(requests.normalise_counts(batch, self.ceiling))
        specs = requests.check_specs(there, "speaker_names")
        bad_spec = F.col("speaker_names").isNotNull() & ~F.col("valid")
        message = F.when(F.col("path").isNull(), "no file is named").when(F.col("content").isNull(), "the file isn't there").when(bad_spec, "the specification of speakers isn't valid")
        # who is looked for is part of what a result answers
        who = F.coalesce("speaker_names", F.lit(""))
        key = F.md5(F.concat_ws("|", store.cache_key(F.col("content"), F.col("speaker_count"), F.col("max_speaker")), who))
        return specs.withColumns({"message": message, "status": F.when(message.isNull(), "todo").otherwise("rejected"), "key": F.when(message.isNull(), key)})

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)

    def results(self, spark: SparkSession) -> DataFrame:
        """(key, result, batch), each key once."""
        return self._table(spark, "results", _RESULTS)

    def status(self, spark: SparkSession) -> DataFrame:
        """(request_id, path, key, status, message, batch) of every request; status is done, failed or
        rejected."""
        return self._table(spark, "status", _STATUS)

    def answers(self, spark: SparkSession) -> DataFrame:
        """(request_id, status, message, result)."""
        found = self.results(spark).select("key", "result")
        return self.status(spark).join(found, "key", "left").select("request_id", "status", "message", "result")


def binary_content(spark: SparkSession, root: str) -> Work:
    """content of the files under a folder, for paths relative to it."""

    def add(rows: DataFrame) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        inner = F.regexp_replace(F.substring_index("path", root.rstrip("/"), -1), "^/+", "")
        return rows.join(files.select(inner.alias("path"), "content"), "path", "left")

    return add
