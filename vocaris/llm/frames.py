"""Reading tables, running Arrow steps and cutting lineage, for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between steps: the session's ``spark.checkpoint.dir``. Only a
    session in one process (``local[...]``, as in tests) may leave it unset and gets one of its own;
    on a cluster a folder of one machine would lose data, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="vocaris-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there. Lost executors can't lose
    them. Spark deletes them with ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as compressed columns: for many or wide rows. Inside owned() the table belongs to that
    block; else it stays, as a DataFrame that isn't read yet may need it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _owner.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside the block are deleted at its end, and no others: for callers
    that write their result inside. Blocks of other threads and outer blocks keep theirs."""
    token = _owner.set(paths := [])
    try:
        yield
    finally:
        _owner.reset(token)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[T.StructField]) -> DataFrame:
    """mapInArrow with a schema of nullable fields."""
    return df.mapInArrow(fn, T.StructType(fields))


def append_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with the columns added, replacing those of the same name."""
    taken = {n.lower() for n in columns}
    names = [n for n in batch.schema.names if n.lower() not in taken]
    arrays = [batch.column(batch.schema.names.index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(columns.values()), names=names + list(columns))


def crc32_of_id(id_col: str = "doc_id"):
    """CRC-32 of the id's decimal text, the driver's rule for folds; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))
