"""What the operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, so that what was done before need not be done again if executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def text_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """Texts of a batch as UTF-8, null as empty. One text at a time, so that only the batch itself is held."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py() or b""


def numbered(df: DataFrame, by: Column, name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of `by`; rows stay dealt over ranges, only the ranges' sizes come to the driver."""
    ranges = durable(df.repartitionByRange(by).withColumn(f"{name}_range", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in ranges.groupBy(f"{name}_range").count().collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    place = F.row_number().over(Window.partitionBy(f"{name}_range").orderBy(by)) - 1
    return ranges.withColumn(name, place + F.element_at(F.array(*map(F.lit, before or [0])), F.col(f"{name}_range") + 1)).drop(f"{name}_range")
