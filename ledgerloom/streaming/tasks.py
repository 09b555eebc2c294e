"""The queue's state and its event counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.operators.queue import folded


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, so many in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def arriving_text(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of text files as they arrive, each whole."""
    return spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def task_states(events: DataFrame, key: str, at: tuple[str, ...], state: str) -> DataFrame:
    """The state of each task as events come in; the same rows as over a table of them."""
    return folded(events, key, at, state)


def windowed(events: DataFrame, at: str, width: str, late: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of events in windows of a width; a batch ignores how late events may be."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "value")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): runs of a key's events without a longer gap."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works off all that has arrived into a table in memory, and ends."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_batches(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Hands each batch to write(rows, number) once it is complete; a repeated batch has the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
