"""Records and their items in a folder of parts: what comes new replaces what was there under its key, and only the parts that it touches are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import durable

#: Parts of a folder. Each holds the rows whose key's hash falls into it.
PARTS = 64


def _dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    return rows.withColumn("_live", F.lit(True)).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def _written(rows: DataFrame, folder: str, key: str) -> None:
    """Rows over the parts that they name, each part by as many tasks as its rows need; a part without rows is left as it is."""
    rows.repartition(F.col("_part"), F.pmod(F.xxhash64(key), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(folder)


def stored(rows: DataFrame, folder: str, key: str, parts: int = PARTS) -> DataFrame:
    """Writes rows to a new folder and gives them as read from there."""
    _written(_dealt(rows, key, parts), folder, key)
    return read(rows.sparkSession, folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).where("_live").drop("_live", "_part")


def _without(spark: SparkSession, folder: str, keys: DataFrame, key: str, parts: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Rows of the parts that keys touch, without those keys' rows; these rows; the parts."""
    touched = sorted(r._part for r in _dealt(keys.select(key), key, parts).select("_part").distinct().collect())
    held = spark.read.parquet(folder).where(F.col("_part").isin(touched)).where("_live")
    return held.join(keys.select(key), key, "left_anti"), held.join(keys.select(key), key, "left_semi"), touched


def _marks(held: DataFrame, touched: list[int]) -> DataFrame:
    """A row that isn't alive for each touched part, so that a part of which all rows go is written as well."""
    spark = held.sparkSession
    marks = spark.createDataFrame([(p,) for p in touched], "_part int").withColumn("_live", F.lit(False))
    return marks.select(*(F.col(f.name) if f.name in ("_part", "_live") else F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema))


def replaced(folder: str, new: DataFrame, key: str, parts: int = PARTS, of: DataFrame | None = None) -> DataFrame:
    """Puts new rows in place of all rows with their keys, or with the keys of `of`, of which some may have no new row: a record's items go with it. Gives all rows as they are then.

    What stays in the touched parts is written to the shared folder before anything is overwritten, so a lost executor can read it again.
    """
    spark = new.sparkSession
    keys = (new if of is None else of).select(key).distinct()
    kept, _, touched = _without(spark, folder, keys, key, parts)
    rows = durable(kept.unionByName(_dealt(new, key, parts).select(kept.columns)).unionByName(_marks(kept, touched)))
    _written(rows, folder, key)
    return read(spark, folder)


def deleted(folder: str, keys: DataFrame, key: str, parts: int = PARTS) -> int:
    """Takes the rows of keys out of a folder and tells how many there were; keys that aren't there change nothing."""
    spark = keys.sparkSession
    kept, gone, touched = _without(spark, folder, keys.distinct(), key, parts)
    n = gone.count()
    if n:
        _written(durable(kept.unionByName(_marks(kept, touched))), folder, key)
    return n


def saved(records: DataFrame, items: DataFrame, record_folder: str, item_folder: str, key: str = "document_id", array: str = "line_items", parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """Upserts extracted records and replaces their items: a record is written over the one with its key, with the number of its items, and all items of the records go before theirs, numbered as they come, are put in.

    items has (key, line_number, ...); a record without items keeps none.
    """
    counted = items.groupBy(key).agg(F.count("*").cast("int").alias(f"{array}_count"))
    whole = records.join(counted, key, "left").withColumn(f"{array}_count", F.coalesce(f"{array}_count", F.lit(0)))
    whole = durable(whole)
    return replaced(record_folder, whole, key, parts), replaced(item_folder, items, key, parts, of=whole)
