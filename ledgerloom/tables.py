"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *by: str, times: int = 8) -> DataFrame:
    """The rows of a scan, dealt by columns over `times` as many partitions as the scan has, and no fewer than the session's: partitions get more as the table grows, and not larger."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, times * rows.rdd.getNumPartitions()), *by)
