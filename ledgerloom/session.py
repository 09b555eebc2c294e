"""The session settings that the library's queries assume."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; settings of a cluster's own stay as they are."""
    builder = (
        SparkSession.builder.appName("ledgerloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written to the folder that the session's spark.checkpoint.dir names; what was done before is not done again. Only a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)
