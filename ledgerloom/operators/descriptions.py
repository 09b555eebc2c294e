"""Descriptions of a thing from many places: those that say something new, in the order in which they came."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import durable

#: Length of the runs of characters by which texts meet that may hold one another.
GRAM = 4


def kept_texts(rows: DataFrame, key: str, order: str, text: str = "description") -> DataFrame:
    """(key, order, text): the descriptions of a key that no earlier one of the same key contains, each where it came first.

    Equal texts become one before anything else. A text that another contains has all its runs of GRAM characters there, so each text looks for the others by the one of its runs that the fewest texts of its key have; texts
    shorter than that look by the whole. Runs are dealt over all tasks, so a key of very many texts is never in one place. Missing and empty texts are left out.
    """
    first = rows.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(key, F.col(text).alias("t")).agg(F.min(order).alias("at"))
    first = durable(first.withColumn("id", F.monotonically_increasing_id()))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - (n - 1), F.lit(1))), lambda i: F.substring("t", i, F.lit(n)))
    every = reduce(lambda a, b: F.concat(a, b), (runs(n) for n in range(1, GRAM + 1)))
    run = F.xxhash64(key, "run").alias("run")  # as a number it is shuffled in fewer bytes; texts of other keys that share one are told apart below
    held = first.select(key, "id", F.explode(F.array_distinct(every)).alias("run")).select("id", run)
    often = held.groupBy("run").agg(F.count("*").alias("often"))
    own = F.when(F.length("t") >= GRAM, runs(GRAM)).otherwise(F.array("t"))
    asked = first.select(key, F.col("id").alias("asks"), F.explode(F.array_distinct(own)).alias("run")).select("asks", run).hint("merge").join(often.hint("merge"), "run")
    rarest = asked.groupBy("asks").agg(F.min_by("run", F.struct("often", "run")).alias("run"))
    met = rarest.hint("merge").join(held.hint("merge"), "run").where("asks <> id").select("asks", "id")
    small = first.select(F.col("id").alias("asks"), F.col(key).alias("small_key"), F.col("t").alias("small"), F.col("at").alias("small_at"))
    large = first.select("id", F.col(key).alias("large_key"), F.col("t").alias("large"), F.col("at").alias("large_at"))
    inside = met.join(small, "asks").join(large, "id").where("small_key = large_key")
    gone = inside.where(F.col("large").contains(F.col("small")) & (F.struct("large_at", "large") < F.struct("small_at", "small"))).select(F.col("asks").alias("id")).distinct()
    return first.join(gone, "id", "left_anti").select(key, F.col("at").alias(order), F.col("t").alias(text))


def joined_texts(kept: DataFrame, key: str, order: str, between: str, text: str = "description") -> DataFrame:
    """(key, description): the kept texts of each key in order, joined; a row is as long as its key's texts."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return kept.groupBy(key).agg(F.array_join(listed, between).alias("description"))
