"""Many names looked up among many others: which of the wanted names each one means, by a join in place of a test for each."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import entity_name
from ledgerloom.operators.similar_names import common, kept_segments, lengths_of, sought_segments
from ledgerloom.session import durable

#: Ratio from which names are alike, and the ways of matching in the order in which they count.
LEAST = 80
WAYS = ("exact", "substring", "fuzzy")


def _runs(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def _within(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small_id, large_id) of the texts that stand in others: a small one asks by the one of its runs that the fewest large ones have. Runs are as long as the greatest power of two that the small text has room for,
    so that they tell texts apart as well as half of the text does; only runs of lengths that are asked for are made."""
    sizes = sorted({1 << n.bit_length() - 1 for n in lengths_of(small, "text")})
    if not sizes:
        return small.select(F.col("id").alias("small_id")).crossJoin(large.select(F.col("id").alias("large_id"))).where("false")
    every = reduce(lambda a, b: F.concat(a, b), (F.when(F.length("text") >= n, _runs(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in sizes))
    held = large.select(F.col("id").alias("large_id"), F.explode(F.array_distinct(every)).alias("run"))
    often = held.groupBy("run").agg(F.count("*").alias("often"))
    own = reduce(lambda a, n: F.when(F.length("text") >= n, _runs(F.col("text"), n)).otherwise(a), sizes, F.array().cast("array<string>"))
    asks = small.select(F.col("id").alias("small_id"), F.explode(F.array_distinct(own)).alias("run"))
    asked = asks.hint("merge").join(often.hint("merge"), "run", "left")  # a run that no large text has decides that none holds it
    rarest = asked.groupBy("small_id").agg(F.min_by("run", F.struct(F.coalesce("often", F.lit(0)), "run")).alias("run"))
    met = rarest.hint("merge").join(held.hint("merge"), "run").select("small_id", "large_id")
    texts = met.join(small.select(F.col("id").alias("small_id"), F.col("text").alias("small")), "small_id").join(large.select(F.col("id").alias("large_id"), F.col("text").alias("large")), "large_id")
    return texts.where(F.col("large").contains(F.col("small"))).select("small_id", "large_id")


def _alike(forms: DataFrame, targets: DataFrame, least: int) -> DataFrame:
    """(form_id, target_id) of the texts of a ratio of at least `least`. Either may be the shorter one: what one seeks as the longer, the other keeps as the shorter; whole subsequences are the same for both."""

    def keys(other: frozenset[int], kept: str, sought: str):
        mark = lambda k, sign: sign + k if " " in k else k
        return F.pandas_udf(lambda s: s.map(lambda x: list({mark(k, kept) for k in kept_segments(x, least, other)} | {mark(k, sought) for k in sought_segments(x, least, other)})), "array<string>")

    @F.pandas_udf("long")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    left = forms.select(F.col("id").alias("form_id"), F.explode(keys(lengths_of(targets, "text"), "<", ">")("text")).alias("key")).select("form_id", F.xxhash64("key").alias("key"))
    right = targets.select(F.col("id").alias("target_id"), F.explode(keys(lengths_of(forms, "text"), ">", "<")("text")).alias("key")).select("target_id", F.xxhash64("key").alias("key"))
    # neither side may be broadcast: keys are far more than Spark's estimate, which is that of the names
    met = left.hint("merge").join(right.hint("merge"), "key").select("form_id", "target_id").distinct()
    met = met.join(forms.select(F.col("id").alias("form_id"), F.col("text").alias("a")), "form_id").join(targets.select(F.col("id").alias("target_id"), F.col("text").alias("b")), "target_id")
    return met.where(200 * lcs("a", "b") >= least * (F.length("a") + F.length("b"))).select("form_id", "target_id")


def looked_up(names: DataFrame, wanted: DataFrame, name: str = "name", order: str = "place", least: int = LEAST) -> DataFrame:
    """(name, wanted, match) of every different name that means a wanted one, with the first such by the wanted names' order and how it is met: `exact` if one of its writings is the wanted one in normal form, `substring` if one normal
    form stands within the other, `fuzzy` from a ratio of `least` on.

    wanted has (name, order). Only names that share a segment or a run of characters meet, over all tasks; empty and missing names mean nothing.
    """
    form = lambda rows, *more: rows.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), entity_name(F.col(name)).alias("form"), *more).where("form <> ''")
    numbered = lambda rows: durable(rows.withColumn("id", F.monotonically_increasing_id()))
    own = durable(form(names).distinct())
    asked = numbered(form(wanted, F.col(order).alias("place")).groupBy("form").agg(F.min_by("name", "place").alias("wanted"), F.min("place").alias("place")))
    forms, targets = numbered(own.select(F.col("form").alias("text")).distinct()), asked.select("id", F.col("form").alias("text"))
    same = forms.select(F.col("id").alias("form_id"), "text").join(targets.select(F.col("id").alias("target_id"), "text"), "text").select("form_id", "target_id", F.lit(0).alias("way"))
    inside = _within(targets, forms).select(F.col("large_id").alias("form_id"), F.col("small_id").alias("target_id")).unionByName(_within(forms, targets).select(F.col("small_id").alias("form_id"), F.col("large_id").alias("target_id")))
    met = same.unionByName(inside.withColumn("way", F.lit(1))).unionByName(_alike(forms, targets, least).withColumn("way", F.lit(2)))
    first = lambda rows, by: rows.groupBy(by).agg(F.min(F.struct("place", "way", "wanted")).alias("best"))
    places = asked.select(F.col("id").alias("target_id"), "place", "wanted", F.col("form").alias("target"))
    found = first(met.groupBy("form_id", "target_id").agg(F.min("way").alias("way")).join(places, "target_id"), "form_id").join(forms.select(F.col("id").alias("form_id"), F.col("text").alias("form")), "form_id")
    every = own.join(found.select("form", "best"), "form").select("name", "best")
    written = own.select("name", F.lower("name").alias("target")).join(places, "target").select("name", F.struct("place", F.lit(0).alias("way"), "wanted").alias("best"))
    best = every.unionByName(written).groupBy("name").agg(F.min("best").alias("best"))
    ways = F.array(*map(F.lit, WAYS))
    return best.select("name", F.col("best.wanted").alias("wanted"), F.get(ways, F.col("best.way")).alias("match"))
