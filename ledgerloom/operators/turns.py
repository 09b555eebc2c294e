"""Conversations turn by turn: what the pronouns of a turn stand for."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import durable

# Turns that are looked back on, and what is a file, a name of several words and a topic in them.
BEFORE = 10
FILE, NAME, TOPIC = r"\b[\w-]+\.(?:pdf|docx?|xlsx?|txt|md|csv)\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", r"\b[A-Z][a-z]{2,}\b"
MENTIONS = {"files": FILE, "people": NAME, "topics": TOPIC}
# Pronouns that files, topics and people stand for.
PRONOUNS = {"it": ("it",), "this": ("this", "that"), "they": ("they", "them")}


def mentions(text: Column) -> Column:
    """A struct of the files, people and topics that a text mentions, the last first. Letters beyond ASCII belong to words, but don't begin any."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "_")
    return F.struct(*(F.reverse(F.regexp_extract_all(plain, F.lit(p), F.lit(0))).alias(name) for name, p in MENTIONS.items()))


def looked_back(turns: DataFrame, key: str, order: Sequence[str], value: str, before: int) -> DataFrame:
    """turns with `earlier`: the values of up to so many turns before, in the same conversation, the latest first.

    Turns are dealt over ranges of (conversation, order), so that one conversation may lie on many tasks. The last turns of a range are handed on to the next as well, where they are only looked back on. Of each range, only so
    many last turns and the first conversation go through the driver.
    """
    spark = turns.sparkSession
    place = F.struct(key, *order)
    rows = durable(turns.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()).withColumn("_own", F.lit(True)))
    last = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(place)))
    tails = rows.withColumn("_last", last).where(F.col("_last") <= before).select("_part", "_last", key, *order, value).collect()
    firsts = {r._part: r.first for r in rows.groupBy("_part").agg(F.min_by(F.struct(F.col(key).alias("key")), place).alias("first")).collect()}
    held, handed = deque(maxlen=before), []
    by_part: dict[int, list] = {}
    for r in sorted(tails, key=lambda r: -r._last):
        by_part.setdefault(r._part, []).append(r)
    for part in sorted(firsts):
        handed += [(part, *(r[c] for c in (key, *order, value))) for r in held if r[key] == firsts[part].key]
        held.extend(by_part[part])
    kept = rows.select("_part", "_own", *(c for c in rows.columns if c not in ("_part", "_own")))
    fields = rows.select("_part", key, *order, value).schema
    context = spark.createDataFrame(handed, fields).withColumn("_own", F.lit(False))
    window = Window.partitionBy("_part", key).orderBy(*order, F.col("_own")).rowsBetween(-before, -1)
    every = kept.unionByName(context, allowMissingColumns=True).withColumn("earlier", F.reverse(F.collect_list(value).over(window)))
    return every.where("_own").drop("_part", "_own")


def resolved(turns: DataFrame, key: str, order: Sequence[str], text: str, before: int = BEFORE) -> DataFrame:
    """turns with it, this, they and resolved_text: the last file, the last topic and the last two people that the turns before mention, and the text with them in place of the pronouns.

    Null where nothing of the kind was mentioned; its pronouns then stay. A missing text mentions nothing and stays missing. Turns with the same order are put in the order of their other columns given.
    """
    told = looked_back(turns.withColumn("_told", mentions(F.col(text))), key, order, "_told", before).drop("_told")
    flat = {name: F.flatten(F.col(f"earlier.{name}")) for name in MENTIONS}
    first = lambda values: F.get(values, F.lit(0))
    two = F.slice(F.array_distinct(flat["people"]), 1, 2)
    found = told.withColumns({"it": first(flat["files"]), "this": first(flat["topics"]), "they": F.nullif(F.array_join(two, ", "), F.lit(""))}).drop("earlier")
    out = F.col(text)
    for name, words in PRONOUNS.items():
        pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])"
        out = F.when(F.col(name).isNotNull(), F.regexp_replace(out, F.lit(pattern), F.concat(F.lit('"'), F.regexp_replace(F.col(name), r"([\\$])", r"\\$1"), F.lit('"')))).otherwise(out)
    return found.withColumn("resolved_text", out)
