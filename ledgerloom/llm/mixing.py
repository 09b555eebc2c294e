"""Mixing sources to target weights, by fitting each source's budget as a subset sum over document lengths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, numbered, words

WEIGHTS = (5, 2, 1)
#: A source's words are taken at most so often.
MOST = 3
#: Parts into which documents of one source and length are dealt, to rank them.
DEALT = 256
#: Words of budget left to the dynamic program at first; what is above is met by the longest documents.
EXACT = 1 << 16


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their words come nearest to the budget from below.

    Takes each length's share of the budget, rounded down, and fits what is left by a dynamic program over the other documents. If that doesn't come as near as the lengths' common divisor allows, documents are given back,
    four times as many words each time, until it does or until nothing is taken beforehand, so that the program has gone through all that can be taken.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    nearest = budget - budget % math.gcd(*lengths)
    taken, reach = _fitted(lengths, counts, [c * budget // total for c in counts], budget, EXACT)
    window, whole = EXACT, False
    while reach < nearest and not whole:
        whole = window >= budget
        taken, reach = _fitted(lengths, counts, [c * max(0, budget - window) // total for c in counts], budget, window)
        window *= 4
    return taken


def _fitted(lengths: list[int], counts: list[int], taken: list[int], budget: int, most: int) -> tuple[list[int], int]:
    """taken with more documents, and their words: the longest that fit until `most` words are left, then those that a bounded knapsack fits. Each count is split into powers of two, each used once or not."""
    taken = list(taken)
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - taken[i], max(0, left - most) // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    by = np.full(left + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in order:
        many, step = min(counts[i] - taken[i], left // lengths[i]), 1
        while many and not reached[left]:
            step = min(step, many)
            words_ = step * lengths[i]
            new = reached[:-words_] & ~reached[words_:]
            by[words_:][new] = len(items)
            reached[words_:] |= new
            items.append((i, step))
            many -= step
            step *= 2
    at = int(np.flatnonzero(reached)[-1])
    reach = budget - left + at
    while at:
        i, step = items[by[at]]
        taken[i] += step
        at -= step * lengths[i]
    return taken, reach


def _level(sources: DataFrame) -> float:
    """The words of a unit of weight, so that targets of at most MOST times their source's size add up to all sizes."""
    level = 0.0
    while True:
        full = F.col("source_size") * MOST <= F.lit(level) * F.col("weight")
        total, held, weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * MOST).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if not total or not weight or (total - held) / weight <= level:
            return level
        level = (total - held) / weight


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; taken is a multiple of size from 0 to 3 times.

    Every document is taken as often as its source's target allows for all; the rest of the target is fitted over the counts of documents by
    exact length, and among documents of one source and length those with the least seeded hashes are taken once more. Each source then
    has its target to the word wherever its lengths can add up to it. Null texts and texts without words have size 0 and are never taken;
    a null source is a source, the last one; equal rows are interchangeable; an empty table gives no rows.
    """
    sizes = durable(_measured(docs, id_col, source_col, text_col, seed))
    return _mixed(sizes, sizes, weights).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as mix takes it; columns of any names stay."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    sizes = durable(_measured(docs, id_col, source_col, text_col, seed))
    taken = _mixed(sizes, _measured(docs, id_col, source_col, text_col, seed, row), weights).where("times > 0 AND size > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def _measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, *more: Column) -> DataFrame:
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *more)
    return sizes.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.pmod("hash", F.lit(DEALT)).cast("int"))


def _mixed(hashed: DataFrame, rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """rows, which have the columns of hashed and maybe more, with how many times each is taken."""
    parts = durable(hashed.groupBy("source", "size", "part").agg(F.count("*").alias("n")))
    by_source = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = durable(numbered(by_source, F.col("source").asc_nulls_last(), "place").withColumn("weight", weight).drop("place"))
    target = F.least(F.col("source_size") * float(MOST), F.col("weight") * F.lit(_level(sources)))
    budgets = sources.select("source", "source_size", target.alias("target")).withColumn("words", F.round("target").cast("long"))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        budget, total = int(rows["words"].iloc[0]), int(rows["source_size"].iloc[0])
        rows = rows.sort_values("size")
        if total:
            own = rows["size"].to_numpy() > 0
            more = np.zeros(len(rows), np.int64)
            more[own] = fit(rows["size"][own].tolist(), rows["n"][own].tolist(), budget % total)
            return rows[["source", "size", "source_size", "target"]].assign(times=budget // total, more=more)
        return rows[["source", "size", "source_size", "target"]].assign(times=0, more=0)

    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    of_source = lengths.join(budgets, lengths.source.eqNullSafe(budgets.source)).drop(budgets.source)
    picks = of_source.groupBy("source").applyInPandas(fitted, "source string, size long, source_size long, target double, times long, more long")
    key = lambda df: [F.coalesce(df.source, F.lit("")).alias("s"), df.source.isNull().alias("s_null")]
    picks = picks.select(*key(picks), "size", "source_size", "target", "times", "more")
    before = Window.partitionBy("s", "s_null", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quotas = parts.select(*key(parts), "size", "part", "n").join(picks, ["s", "s_null", "size"])
    quotas = quotas.withColumn("quota", F.col("more") - F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "more")
    inside = Window.partitionBy("s", "s_null", "size", "part").orderBy("hash", "doc_id")
    ranked = rows.select(*key(rows), *(c for c in rows.columns if c != "source")).join(quotas, ["s", "s_null", "size", "part"])
    more = (F.row_number().over(inside) <= F.col("quota")).cast("long")
    return ranked.withColumn("times", F.col("times") + more).drop("s", "s_null", "hash", "part", "quota")
