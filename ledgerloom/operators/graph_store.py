"""A stored graph that grows batch by batch: nodes and edges with their sources and descriptions as rows, and retrieval that goes on from what it has found."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scoring import cosine
from ledgerloom.operators.descriptions import joined_texts, kept_texts
from ledgerloom.operators.graph import both_ways
from ledgerloom.session import durable

@dataclass(frozen=True)
class Stored:
    """Nodes, or edges: things has one row for each key with what merging keeps of it, sources one for each (key, chunk_id, document_id), texts one for each description that no earlier one of its key holds."""

    things: DataFrame
    sources: DataFrame
    texts: DataFrame


def batch(rows: DataFrame, key: str, keep: Sequence[str], most: str, order: str = "at", texts: bool = True) -> Stored:
    """One batch of nodes or edges as they are found: of each key the first values of `keep`, the greatest of `most`, and its sources and descriptions. A store that is never asked for descriptions has none without `texts`."""
    things = rows.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in keep), F.max(most).alias(most), F.min(order).alias(order))
    return Stored(things, rows.select(key, "chunk_id", "document_id").distinct(), kept_texts(rows, key, order) if texts else rows.where("false").select(key, order, "description"))


def grown(old: Stored, new: Stored, key: str, keep: Sequence[str], most: str, order: str = "at", texts: bool = True) -> Stored:
    """The store with a batch merged in, whose order goes on from the store's: what was first stays, the greatest score counts, sources and descriptions are added unless they are there.

    Descriptions are looked through again for the keys of the batch alone. Merging batches one after the other gives what one batch of all rows gives.
    """
    both = old.things.unionByName(new.things)
    things = both.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in keep), F.max(most).alias(most), F.min(order).alias(order))
    sources = old.sources.unionByName(new.sources.join(old.sources, [key, "chunk_id", "document_id"], "left_anti"))
    if not texts:
        return Stored(things, sources, old.texts)
    touched = new.things.select(key)
    again = old.texts.join(touched, key, "left_semi").unionByName(new.texts)
    return Stored(things, sources, old.texts.join(touched, key, "left_anti").unionByName(kept_texts(again, key, order)))


def written(store: Stored, folder: str) -> Stored:
    """The store written to a folder and read from there; an older store is not to lie in the same folder."""
    spark = store.things.sparkSession
    for name in ("things", "sources", "texts"):
        getattr(store, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    return Stored(*(spark.read.parquet(f"{folder}/{name}") for name in ("things", "sources", "texts")))


def held(store: Stored, parts: Collection[str] = ("things", "sources", "texts")) -> Stored:
    """The store cut off from what it was made of, for a next batch in the same job. Parts that nobody asks for need not be written."""
    return Stored(*(durable(rows) if name in parts else rows for name, rows in (("things", store.things), ("sources", store.sources), ("texts", store.texts))))


def described(store: Stored, key: str, order: str = "at", between: str = " | ") -> DataFrame:
    """(key, description): the descriptions of each key in order, joined. For the keys that are asked for: a row is as long as the key's texts."""
    return joined_texts(store.texts, key, order, between)


def retrieved(nodes: DataFrame, edges: DataFrame, question: Sequence[float], k: int, steps: int, key: str = "node", least: float = 0.0, enough: float | None = None, vector: str = "embedding") -> DataFrame:
    """(key, score, step): retrieval that goes on from what it has found.

    Step 0 finds the k nodes nearest to a question, of at least a score. Each further step goes along the edges, either way, from the nodes of the step before, and keeps the k best of those that no step has found. It ends with `steps`
    further steps, or when a step finds nothing, or when its best node is below `enough`. What was found, at most k nodes a step, is kept between the steps; ties go to the smaller key.
    """
    spark = nodes.sparkSession
    scored = nodes.select(key, cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in question))).alias("score")).where(F.col("score") >= least)
    ways = both_ways(edges).select("node", "other").distinct()
    best = lambda rows: [(r[key], r.score) for r in rows.orderBy(F.desc("score"), key).limit(k).select(key, "score").collect()]
    kind = dict(nodes.dtypes)[key]
    front = best(scored)
    found = [(n, s, 0) for n, s in front]
    for step in range(1, steps + 1):
        if not front or enough is not None and front[0][1] < enough:
            break
        near = ways.join(F.broadcast(spark.createDataFrame([(n,) for n, _ in front], f"node {kind}")), "node").select(F.col("other").alias(key)).distinct()
        fresh = near.join(F.broadcast(spark.createDataFrame([(n,) for n, _, _ in found], f"{key} {kind}")), key, "left_anti")
        front = best(scored.join(fresh, key))
        found += [(n, s, step) for n, s in front]
    return spark.createDataFrame(found, f"{key} {kind}, score double, step int")


