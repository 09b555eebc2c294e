"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places on the ring. The tables of counts and of segments have this many rows, and a row for each shard, whatever the input.
PLACES = 1 << 16
#: Virtual nodes of a shard.
VIRTUAL = 64


def virtual_nodes(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) % PLACES, s) for s in range(shards) for v in range(virtual))


def walk(counts: dict[int, int], shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (place, first, last, shard, slot, home): keys first to last - 1 of a place go to the shard, in slots from slot on.

    A place's keys go to the next virtual node clockwise, its home. All places offer their keys there; a shard takes them up to its
    capacity, and what is left goes on to the next virtual node, and so on. Capacities add up to the number of keys and are at most one apart.
    """
    nodes = virtual_nodes(shards, virtual)
    at = [place for place, _ in nodes]
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    home = {p: bisect_left(at, p) % len(nodes) for p in counts}
    waiting = {p: 0 for p in sorted(counts) if counts[p]}  # place: keys already taken in
    segments = []
    for step in range(len(nodes)):
        if not waiting:
            break
        for place, first in list(waiting.items()):
            shard = nodes[(home[place] + step) % len(nodes)][1]
            take = min(free[shard], counts[place] - first)
            if take:
                segments.append((place, first, first + take, shard, filled[shard], nodes[home[place]][1]))
                free[shard] -= take
                filled[shard] += take
                if first + take == counts[place]:
                    del waiting[place]
                else:
                    waiting[place] = first + take
    return segments


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard) of every row, under the law `rows`: counts at most one apart.

    A row's place is a hash of its id. Rows are ranked inside their place by hash, id, size and checksum, and the rank says which of the place's
    segments, hence which shard and slot, the row gets; equal rows are interchangeable. home_shard is the ring's choice before any overflow.
    A null text has no bytes; null ids share a place. An empty table gives no rows. Only counts by place come to the driver, and only
    the segments, at most PLACES + shards rows, are broadcast.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64(id_col), F.lit(PLACES)).cast("int")
    counts = {r.place: r.n for r in docs.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}
    segments = spark.createDataFrame(walk(counts, shards, virtual), "place int, first long, last long, shard int, start long, home_shard int")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(id_col).alias("hash"), place.alias("place"),
    )
    inside = Window.partitionBy("place").orderBy("hash", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    found = ranked.join(F.broadcast(segments), "place").where("rank >= first AND rank < last")
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )
