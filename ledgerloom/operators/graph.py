"""The entity graph as two frames: nodes and edges that know the documents they come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import edge_key, entity_key
from ledgerloom.operators.access import restricted
from ledgerloom.operators.analytics import ranked_once
from ledgerloom.operators.descriptions import joined_texts, kept_texts
from ledgerloom.operators.retrieval import merged, scored, top
from ledgerloom.session import durable

# What a line without a readable score or weight gets.
KEY_SCORE, WEIGHT = 50, 1.0
# The least score of a node near a question, the score of one found by its name, and the characters of a chunk that go into a batch.
LEAST_SCORE, TEXT_SCORE, BATCH_CHARS = 0.5, 0.5, 4000
#: Stands between the descriptions of one node or edge.
BETWEEN = " | "


def _parts(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\(|\)$", ""), r"\|"), lambda x: F.trim(x))


def lines(outputs: DataFrame, text: str = "text") -> DataFrame:
    """Each line of each output, as `line`, with the output's other columns."""
    return outputs.select(*(c for c in outputs.columns if c != text), F.explode(F.split(text, "\n")).alias("line"))


def entities(rows: DataFrame) -> DataFrame:
    """Lines `(entity|kind|name|description|score)` as columns; a score that is no number is KEY_SCORE, other lines are left out."""
    p = _parts(F.col("line"))
    fit = rows.where((F.lower(F.get(p, F.lit(0))) == "entity") & (F.size(p) >= 5) & (F.get(p, F.lit(2)) != ""))
    return fit.select(
        *(c for c in rows.columns if c != "line"), F.upper(F.get(p, F.lit(1))).alias("kind"), F.get(p, F.lit(2)).alias("name"), F.get(p, F.lit(3)).alias("description"),
        F.coalesce(F.get(p, F.lit(4)).try_cast("int"), F.lit(KEY_SCORE)).alias("score"),
    )


def relationships(rows: DataFrame) -> DataFrame:
    """Lines `(relationship|source|target|description|keywords|weight)` as columns; a weight that is no number is WEIGHT, other lines are left out."""
    p = _parts(F.col("line"))
    fit = rows.where((F.lower(F.get(p, F.lit(0))) == "relationship") & (F.size(p) >= 6))
    return fit.select(
        *(c for c in rows.columns if c != "line"), F.get(p, F.lit(1)).alias("src"), F.get(p, F.lit(2)).alias("tgt"), F.get(p, F.lit(3)).alias("description"), F.get(p, F.lit(4)).alias("keywords"),
        F.coalesce(F.get(p, F.lit(5)).try_cast("double"), F.lit(WEIGHT)).alias("weight"),
    )


def keyed(nodes: DataFrame, workspace: str) -> DataFrame:
    return nodes.withColumn("entity_id", entity_key(F.lit(workspace), F.col("kind"), F.col("name")))


def linked(edges: DataFrame, workspace: str) -> DataFrame:
    return edges.withColumn("edge_id", edge_key(F.lit(workspace), F.lower("src"), F.lower("tgt")))


def merge_descriptions(rows: DataFrame, key: str, order: str, text: str = "description") -> DataFrame:
    """(key, description): distinct texts of a key in the order of their first appearance, without those that an earlier one contains. Which texts stay is found over all tasks, whatever a key has of them."""
    return joined_texts(kept_texts(rows, key, order, text), key, order, BETWEEN, text)


def merged_nodes(rows: DataFrame, key: str = "entity_id", order: str = "at") -> DataFrame:
    """One node for each key: its first name and kind, merged descriptions, greatest score, all chunks and documents."""
    base = rows.groupBy(key).agg(
        F.min_by("name", order).alias("name"), F.min_by("kind", order).alias("kind"), F.max("score").alias("score"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
        F.array_sort(F.collect_set("document_id")).alias("document_ids"),
    )
    return base.join(merge_descriptions(rows, key, order), key, "left")


def merged_edges(rows: DataFrame, key: str = "edge_id", order: str = "at") -> DataFrame:
    """One edge for each key: ends of the first, merged descriptions, distinct keywords in order, greatest weight, all documents."""
    base = rows.groupBy(key).agg(
        F.min_by("src", order).alias("src"), F.min_by("tgt", order).alias("tgt"), F.max("weight").alias("weight"), F.array_sort(F.collect_set("document_id")).alias("document_ids"),
    )
    words = rows.select(key, order, F.posexplode(F.transform(F.split("keywords", ","), lambda x: F.trim(x))).alias("pos", "word")).where("word != ''")
    first = words.groupBy(key, "word").agg(F.min(F.struct(order, "pos")).alias("first"))
    told = first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "word"))), lambda x: x["word"]), ", ").alias("keywords"))
    return base.join(told, key, "left").join(merge_descriptions(rows, key, order), key, "left")


def best(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of equal keys the row with the greatest score, the first among equals."""
    return ranked_once(rows, [key], [F.desc("score"), F.col(order)])


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same key; of several new ones the last by order."""
    last = new if order is None else ranked_once(new, [key], [F.desc(order)])
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(old.columns))


def without_document(rows: DataFrame, document_id) -> DataFrame:
    """Nodes or edges after a document is gone: it leaves their lists, and those of it alone go."""
    left = rows.withColumn("document_ids", F.array_remove("document_ids", document_id))
    return left.where(F.size("document_ids") > 0)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other) with the edge's columns, from either end; a loop once."""
    out = edges.withColumn("node", F.col("src")).withColumn("other", F.col("tgt"))
    back = edges.where("src != tgt").withColumn("node", F.col("tgt")).withColumn("other", F.col("src"))
    return out.unionByName(back)


def node_edges(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """Edges at the nodes of a frame (node): out, in or both."""
    if direction == "out":
        return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    if direction == "in":
        return edges.join(nodes.select(F.col("node").alias("tgt")), "tgt", "left_semi")
    return both_ways(edges).join(nodes, "node", "left_semi")


def reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes within so many hops of the start nodes, with the least number of hops.

    Each hop joins only the nodes that the hop before found first; a node is never entered again. What a hop finds is written out, so that the next one starts from it.
    """
    ways = durable(both_ways(edges).select("node", "other").distinct())
    seen = durable(start.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        found = front.join(ways, "node").select(F.col("other").alias("node")).distinct()
        front = durable(found.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def paths(edges: DataFrame, start: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(path): the simple paths of up to so many edges from the start nodes, in the edges' direction; at most `most` of them, the shortest first."""
    steps = edges.select(F.col("src").alias("last"), F.col("tgt").alias("to")).distinct()
    front = start.select(F.col("node").alias("last"), F.array("node").alias("path"))
    found = None
    for _ in range(depth):
        front = front.join(steps, "last").where(~F.array_contains("path", F.col("to"))).select(F.col("to").alias("last"), F.array_append("path", F.col("to")).alias("path"))
        found = front if found is None else found.unionByName(front)
    found = found.select("path")
    return found if most is None else found.orderBy(F.size("path"), "path").limit(most)


def named(nodes: DataFrame, name: str, exact: bool = False, acl: DataFrame | None = None) -> DataFrame:
    """Nodes by name, in any case; with acl only those that a readable document mentions."""
    low = F.lower("name")
    found = nodes.where((low == name.lower()) if exact else low.contains(name.lower()))
    return readable(found, acl)


def readable(rows: DataFrame, acl: DataFrame | None) -> DataFrame:
    """Nodes or edges of which a readable document is a source; edges carry their documents as nodes do. Only the different lists of documents are opened, and rows stay as many as they were."""
    if acl is None:
        return rows
    lists = rows.select("document_ids").distinct()
    kept = restricted(lists.select("document_ids", F.explode("document_ids").alias("document_id")), acl).select("document_ids").distinct()
    return rows.join(kept, "document_ids", "left_semi").select(rows.columns)


def ends(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges with the name of both ends."""
    name = lambda end: nodes.select(F.col(key).alias(end), F.col("name").alias(f"{end}_name"))
    return edges.join(name("src"), "src").join(name("tgt"), "tgt")


def chunks_of(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each chunk that a node comes from, once."""
    wanted = nodes.select(F.explode("chunk_ids").alias("chunk_id")).distinct()
    return chunks.join(wanted, "chunk_id", "left_semi")


def similar_nodes(nodes: DataFrame, question: Sequence[float], k: int, key: str, least: float = LEAST_SCORE, acl: DataFrame | None = None, sources: Sequence[str] = (), vector: str = "embedding") -> DataFrame:
    """The k nodes or edges nearest to a question, of at least a score; with acl those that a readable document mentions, else, if any are given, those of some sources."""
    rows = readable(nodes, acl) if acl is not None else nodes.where(F.arrays_overlap("document_ids", F.array(*map(F.lit, sources)))) if sources else nodes
    return top(scored(rows, question, vector), k, key, least)


def hybrid_nodes(nodes: DataFrame, question: Sequence[float], text: str, k: int, key: str, least: float = LEAST_SCORE, acl: DataFrame | None = None) -> DataFrame:
    """The k best of the nodes nearest to a question and of those whose name holds a text, which count TEXT_SCORE; a node of both counts as near."""
    near = similar_nodes(nodes, question, k, key, least, acl)
    told = named(nodes, text, acl=acl).withColumn("score", F.lit(TEXT_SCORE))
    return top(merged([near, told], key), k, key)


def local_retrieval(nodes: DataFrame, chunks: DataFrame, question: Sequence[float], k: int, key: str, acl: DataFrame | None = None, least: float = LEAST_SCORE) -> tuple[DataFrame, DataFrame]:
    """The nodes nearest to a question, and each chunk that they come from."""
    near = similar_nodes(nodes, question, k, key, least, acl)
    return near, chunks_of(near, chunks)


def global_retrieval(edges: DataFrame, nodes: DataFrame, question: Sequence[float], k: int, key: str, node_key: str, acl: DataFrame | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The edges nearest to a question, with the names of their ends."""
    return ends(similar_nodes(edges, question, k, key, least, acl), nodes, node_key)


def hybrid_retrieval(nodes: DataFrame, edges: DataFrame, question: Sequence[float], k: int, key: str, acl: DataFrame | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """(node, hops): the nodes nearest to a question, and those one hop from them."""
    near = similar_nodes(nodes, question, k, key, least, acl)
    return reached(readable(edges, acl), near.select(F.col(key).alias("node")), 1)


def batches(chunks: DataFrame, document: str, place: str, text: str, n: int, most: int = BATCH_CHARS) -> DataFrame:
    """(document, batch, chunks, text): each n chunks of a document that follow one another, joined by blank lines, each cut to `most` characters. place counts from 0."""
    rows = chunks.select(document, F.floor(F.col(place) / n).cast("int").alias("batch"), F.struct(F.col(place).alias("at"), F.left(F.col(text), F.lit(most)).alias("text")).alias("one"))
    held = rows.groupBy(document, "batch").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return held.select(document, "batch", F.size("all").alias("chunks"), F.array_join(F.col("all.text"), "\n\n").alias("text"))
