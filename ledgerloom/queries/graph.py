"""Queries of the entity graph: parts, suppliers, customers, nations and regions are nodes, what joins them are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.registry import query
from ledgerloom.tables import table

PLACES = """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS src, 'n' || CAST(s_nationkey AS VARCHAR) AS tgt FROM supplier
UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("tgt"))
    return edge("supplier", "s", "s_suppkey", "n", "s_nationkey").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query("SELECT 'SUPPLIER' AS kind, s_name AS name, 'account ' || CAST(s_nationkey AS VARCHAR) AS description, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 100 AS INTEGER) ELSE 50 END AS score, md5('w:SUPPLIER:' || lower(s_name)) AS entity_id FROM supplier")
def parsed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a model's output as nodes; every second score is no number."""
    rows = table(spark, sf_dir, "supplier")
    score = F.when(F.col("s_suppkey") % 2 == 0, (F.col("s_suppkey") % 100).cast("string")).otherwise("high")
    line = F.concat(F.lit("some words\n(entity|supplier|"), "s_name", F.lit("|account "), F.col("s_nationkey").cast("string"), F.lit("|"), score, F.lit(")\n(entity|broken)"))
    return G.keyed(G.entities(G.lines(rows.select(line.alias("text")))), "w")


@query("""SELECT src, tgt, count(*) AS lines, CAST(max(l_quantity) AS DOUBLE) AS weight, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS documents
FROM (SELECT 'p' || CAST(l_partkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS tgt, l_quantity, l_orderkey FROM lineitem) GROUP BY 1, 2""")
def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of parts and suppliers, merged to one edge for each pair."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("tgt"), "l_quantity", "l_orderkey")
    return rows.groupBy("src", "tgt").agg(F.count("*").alias("lines"), F.max("l_quantity").alias("weight"), F.count_distinct("l_orderkey").alias("documents"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS description FROM customer GROUP BY 1")
def merged_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_mktsegment").alias("description"), F.col("c_mktsegment").alias("at"))
    return G.merge_descriptions(rows, "nation", "at")


@query(f"SELECT tgt AS other FROM ({PLACES}) WHERE src = 'n3' UNION ALL SELECT src FROM ({PLACES}) WHERE tgt = 'n3'")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("n3",)], "node string")
    return G.node_edges(_places(spark, sf_dir), start).select("other")


@query(f"""WITH RECURSIVE e AS ({PLACES}), w AS (SELECT src AS a, tgt AS b FROM e UNION SELECT tgt, src FROM e),
r(node, hops) AS (SELECT 's1', 0 UNION SELECT b, hops + 1 FROM r JOIN w ON a = node WHERE hops < 3) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1""")
def three_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reached(_places(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 3)


@query(f"SELECT e.src || '>' || e.tgt AS path FROM ({PLACES}) e WHERE e.src LIKE 's%' UNION ALL SELECT e.src || '>' || e.tgt || '>' || f.tgt FROM ({PLACES}) e JOIN ({PLACES}) f ON e.tgt = f.src WHERE e.src LIKE 's%'")
def supplier_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _places(spark, sf_dir)
    start = edges.where("src LIKE 's%'").select(F.col("src").alias("node")).distinct()
    return G.paths(edges, start, 2).select(F.array_join("path", ">").alias("path"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upserted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return G.upserted(old, old.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("new")), "c_custkey")


@query("SELECT c_nationkey AS nation, c_custkey AS customer, c_acctbal AS score FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def best_customer_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("score"))
    return G.best(rows, "nation", "customer")


NEAR = """SELECT e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    """Embeddings as nodes, named and mentioned by their label; vector 0 asks."""
    rows = table(spark, sf_dir, "embeddings")
    question = rows.where("vec_id = 0").select("embedding").first()
    label = F.col("label").cast("string")
    nodes = rows.select("vec_id", F.concat(F.lit("Node "), label).alias("name"), F.array(label).alias("document_ids"), F.array("vec_id").alias("chunk_ids"), "embedding")
    return nodes, list(question.embedding) if question else []


@query(f"SELECT vec_id FROM ({NEAR}) WHERE score >= 0.1 AND label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 15")
def near_readable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes near a question that readable documents mention."""
    nodes, question = _nodes(spark, sf_dir)
    acl = spark.createDataFrame([("1",), ("2",), ("3",)], "document_id string")
    return G.similar_nodes(nodes, question, 15, "vec_id", 0.1, acl).select("vec_id")


@query(f"SELECT vec_id FROM ({NEAR}) WHERE score >= 0.1 AND label IN (5, 6) ORDER BY score DESC, vec_id LIMIT 15")
def near_nodes_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, question = _nodes(spark, sf_dir)
    return G.similar_nodes(nodes, question, 15, "vec_id", 0.1, sources=["5", "6"]).select("vec_id")


@query(f"""WITH n AS (SELECT vec_id, score FROM ({NEAR}) WHERE score >= 0.3 ORDER BY score DESC, vec_id LIMIT 20), t AS (SELECT vec_id, 0.5 AS score FROM embeddings WHERE label = 7 AND vec_id NOT IN (SELECT vec_id FROM n))
SELECT vec_id FROM (SELECT * FROM n UNION ALL SELECT * FROM t) ORDER BY score DESC, vec_id LIMIT 20""")
def near_or_named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes near a question, and those whose name holds a text."""
    nodes, question = _nodes(spark, sf_dir)
    return G.hybrid_nodes(nodes, question, "node 7", 20, "vec_id", 0.3).select("vec_id")


@query(f"SELECT vec_id AS chunk_id FROM ({NEAR}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def chunks_of_near_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, question = _nodes(spark, sf_dir)
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return G.local_retrieval(nodes, chunks, question, 10, "vec_id", least=0.1)[1]


@query(f"SELECT vec_id, 'Node ' || CAST(label AS VARCHAR) AS src_name, 'Node ' || CAST((label + 1) % 10 AS VARCHAR) AS tgt_name FROM ({NEAR}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def near_edges_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges near a question, with the names of their ends."""
    nodes, question = _nodes(spark, sf_dir)
    edges = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("src"), ((F.col("label") + 1) % 10).alias("tgt"), "embedding")
    labels = spark.range(10).select(F.col("id").cast("int").alias("label"), F.concat(F.lit("Node "), F.col("id").cast("string")).alias("name"))
    return G.global_retrieval(edges, labels, question, 10, "vec_id", "label", least=0.1).select("vec_id", "src_name", "tgt_name")


@query(f"""WITH n AS (SELECT vec_id, label FROM ({NEAR}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 5)
SELECT vec_id AS node, 0 AS hops FROM n UNION ALL SELECT DISTINCT -1 - CAST(label AS BIGINT), 1 FROM n""")
def near_nodes_and_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes near a question, and what is one hop from them: every vector is linked to its label."""
    nodes, question = _nodes(spark, sf_dir)
    edges = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), (-1 - F.col("label").cast("long")).alias("tgt"))
    return G.hybrid_retrieval(nodes, edges, question, 5, "vec_id", least=0.1)


@query("""SELECT conv_id, CAST(turn // 3 AS INTEGER) AS batch, CAST(count(*) AS INTEGER) AS chunks, string_agg(left(text, 4000), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2""")
def turns_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3)
