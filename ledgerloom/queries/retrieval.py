"""Queries of vector retrieval: embeddings stand for chunks, their labels for documents, vector 0 for the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as R
from ledgerloom.registry import query
from ledgerloom.tables import table

SCORES = """SELECT e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    question = chunks.where("vec_id = 0").select("embedding").first()
    return R.scored(chunks, question.embedding if question else [])


@query(f"SELECT vec_id, label, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM ({SCORES}) ORDER BY score DESC, vec_id LIMIT 18")
def nearest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.top(_scores(spark, sf_dir), R.TAKE, "vec_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "label"))).alias("rows"))
    return found.select(F.posexplode("rows").alias("pos", "r")).select("r.vec_id", "r.label", (F.col("pos") + 1).cast("long").alias("place"))


@query(f"SELECT vec_id, label FROM ({SCORES}) QUALIFY score >= 0.5 * max(score) OVER (PARTITION BY label)")
def chunks_near_the_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.near_best(_scores(spark, sf_dir), ["label"]).select("vec_id", "label")


@query(f"SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM ({SCORES}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 2")
def quota_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _ = R.shares(R.TAKE, 10)
    return R.quota(_scores(spark, sf_dir), "label", "vec_id", n).select("vec_id", "label", "place")


@query(f"SELECT vec_id, label FROM ({SCORES}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1")
def best_chunk_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_of_each(_scores(spark, sf_dir), "label", "vec_id").select("vec_id", "label")


@query()
def varied_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score balanced with variety; each choice depends on those before it."""
    return R.varied(_scores(spark, sf_dir), "label", "vec_id", k=5).select("vec_id", "label", "place")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 1 ELSE 2 END, turn DESC) AS place FROM conversations),
f(conv_id, place, used, turn, tokens, taken) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT t.conv_id, t.place, CASE WHEN used + t.tokens <= 200 THEN used + t.tokens ELSE used END, t.turn, t.tokens, used + t.tokens <= 200 FROM f JOIN t ON t.conv_id = f.conv_id AND t.place = f.place + 1)
SELECT conv_id, turn, CAST(tokens AS INTEGER) AS tokens FROM f WHERE taken""")
def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation that fit a budget of tokens, users' first, later turns before earlier ones."""
    turns = table(spark, sf_dir, "conversations").withColumn("score", F.col("turn").cast("double")).withColumn("priority", F.when(F.col("role") == "user", 1).otherwise(2))
    return R.packed(turns, "conv_id", "turn", "text", 200)


@query(f"SELECT vec_id, label, CASE WHEN score >= 0.05 THEN 'vector' ELSE 'fields' END AS origin FROM ({SCORES})")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two searches, each once, from the first that has it: one by meaning from a score on, one by fields over all rows."""
    rows = _scores(spark, sf_dir).select("vec_id", "label", "score")
    first = rows.where("score >= 0.05").withColumn("origin", F.lit("vector"))
    second = rows.withColumn("score", F.lit(0.7)).withColumn("origin", F.lit("fields"))
    return R.merged([first, second], "vec_id").select("vec_id", "label", "origin")


@query("""WITH c AS (SELECT vec_id AS entry_id, label, embedding FROM embeddings), q AS (SELECT vec_id AS question_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0)
SELECT question_id, entry_id FROM (SELECT question_id, entry_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM q JOIN c ON q.label = c.label WHERE q.label <> 4)
WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entry_id) = 1""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is an entry; the questions are the rows whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").withColumn("workspace_id", F.col("label")).withColumn("intent", F.lit("definition"))
    entries = rows.select(
        F.col("vec_id").alias("entry_id"), "workspace_id", "intent", "embedding", F.array("label", F.col("label") + 1).alias("source_ids"), F.lit("2030-01-01").cast("timestamp").alias("expires_at"), F.lit(True).alias("is_valid"),
    )
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "workspace_id", "intent", "embedding", F.when(F.col("label") == 4, F.array("label")).otherwise(F.array("label", F.col("label") + 1)).alias("allowed"))
    return R.cache_hits(asked, entries, F.lit("2026-01-01").cast("timestamp")).select("question_id", "entry_id")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cached answers: of their nation, made of two segments, some expired, some no longer valid."""
    c = F.col
    return table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("entry_id"), c("c_nationkey").alias("workspace_id"), F.concat(F.lit(" Name "), "c_name").alias("question"), F.array("c_mktsegment").alias("source_ids"), (c("c_acctbal") > 0).alias("is_valid"),
        F.when(c("c_acctbal") > 8000, F.lit("2025-01-01")).otherwise(F.lit("2030-01-01")).cast("timestamp").alias("expires_at"),
    )


NOW = "2026-01-01"


@query("SELECT c_custkey AS entry_id, c_acctbal > 0 AND NOT (c_mktsegment = 'BUILDING' AND c_nationkey = 3) AND NOT (c_name = 'Customer#000000012') AS is_valid FROM customer")
def invalidated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one workspace the answers made of a document, and everywhere those to a question, are no longer valid."""
    cache = R.invalidated(_cache(spark, sf_dir), workspace=3, document="BUILDING")
    return R.invalidated(cache, question="name customer#000000012 ").select("entry_id", "is_valid")


@query("SELECT c_custkey AS entry_id FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 8000")
def swept_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.swept(_cache(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("entry_id")


@query("SELECT c_nationkey AS workspace_id, count(*) AS entries, count(*) FILTER (WHERE c_acctbal > 0 AND c_acctbal <= 8000) AS valid, count(*) FILTER (WHERE c_acctbal > 8000) AS expired FROM customer GROUP BY 1")
def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cache_statistics(_cache(spark, sf_dir), F.lit(NOW).cast("timestamp"))


def _hybrid_sql(strategy: str) -> str:
    near = f"SELECT vec_id, 'vector' AS origin FROM ({SCORES}) WHERE score >= 0.2"
    told = "SELECT vec_id, 'sql' AS origin FROM embeddings WHERE label = 7"
    enough = f"EXISTS (SELECT 1 FROM ({SCORES}) WHERE score >= 0.7)"
    return {
        "vector_first": f"{near} UNION ALL {told} AND NOT {enough}", "sql_first": f"{near} AND NOT EXISTS (SELECT 1 FROM embeddings WHERE label = 7) UNION ALL {told}", "parallel": f"{near} UNION ALL {told}",
    }[strategy]


def _hybrid(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("vec_id", "label", "score")
    return R.hybrid(rows.where("score >= 0.2"), rows.where("label = 7"), strategy, "vec_id").select("vec_id", "origin")


@query(_hybrid_sql("vector_first"))
def hits_by_meaning_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "vector_first")


@query(_hybrid_sql("sql_first"))
def hits_by_fields_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "sql_first")


@query(_hybrid_sql("parallel"))
def hits_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "parallel")
