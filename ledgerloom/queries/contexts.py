"""Queries of contexts within a budget, of what answers are worth, of the size of results, and of records that replace one another in a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rewards import answer_reward
from ledgerloom.functions.scoring import cosine
from ledgerloom.operators import contexts as X
from ledgerloom.operators import stored_records as S
from ledgerloom.registry import query
from ledgerloom.session import durable
from ledgerloom.tables import table


def _packed(name: str, test: str, budget: int) -> str:
    return f"""{name}_t AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE text IS NOT NULL AND {test}),
{name}(conv_id, place, used, turn, tokens, taken) AS (SELECT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false FROM (SELECT DISTINCT conv_id FROM {name}_t)
UNION ALL SELECT t.conv_id, t.place, CASE WHEN used + t.tokens <= {budget} THEN used + t.tokens ELSE used END, t.turn, t.tokens, used + t.tokens <= {budget} FROM {name} f JOIN {name}_t t ON t.conv_id = f.conv_id AND t.place = f.place + 1)"""


@query(f"""WITH RECURSIVE {_packed('c', "role = 'user'", 180)}, {_packed('p', "role = 'assistant'", 75)},
g AS (SELECT conv_id, CASE WHEN length(t) // 4 > 45 THEN left(t, 180) || '...' ELSE t END AS t FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY 1))
SELECT conv_id, 'chunk' AS section, turn, CAST(tokens AS INTEGER) AS tokens FROM c WHERE taken UNION ALL SELECT conv_id, 'parent', turn, CAST(tokens AS INTEGER) FROM p WHERE taken
UNION ALL SELECT conv_id, 'graph', NULL, CAST(length(t) // 4 AS INTEGER) FROM g""")
def built_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each conversation: its users' turns as chunks, its assistants' as parents, its first turn as what the graph tells."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("score", F.col("turn").cast("double")).withColumn("priority", F.lit(1))
    told = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    built = X.contexts(turns.where("role = 'user'"), turns.where("role = 'assistant'"), told, "conv_id", "turn", "text", 300)
    return built.select("conv_id", "section", "turn", "tokens")


@query("""SELECT label, arg_max(vec_id, {'s': score, 'v': -vec_id}) AS chunk_id FROM (SELECT e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 2 = 0 AND e.label <> 3 ORDER BY score DESC, vec_id LIMIT 30) WHERE score >= 0.05 GROUP BY 1""")
def documents_by_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose summary, which every second chunk is, is nearest to a question, among those that may be read."""
    rows = table(spark, sf_dir, "embeddings")
    question = rows.where("vec_id = 0").select("embedding").first()
    score = cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in (question.embedding if question else []))))
    chunks = rows.select(F.col("vec_id").alias("chunk_id"), "label", score.alias("score"), F.when(F.col("vec_id") % 2 == 0, X.SUMMARY).otherwise("text").alias("chunk_type"))
    acl = rows.where("label <> 3").select("label").distinct()
    return X.documents_by_summary(chunks, 30, 0.05, acl, document="label").select("label", "chunk_id")


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _count(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INTEGER" for w in words) + ")"


@query(f"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(lower(text), '[^\\x00-\\x7F]', ' ', 'g') AS a, regexp_replace(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '')), '[^\\x00-\\x7F]', ' ', 'g') AS q FROM conversations WHERE text IS NOT NULL),
w AS (SELECT *, list_distinct(regexp_extract_all(a, '\\w+')) AS words, list_filter(list_distinct(regexp_extract_all(q, '\\w+')), lambda x: NOT list_contains(['what', 'is', 'the', 'a', 'an', 'how', 'why', 'when', 'where', 'who', 'which', 'are', 'do', 'does'], x)) AS asked FROM t)
SELECT conv_id, turn, round(CASE WHEN trim(a) = '' THEN 0 ELSE least(1.0, CASE WHEN length(trim(a)) < 20 THEN 0 WHEN length(trim(a)) < 50 THEN 0.08 WHEN length(trim(a)) <= 500 THEN 0.2 WHEN length(trim(a)) <= 1000 THEN 0.16 ELSE 0.12 END
+ CASE WHEN {_has('a', ["i don't know", "not sure", "unclear", "cannot determine", "insufficient information", "no information", "unable to answer"])} THEN 0 ELSE least(0.2, 0.08 * {_count('a', ["based on", "according to", "specifically", "in particular", "for example", "such as"])}) END
+ CASE WHEN {_count('a', ["maybe", "perhaps", "possibly", "might", "could be"])} > {_count('a', ["is", "are", "includes", "provides", "demonstrates"])} THEN 0.08 WHEN {_has('a', ["is", "are", "includes", "provides", "demonstrates"])} THEN 0.2 ELSE 0.12 END
+ CASE WHEN len(asked) = 0 THEN 0.12 ELSE least(0.2, 0.4 * len(list_intersect(asked, words)) / len(asked)) END
+ 0.2 - CASE WHEN contains(a, 'all') AND contains(a, 'some') OR contains(a, 'always') AND contains(a, 'sometimes') OR contains(a, 'never') AND contains(a, 'occasionally') OR contains(a, 'complete') AND contains(a, 'incomplete') OR contains(a, 'total') AND contains(a, 'partial') THEN 0.05 ELSE 0 END) END, 6)::DOUBLE AS reward FROM w""")
def answer_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn is worth as an answer to the one before; the turns hold no lists and no counts, so nothing but words counts."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\x00-\x7F]", " ")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("q", plain(before)).withColumn("a", plain("text"))
    return turns.select("conv_id", "turn", F.round(answer_reward(F.col("a"), F.col("q")), 6).alias("reward"))


@query("""SELECT count(*) AS row_count, CAST(3 AS INTEGER) AS column_count, CAST((sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + length(c_mktsegment) + 11) + 58) // 4 + 500 AS BIGINT) AS estimated_tokens,
count(*) > 40 OR (sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + length(c_mktsegment) + 11) + 58) // 4 + 500 > 80000 AS exceeds_limit FROM customer""")
def size_of_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a list of customers is too long for a model."""
    return X.size_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("""SELECT l_orderkey AS document_id, count(*) AS lines, CAST(sum(CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE l_quantity END) AS DOUBLE) AS quantity FROM lineitem
WHERE l_orderkey % 10 <> 7 AND (l_orderkey % 4 <> 0 OR l_linenumber < 3) AND l_orderkey % 12 <> 0 GROUP BY 1""")
def replaced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in a folder of parts: those of some records are replaced by others, or by none, and those of some deleted."""
    base = durable(spark.range(1)).sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{base}/items-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_number"), F.col("l_quantity").alias("quantity"))
    S.stored(lines, folder, "document_id", 16)
    again = lines.where("document_id % 4 = 0")
    S.replaced(folder, again.where("line_number < 3 AND document_id % 3 <> 0").withColumn("quantity", F.lit(1.0)), "document_id", 16, of=again)
    S.deleted(folder, lines.where("document_id % 10 = 7").select("document_id"), "document_id", 16)
    return S.read(spark, folder).groupBy("document_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))
