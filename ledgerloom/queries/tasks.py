"""Queries of the processing queue and of conversations: a user's events are a task's, by their type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import queue as Q
from ledgerloom.operators.analytics import ranked_once
from ledgerloom.registry import query
from ledgerloom.streaming.tasks import sessions, windowed
from ledgerloom.tables import table

STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
FOLDED = f"SELECT user_id AS task_id, arg_max(status, (ts, event_id)) AS status, count(*) FILTER (WHERE status = 'failed') AS retries, max(ts) AS heartbeat, count(*) AS events FROM (SELECT *, {STATUS} AS status FROM events) GROUP BY 1"
NOW = "TIMESTAMP '2024-01-30 23:00:00'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind.isin("click", "view"), "processing").when(kind == "purchase", "completed").otherwise("failed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", "ts", status.alias("status"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.folded(_events(spark, sf_dir), "task_id", ["ts", "event_id"], "status")


@query(FOLDED)
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir)


@query(f"SELECT task_id, CASE WHEN status = 'processing' AND heartbeat < {NOW} - INTERVAL 120 SECOND THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' AND heartbeat < {NOW} - INTERVAL 120 SECOND THEN retries + 1 ELSE retries END AS retries FROM ({FOLDED})")
def released_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.released(_tasks(spark, sf_dir), F.lit("2024-01-30 23:00:00").cast("timestamp")).select("task_id", "status", "retries")


@query(f"""SELECT task_id, status, retries FROM ({FOLDED}) WHERE status = 'pending' OR (status = 'failed' AND retries < 1000)
ORDER BY CASE status WHEN 'failed' THEN 4 ELSE 1 END DESC, retries, heartbeat, task_id LIMIT 10""")
def next_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.claimed(_tasks(spark, sf_dir).withColumn("created_at", F.col("heartbeat")), 10, "task_id", retries=1000).select("task_id", "status", "retries")


@query(f"""WITH t AS (SELECT task_id % 20 AS document_id, status FROM ({FOLDED})), c AS (SELECT document_id, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM t GROUP BY 1)
SELECT *, CASE WHEN processing > 0 THEN 'processing' WHEN pending > 0 THEN 'pending' WHEN completed + skipped = total THEN 'completed' WHEN failed > 0 THEN 'failed' ELSE 'pending' END AS status FROM c""")
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bubbled(_tasks(spark, sf_dir).withColumn("document_id", F.col("task_id") % 20), "document_id")


@query(f"""SELECT phase, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'completed') AS completed,
count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM (SELECT CASE task_id % 2 WHEN 0 THEN 'ocr' ELSE 'vector' END AS phase, status FROM ({FOLDED})) GROUP BY 1 UNION ALL SELECT 'graph', 0, 0, 0, 0, 0""")
def queue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.statistics(_tasks(spark, sf_dir).withColumn("phase", F.when(F.col("task_id") % 2 == 0, "ocr").otherwise("vector")))


@query("SELECT c_custkey AS document_id, CAST(page AS INTEGER) AS page FROM (SELECT c_custkey, unnest(range(c_custkey % 4)) AS page FROM customer) WHERE NOT (c_custkey % 3 = 0 AND page = 0)")
def new_page_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 4).cast("int").alias("pages"))
    existing = documents.where("document_id % 3 = 0").select("document_id", F.lit(0).alias("page"))
    return Q.page_tasks(documents, existing).select("document_id", "page")


@query("SELECT o_orderkey AS task_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def tasks_without_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"))
    return Q.missing(planned, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id")))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("place", place).where("place <= 3").select("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn")


@query("SELECT c_custkey AS conv_id, count(turn) AS messages FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY 1")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero for conversations without messages."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id")).join(counts, "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return ranked_once(answers.select("conv_id", "turn"), ["conv_id"], [F.desc("turn")])


@query("SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) u ON u.conv_id = c.conv_id WHERE c.turn < t")
def without_last_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations after their last question and all behind it are deleted."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return turns.join(last, "conv_id").where("turn < last").select("conv_id", "turn")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts in windows of time."""
    return windowed(table(spark, sf_dir, "events"), "ts", "1 day", "1 hour", ("event_type",))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: runs of events without a gap of six hours."""
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "1 hour")
