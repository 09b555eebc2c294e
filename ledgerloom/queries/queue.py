"""Queries of the queue beyond claims and states: orders stand for documents, their lines for chunks or tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import queue as Q
from ledgerloom.registry import query
from ledgerloom.tables import table

STATES = "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'pending' END"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as tasks: their state follows from the flag, their phase from the status, their age from the day of shipping."""
    c = F.col
    status = F.when(c("l_returnflag") == "A", "completed").when(c("l_returnflag") == "R", "failed").otherwise("pending")
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("document_id"), c("l_partkey").alias("task_id"), status.alias("status"), F.when(c("l_linestatus") == "F", "reindex").otherwise("graph").alias("phase"), (c("l_linenumber") - 1).alias("retries"),
        c("l_shipdate").alias("created_at"), (c("l_quantity") > 40).alias("skip"), F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").alias("key"),
    )


@query("""SELECT DISTINCT l_orderkey AS page_id, l_linenumber AS chunk_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND NOT (l_linenumber = 1)""")
def new_chunk_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of completed pages; the first of each has a task already."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("processing").alias("status"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("chunk_id"))
    return Q.chunk_tasks(pages, chunks, chunks.where("chunk_id = 1")).select("page_id", "chunk_id")


CLAIMABLE = f"SELECT *, {STATES} AS status FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') OR (l_returnflag = 'R' AND l_linenumber - 1 < 3)"
NEXT = "ORDER BY CASE status WHEN 'failed' THEN 0 ELSE 1 END, l_linenumber, l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice LIMIT 25"


@query(f"SELECT l_orderkey AS document_id, l_partkey AS task_id FROM ({CLAIMABLE}) WHERE l_quantity <= 40 {NEXT}")
def next_graph_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next tasks that are not to be skipped."""
    return Q.skipped_or_claimed(_tasks(spark, sf_dir), 25, "key", "skip")[1].select("document_id", "task_id")


@query(f"SELECT l_orderkey AS document_id, count(*) AS n FROM ({CLAIMABLE}) WHERE l_quantity > 40 GROUP BY 1")
def skipped_graph_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks of each document are skipped."""
    return Q.skipped_or_claimed(_tasks(spark, sf_dir), 25, "key", "skip")[0].groupBy("document_id").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey AS document_id, l_partkey AS task_id FROM ({CLAIMABLE}) WHERE l_linestatus = 'F' {NEXT}")
def next_reindexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.reindexing(_tasks(spark, sf_dir), 25, "key").select("document_id", "task_id")


@query("""SELECT l_orderkey AS document_id, CASE l_linestatus WHEN 'F' THEN 'reindex' ELSE 'graph' END AS phase, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
CAST(floor(100 * count(*) FILTER (WHERE l_returnflag = 'A') / count(*)) AS INTEGER) AS percent FROM lineitem GROUP BY 1, 2""")
def indexing_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's details, with a row for each phase."""
    found = Q.details(_tasks(spark, sf_dir)).select("document_id", F.explode("details").alias("phase", "d"))
    return found.select("document_id", "phase", "d.total", "d.failed", "d.percent")


@query("""SELECT l_orderkey AS document_id, coalesce(CAST(sum(CASE WHEN l_quantity > 5 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT), 0) AS entities, CAST(sum(l_linenumber) AS BIGINT) AS relationships,
count(*) FILTER (WHERE l_returnflag = 'A') AS completed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1""")
def extracted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    counts = [F.when(c("l_quantity") > 5, c("l_quantity").cast("long")).alias("entities"), c("l_linenumber").cast("long").alias("relationships")]
    status = F.when(c("l_returnflag") == "A", "completed").when(c("l_returnflag") == "R", "failed").otherwise("pending")
    return Q.extracted(table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("document_id"), status.alias("status"), *counts))


SESSIONS = "SELECT user_id AS session_id, min(ts) + INTERVAL 1 HOUR AS expires_at, max(ts) + INTERVAL 30 MINUTE AS later FROM events GROUP BY 1"


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), "event_type")
    sessions = events.groupBy("session_id").agg((F.min("at") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"), F.when(F.max("at") > F.lit("2024-01-20").cast("timestamp_ntz"), "executing").otherwise("completed").alias("state"))
    return sessions, events


@query(f"SELECT session_id, greatest(expires_at, later) AS expires_at FROM ({SESSIONS})")
def extended_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, touches = _sessions(spark, sf_dir)
    return Q.extended(sessions, touches, 1800).select("session_id", "expires_at")


@query(f"SELECT session_id FROM ({SESSIONS}) WHERE greatest(expires_at, later) > TIMESTAMP '2024-01-25' AND later > TIMESTAMP '2024-01-20 00:30:00'")
def recoverable_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, touches = _sessions(spark, sf_dir)
    return Q.recoverable(Q.extended(sessions, touches, 1800), F.lit("2024-01-25").cast("timestamp_ntz")).select("session_id")


@query("SELECT conv_id, max(turn) AS current_step, string_agg(role || CAST(length(text) AS VARCHAR), ',' ORDER BY turn) AS steps FROM conversations GROUP BY 1")
def session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat("role", F.length("text").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", value.alias("result"), F.col("turn").alias("at"))
    return Q.appended(rows, "conv_id", "turn", "result").select("conv_id", "current_step", F.array_join("steps", ",").alias("steps"))


@query("SELECT c_custkey AS task_id, CASE WHEN c_acctbal > 5000 THEN 'new' ELSE c_mktsegment END AS result FROM customer")
def merged_task_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of tasks, those done again in place of the old."""
    rows = table(spark, sf_dir, "customer")
    old = rows.select(F.col("c_custkey").alias("task_id"), F.col("c_nationkey").alias("seq"), F.col("c_mktsegment").alias("result"))
    new = rows.where("c_acctbal > 5000").select(F.col("c_custkey").alias("task_id"), F.col("c_nationkey").alias("seq"), F.lit("new").alias("result"))
    return Q.merged_outputs(old, new, "task_id", "seq").select("task_id", "result")


@query("""SELECT count(*) AS tasks, count(*) FILTER (WHERE l_returnflag = 'A') AS completed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) FILTER (WHERE l_returnflag = 'A') / count(*) AS rate,
(SELECT count(DISTINCT d) FROM (SELECT l_orderkey AS d FROM lineitem UNION SELECT l_partkey FROM lineitem)) AS documents FROM lineitem""")
def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir).select("status", F.array("document_id", "task_id").alias("document_ids"))
    return Q.outcome(rows)
