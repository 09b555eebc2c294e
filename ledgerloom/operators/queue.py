"""The processing queue as a table of tasks: creation, claims, progress, stale tasks, and what a document's status follows from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States in their order, which is not the alphabet's; seconds after which a silent task is stale; tries of a task; phases by urgency.
STATES = ("pending", "processing", "completed", "failed", "skipped")
STALE_SECONDS, RETRIES = 120, 3
PHASES = ("reindex", "graph", "vector", "ocr")


def state_rank(state: Column) -> Column:
    """The place of a state in its order, from 1; 0 for an unknown one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(0)).cast("int")


def page_tasks(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A pending task for each page of documents (document_id, pages); those that exist already are left out, so that a repeat adds nothing."""
    pages = documents.where("pages > 0").select("document_id", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))
    if existing is not None:
        pages = pages.join(existing, ["document_id", "page"], "left_anti")
    return pages.withColumn("status", F.lit("pending")).withColumn("retries", F.lit(0))


def claimable(tasks: DataFrame, retries: int = RETRIES) -> DataFrame:
    """Tasks that a worker may take: pending, or failed with tries left."""
    return tasks.where((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retries") < retries)))


def claimed(tasks: DataFrame, n: int, key: str, retries: int = RETRIES) -> DataFrame:
    """The next n tasks: failed ones first, then fewest tries, then oldest."""
    return claimable(tasks, retries).orderBy(state_rank(F.col("status")).desc(), "retries", "created_at", key).limit(n)


def ready(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunk tasks whose page is completed."""
    return chunks.join(pages.where("status = 'completed'").select("page_id"), "page_id", "left_semi")


def urgency(phase: Column) -> Column:
    """1 for the phase that workers serve first."""
    return F.array_position(F.array(*map(F.lit, PHASES)), phase).cast("int")


def folded(events: DataFrame, key: str, at: Sequence[str], state: str) -> DataFrame:
    """(key, status, retries, heartbeat, events): the state of each task after all its events; retries counts failures, heartbeat is the last event.

    Counts and maxima are all that is kept, so each task of Spark's brings one row for each key.
    """
    return events.groupBy(key).agg(
        F.max_by(state, F.struct(*at)).alias("status"), F.count_if(F.col(state) == "failed").alias("retries"), F.max(at[0]).alias("heartbeat"), F.count("*").alias("events"),
    )


def stale(tasks: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> Column:
    """Whether a task is being processed without a sign of life for too long."""
    return (F.col("status") == "processing") & (F.col("heartbeat").isNull() | (F.col("heartbeat") < now - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))))


def released(tasks: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Tasks with the stale ones pending again, one try more."""
    old = stale(tasks, now, seconds)
    return tasks.withColumns({"status": F.when(old, "pending").otherwise(F.col("status")), "retries": F.col("retries") + F.when(old, 1).otherwise(0)})


def bubbled(tasks: DataFrame, by: str) -> DataFrame:
    """(by, status, counts of states): processing if any task is, else pending if any is, else completed if all are done, else failed."""
    counts = tasks.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATES))
    status = (
        F.when(F.col("processing") > 0, "processing").when(F.col("pending") > 0, "pending")
        .when(F.col("completed") + F.col("skipped") == F.col("total"), "completed").when(F.col("failed") > 0, "failed").otherwise("pending")
    )
    return counts.withColumn("status", status)


def statistics(tasks: DataFrame, phases: Sequence[str] = PHASES[1:]) -> DataFrame:
    """(phase, state counts) of every phase, also of one without tasks, but for reindexing; a state without any counts zero. Phases that aren't among the given ones are counted as well."""
    counts = tasks.groupBy("phase").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATES))
    empty = tasks.sparkSession.createDataFrame([(p,) for p in phases], "phase string").join(counts.select("phase"), "phase", "left_anti")
    return counts.unionByName(empty.select("phase", *(F.lit(0).cast("long").alias(s) for s in STATES)))


def progress(done: Column, total: Column) -> Column:
    """Whole percents that are done; 0 of nothing."""
    return F.floor(100 * done / F.greatest(total, F.lit(1))).cast("int")


def finished(tasks: DataFrame, by: str) -> DataFrame:
    """Tasks of documents that are not completed yet: what a clean-up leaves."""
    return tasks.join(bubbled(tasks, by).where("status = 'completed'").select(by), by, "left_anti")


def missing(planned: DataFrame, outputs: DataFrame, key: str = "task_id") -> DataFrame:
    """Planned tasks without an output."""
    return planned.join(outputs.select(key), key, "left_anti")


def versioned(plans: DataFrame, session: str, at: str) -> DataFrame:
    """(session, state, version): the last state of a session and how many it has had."""
    return plans.groupBy(session).agg(F.max_by("state", at).alias("state"), F.count("*").alias("version"))


def chunk_tasks(pages: DataFrame, chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A pending task for each chunk (page_id, chunk_id) of a completed page; those that exist already are left out."""
    rows = ready(chunks, pages).select("page_id", "chunk_id").distinct()
    if existing is not None:
        rows = rows.join(existing, ["page_id", "chunk_id"], "left_anti")
    return rows.withColumn("status", F.lit("pending")).withColumn("retries", F.lit(0))


def skipped_or_claimed(tasks: DataFrame, n: int, key: str, skip: str, retries: int = RETRIES) -> tuple[DataFrame, DataFrame]:
    """All claimable tasks that are to be skipped, and the next n of the others."""
    test = F.coalesce(F.col(skip), F.lit(False))
    return claimable(tasks, retries).where(test), claimed(tasks.where(~test), n, key, retries)


def reindexing(tasks: DataFrame, n: int, key: str, retries: int = RETRIES) -> DataFrame:
    """The next n tasks of the phase that is done over."""
    return claimed(tasks.where(F.col("phase") == PHASES[0]), n, key, retries)


def details(tasks: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, details): for each phase of a document its counts of states and its percents done, as a map from the phase. A document has few phases."""
    counts = tasks.groupBy(by, "phase").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATES))
    done = progress(F.col("completed") + F.col("skipped"), F.col("total"))
    one = F.struct("phase", F.struct("total", *STATES, done.alias("percent")).alias("counts"))
    return counts.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(one))).alias("details"))


def extracted(chunks: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, entities, relationships, completed, failed): totals of a document's chunks, with the number of those done and failed; nulls count zero."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return chunks.groupBy(by).agg(total("entities"), total("relationships"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def extended(sessions: DataFrame, touches: DataFrame, seconds: int, key: str = "session_id") -> DataFrame:
    """sessions with expires_at so many seconds after their last touch (session_id, at), where that is later."""
    last = touches.groupBy(key).agg(F.max("at").alias("last"))
    later = F.col("last") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return sessions.join(last, key, "left").withColumn("expires_at", F.greatest("expires_at", later)).drop("last")


def recoverable(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that are not past their time and not ended."""
    return sessions.where((F.col("expires_at") > now) & ~F.col("state").isin("completed", "failed"))


def appended(steps: DataFrame, session: str, step: str, value: str) -> DataFrame:
    """(session, current_step, steps): the results of a session's steps in order, of a repeated step the last one by `at`. A session has few steps."""
    last = steps.groupBy(session, step).agg(F.max_by(value, "at").alias("value"))
    return last.groupBy(session).agg(F.max(step).alias("current_step"), F.transform(F.sort_array(F.collect_list(F.struct(F.col(step).alias("n"), "value"))), lambda x: x["value"]).alias("steps"))


def merged_outputs(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One output of each task, its last one, with `place`: where the task came first."""
    rows = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    rest = [c for c in old.columns if c not in (key, order)]
    at = F.struct("turn", order)
    return rows.groupBy(key).agg(F.min(at).alias("place"), *(F.max_by(c, at).alias(c) for c in rest))


def outcome(outputs: DataFrame) -> DataFrame:
    """(tasks, completed, failed, rate, documents): outputs by status, the share that succeeded, and the number of distinct documents."""
    done = F.count_if(F.col("status") == "completed")
    documents = outputs.select(F.explode("document_ids").alias("d")).agg(F.count_distinct("d").alias("documents"))
    rate = F.coalesce(done / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    counts = outputs.agg(F.count("*").alias("tasks"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), rate.alias("rate"))
    return counts.withColumn("one", F.lit(1)).join(documents.withColumn("one", F.lit(1)), "one").drop("one")
