"""Vector retrieval: scores, quotas, diversity, budgets, and the cache of answered questions.

Candidates for variety are cut to `fetch` for each query or document by a window before anything needs them together, so no task holds more; packing needs no cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scoring import cosine, tokens
from ledgerloom.operators.analytics import ranked_once
from ledgerloom.operators.nearest import nearest

# Defaults of searches, shares of a context, and thresholds and lives (seconds) of cached answers by kind of question.
TAKE, FETCH, BALANCE = 18, 50, 0.5
RELATIVE = 0.5
CONTEXT_TOKENS, SHARES = 6000, {"chunk": 0.60, "parent": 0.25, "graph": 0.15}
CACHE_LEAST = {"factual": 0.92, "analytics": 0.90, "summary": 0.88, "definition": 0.85, "default": 0.90}
CACHE_SECONDS = {"factual": 7 * 86400, "analytics": 3600, "summary": 86400, "definition": 30 * 86400, "default": 86400}
FEEDBACK, LEAST_CONFIDENCE, MOST_COMPLAINTS = 0.25, 0.5, 3
# The score from which a search by meaning is enough, and that of a hit by fields.
ENOUGH, FIELD_SCORE = 0.7, 0.7


def scored(chunks: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """chunks with their cosine to the query as `score`."""
    return chunks.withColumn("score", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))


def top(chunks: DataFrame, k: int, key: str, least: float | None = None) -> DataFrame:
    """The k highest scores, ties by key; below `least` none."""
    rows = chunks if least is None else chunks.where(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), key).limit(k)


def near_best(scores: DataFrame, by: Sequence[str], ratio: float = RELATIVE) -> DataFrame:
    """Rows of at least `ratio` times the best score of their group; the best are joined back, so a group is not gathered."""
    best = scores.groupBy(*by).agg(F.max("score").alias("best"))
    return scores.join(best, list(by)).where(F.col("score") >= ratio * F.col("best")).drop("best")


def routed(scores: DataFrame, by: Sequence[str], least: float = 0.3, ratio: float = 0.25, gap: float = 12.0) -> DataFrame:
    """Documents of at least a score, of a share of the best, and no farther from it than a gap."""
    best = scores.groupBy(*by).agg(F.max("score").alias("best"))
    kept = (F.col("score") >= least) & (F.col("score") >= ratio * F.col("best")) & (F.col("best") - F.col("score") <= gap)
    return scores.join(best, list(by)).where(kept).drop("best")


def best_of_each(rows: DataFrame, document: str, key: str) -> DataFrame:
    """The best-scored row of each document."""
    return ranked_once(rows, [document], [F.desc("score"), F.col(key)])


def quota(rows: DataFrame, document: str, key: str, n: int) -> DataFrame:
    """The n best-scored rows of each document, with their place."""
    place = F.row_number().over(Window.partitionBy(document).orderBy(F.desc("score"), key))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def shares(k: int, documents: int, fetch: int = FETCH) -> tuple[int, int]:
    """How many chunks of each document are taken, and out of how many."""
    n = max(1, documents)
    return max(2, k // n), max(10, fetch // n)


def diverse(vectors: np.ndarray, scores: np.ndarray, k: int, balance: float = BALANCE) -> list[int]:
    """Places of k rows, taken one by one: each has the best balance of its score and its greatest likeness to those taken."""
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    taken: list[int] = []
    like = np.full(len(scores), -np.inf)
    left = np.ones(len(scores), bool)
    while left.any() and len(taken) < k:
        value = balance * scores - (1 - balance) * (like if taken else 0.0)
        best = int(np.argmax(np.where(left, value, -np.inf)))
        taken.append(best)
        left[best] = False
        like = np.maximum(like, unit @ unit[best])
    return taken


def varied(rows: DataFrame, by: str, key: str, k: int = TAKE, fetch: int = FETCH, balance: float = BALANCE, vector: str = "embedding") -> DataFrame:
    """(by, key, score, place): of each group, k of its `fetch` best rows, chosen for score and variety."""
    near = quota(rows, by, key, fetch).select(by, key, "score", vector)
    kinds = dict(near.dtypes)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", key], ascending=[False, True])
        at = diverse(np.vstack(part[vector].to_numpy()).astype(np.float64), part["score"].to_numpy(), k, balance)
        return part.iloc[at][[by, key, "score"]].assign(place=np.arange(1, len(at) + 1))

    return near.groupBy(by).applyInPandas(choose, f"{by} {kinds[by]}, {key} {kinds[key]}, score double, place long")


def priority(score: Column, importance: Column, section: Column) -> Column:
    """1 for key sections and scores from 0.85, 2 from 0.70, 3 from 0.50, else 4; without a score by importance."""
    by_score = F.when(score >= 0.85, 1).when(score >= 0.70, 2).when(score >= 0.50, 3).otherwise(4)
    by_importance = F.when(importance >= 0.8, 1).when(importance >= 0.6, 2).otherwise(3)
    return F.when(section, 1).when(score.isNotNull(), by_score).otherwise(by_importance)


def packed(rows: DataFrame, by: str, key: str, text: str, budget: int) -> DataFrame:
    """(by, key, tokens): of each group's rows, those that fit a budget of tokens, one after another by priority and score; what doesn't fit is passed over, and a later, smaller one may fit.

    What is used only grows, so once a row of some size is passed over, all later ones of this size are: of each size, the first budget / size rows are all that can be taken, and only they are gathered.
    """
    order = [F.col("priority"), F.desc("score"), F.col(key)]
    sized = rows.withColumn("tokens", tokens(F.col(text), 1)).where(F.col("tokens") <= budget)
    turn = F.row_number().over(Window.partitionBy(by, "tokens").orderBy(*order))
    near = sized.withColumn("place", turn).where(F.col("place") <= budget).where(F.col("place").cast("long") * F.col("tokens") <= budget)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    one = F.struct("place", F.col(key).alias("key"), "tokens")
    held = near.groupBy(by).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    begin = F.struct(F.lit(0).alias("used"), F.slice("rows", 1, 0).alias("taken"))
    fold = F.aggregate("rows", begin, lambda a, r: F.when(a["used"] + r["tokens"] <= budget, F.struct((a["used"] + r["tokens"]).alias("used"), F.array_append(a["taken"], r).alias("taken"))).otherwise(a))
    return held.select(by, F.explode(fold["taken"]).alias("r")).select(by, F.col("r.key").alias(key), F.col("r.tokens").alias("tokens"))


def with_parents(children: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each parent chunk of the children once."""
    wanted = children.where("parent_chunk_id IS NOT NULL").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
    return chunks.join(wanted, "chunk_id", "left_semi")


def merged(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of several lists, each key once, from the first list that has it; rows without a key all stay."""
    ranked = [df.withColumn("list", F.lit(i)) for i, df in enumerate(lists)]
    rows = ranked[0]
    for df in ranked[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    once = ranked_once(rows.where(F.col(key).isNotNull()), [key], [F.col("list"), F.desc("score")])
    return once.unionByName(rows.where(F.col(key).isNull())).drop("list")


def match_score(entities: Column, topics: Column, kinds: Column, document: dict[str, Column]) -> Column:
    """A document's score by rules: 10 for its subject among the entities or 5 within one, 3 an entity, 2 a topic, 1.5 a topic in the summary, 1 its kind; times its confidence."""
    low = lambda a: F.transform(a, F.lower)
    subject, summary = F.lower(document["subject"]), F.lower(document["summary"])
    by_subject = F.when(F.array_contains(low(entities), subject), 10.0).when(F.exists(low(entities), lambda e: subject.contains(e) | e.contains(subject)), 5.0).otherwise(0.0)
    common = lambda a, b: F.size(F.array_intersect(low(a), low(b))).cast("double")
    told = F.size(F.filter(low(topics), lambda t: summary.contains(t))) * 1.5
    kind = F.when(F.array_contains(low(kinds), F.lower(document["kind"])), 1.0).otherwise(0.0)
    total = F.coalesce(by_subject, F.lit(0.0)) + 3 * common(entities, document["entities"]) + 2 * common(topics, document["topics"]) + F.coalesce(told, F.lit(0.0)) + F.coalesce(kind, F.lit(0.0))
    return total * F.coalesce(document["confidence"], F.lit(1.0))


def cache_hits(questions: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(question_id, entry_id, score): for each question, the best entry of its workspace that is valid, not expired, of the same intent, near enough, and made of documents that the asker may read.

    questions: question_id, workspace_id, intent, embedding, allowed. cache: entry_id, workspace_id, intent, embedding, source_ids, expires_at, is_valid.
    No pair of a question and an entry is a row; see `nearest`.
    """
    least = F.lit(CACHE_LEAST["default"])
    for name, x in CACHE_LEAST.items():
        least = F.when(F.col("intent") == name, x).otherwise(least)
    entries = cache.where(F.col("is_valid") & (F.col("expires_at") > now))
    return ranked_once(nearest(questions, entries, ["workspace_id", "intent"], least), ["question_id"], [F.desc("score"), F.asc_nulls_last("entry_id")])


def expiry(intent: Column, now: Column) -> Column:
    """When an answer that is cached now expires."""
    seconds = F.lit(CACHE_SECONDS["default"])
    for name, s in CACHE_SECONDS.items():
        seconds = F.when(intent == name, s).otherwise(seconds)
    return now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def complained(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after complaints (entry_id, complaints): each takes FEEDBACK of confidence; an entry with too little of it or too many complaints is no longer valid."""
    told = entries.groupBy("entry_id").agg(F.sum("complaints").alias("more"))
    rows = cache.join(told, "entry_id", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    confidence = F.greatest(F.lit(0.0), F.col("confidence") - FEEDBACK * F.col("more"))
    complaints = F.col("complaints") + F.col("more")
    valid = F.col("is_valid") & ((F.col("more") == 0) | ((confidence >= LEAST_CONFIDENCE) & (complaints < MOST_COMPLAINTS)))
    return rows.select(*(c for c in cache.columns if c not in ("confidence", "complaints", "is_valid")), confidence.alias("confidence"), complaints.alias("complaints"), valid.alias("is_valid"))


def embedded(chunks: DataFrame, text: str, model, size: int, batch: int = 64) -> DataFrame:
    """chunks with an `embedding` of each text, by model(list of texts) -> array; batches of a task are embedded one after another, a failed one once more."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: list[list[float]] = []
            for at in range(0, len(part), batch):
                texts = part[text].iloc[at : at + batch].fillna("").tolist()
                try:
                    made = model(texts)
                except OSError:
                    made = model(texts)
                found += np.asarray(made, np.float32).reshape(len(texts), size).tolist()
            yield part.assign(embedding=found)

    return chunks.mapInPandas(run, chunks.select("*").schema.add("embedding", "array<float>"))


def invalidated(cache: DataFrame, question: str | None = None, workspace: object = None, document: object = None) -> DataFrame:
    """The cache with the entries of a question, or of a document, no longer valid; with a workspace only its own."""
    test = F.lit(True) if question is None else F.lower(F.trim("question")) == question.strip().lower()
    if document is not None:
        test = test & F.array_contains("source_ids", document)
    if workspace is not None:
        test = test & (F.col("workspace_id") == workspace)
    return cache.withColumn("is_valid", F.col("is_valid") & ~F.coalesce(test, F.lit(False)))


def swept(cache: DataFrame, now: Column) -> DataFrame:
    """The cache without entries that are past their time or no longer valid."""
    return cache.where(F.col("is_valid") & (F.col("expires_at") > now))


def cache_statistics(cache: DataFrame, now: Column) -> DataFrame:
    """(workspace_id, entries, valid, expired) of each workspace."""
    late = F.col("expires_at") <= now
    return cache.groupBy("workspace_id").agg(F.count("*").alias("entries"), F.count_if(F.col("is_valid") & ~late).alias("valid"), F.count_if(late).alias("expired"))


def hybrid(by_meaning: DataFrame, by_fields: DataFrame, strategy: str, key: str) -> DataFrame:
    """Hits of two searches by score, hits by fields with FIELD_SCORE: `vector_first` leaves the fields out if the best hit by meaning scores ENOUGH, `sql_first` leaves meanings out if there is a hit by fields,
    `parallel` has both. A key may have a hit of each."""
    near = by_meaning.select(key, "score", F.lit("vector").alias("origin"))
    told = by_fields.select(key, F.lit(FIELD_SCORE).alias("score"), F.lit("sql").alias("origin"))
    if strategy == "vector_first":
        told = told.join(near.where(F.col("score") >= ENOUGH).limit(1).select(F.lit(1).alias("enough")), F.lit(True), "left_anti")
    elif strategy == "sql_first":
        near = near.join(told.limit(1).select(F.lit(1).alias("enough")), F.lit(True), "left_anti")
    return near.unionByName(told)
