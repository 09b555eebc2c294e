"""What is handed to a model with a question: chunks, parents and what the graph tells, within a budget, and whether a result is small enough for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scoring import tokens
from ledgerloom.operators.access import restricted
from ledgerloom.operators.retrieval import best_of_each, packed, top

# Percent of the budget for chunks, parents and the graph; characters of a token; what a model can take of a result.
SHARES = (60, 25, 15)
TOKEN = 4
SAFE_TOKENS, SAFE_ROWS = 80_000, 40
SUMMARY = "tabular_summary"


def contexts(chunks: DataFrame, parents: DataFrame, told: DataFrame, by: str, key: str, text: str, budget: int, shares: Sequence[int] = SHARES) -> DataFrame:
    """(by, section, key, tokens, text): for each question the chunks, then the parents, that fit their share of a budget, by priority and score, and what the graph tells, cut to its share.

    What doesn't fit is passed over, and a later, smaller one may fit; a share that isn't used is not given to another. chunks and parents have priority and score; told has a row for each question. A text of the graph that is
    too long ends with three points. Missing texts take no part.
    """
    parts = []
    for section, rows, share in (("chunk", chunks, shares[0]), ("parent", parents, shares[1])):
        whole = rows.where(F.col(text).isNotNull())
        taken = packed(whole, by, key, text, budget * share // 100)
        parts.append(taken.join(whole.select(by, key, text), [by, key]).select(by, F.lit(section).alias("section"), key, "tokens", text))
    room = budget * shares[2] // 100
    short = F.when(tokens(F.col(text), 0) > room, F.concat(F.left(F.col(text), F.lit(room * TOKEN)), F.lit("..."))).otherwise(F.col(text))
    graph = told.where(F.col(text).isNotNull()).select(by, F.lit("graph").alias("section"), F.lit(None).cast(dict(chunks.dtypes)[key]).alias(key), tokens(short, 0).alias("tokens"), short.alias(text))
    return parts[0].unionByName(parts[1]).unionByName(graph)


def told_in_order(built: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """(by, context): each question's context as one text, the graph first; as long as its budget allows."""
    rank = F.when(F.col("section") == "graph", 0).when(F.col("section") == "chunk", 1).otherwise(2)
    head = F.when(F.col("section") == "graph", "[Knowledge Graph Context]\n").otherwise("")
    one = F.struct(rank.alias("rank"), key, F.concat(head, F.col(text)).alias("t"))
    return built.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def documents_by_summary(chunks: DataFrame, k: int, least: float, acl: DataFrame | None = None, key: str = "chunk_id", document: str = "document_id", kind: str = "chunk_type") -> DataFrame:
    """The k best summaries of documents by their score, of at least a score and readable, then each document once by its best one."""
    return best_of_each(top(restricted(chunks.where(F.col(kind) == SUMMARY), acl, document), k, key, least), document, key)


def size_of(rows: DataFrame, overhead: int = 500, most_tokens: int = SAFE_TOKENS, most_rows: int = SAFE_ROWS) -> DataFrame:
    """(row_count, column_count, estimated_tokens, exceeds_limit) of a result as a table in markdown, in one pass over it; missing values show as a dash."""
    width = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit("-"))) + 3 for c in rows.columns), F.lit(2))
    head = sum(len(c) + 3 for c in rows.columns) + 2 + 6 * len(rows.columns) + 2  # the names and the rule under them
    told = rows.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(width), F.lit(0)).alias("chars"))
    size = F.when(F.col("row_count") == 0, 0).otherwise(F.floor((F.col("chars") + head) / TOKEN) + overhead).cast("long")
    return told.select("row_count", F.lit(len(rows.columns)).alias("column_count"), size.alias("estimated_tokens"), ((F.col("row_count") > most_rows) | (size > most_tokens)).alias("exceeds_limit"))
