"""From raw documents to token ids: language, near-duplicates, personal data, mixture and encoding, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, language, mixing, personal, simhash
from ledgerloom.llm.common import shared_folder, table

#: A predicted language below this score is none.
LEAST_SCORE = 0.5
TOKENIZER = "byte_bpe_50k.tiktoken"


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized; a missing lang is filled in. Null texts and texts without a letter go, and all go if no document has a lang; repeated rows stay or go together."""
    lang, score = _fresh(docs, "found_lang"), _fresh(docs, "found_score")
    found = language.labelled(docs, language.train(docs), "text", lang, score)
    kept = found.where((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by sets of five-word shingles, one row. Rows are told apart by their place in the files of docs, so null and repeated ids are rows like any other; blank texts are one group."""
    row = _fresh(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    near = simhash.similar(rows, row)
    gone = near.where("doc_id != component_id").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars follows the new text. A null text stays null, and repeated rows stay equal."""
    text = personal.redacted(F.col("text"), personal.learn(docs))
    return docs.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it; texts without words, and null ones, are never taken."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and sums of them and of the decoded bytes; a null text has none."""
    return bpe.round_trip(docs, str(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data),
    ("mixture", mix_sources), ("encoding", encode),
]

#: SQL can't state the stages; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; what each returns is kept in the shared folder until the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
