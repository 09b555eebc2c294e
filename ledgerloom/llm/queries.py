"""The registered queries of this package, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, credentials, inner_product, language, lexical_search, mixing, ogg, page_text, personal, resampling, ring, simhash, suffix_tree
from ledgerloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"), gated=False)


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents"))


def op4_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_k(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), str(path), public_tokenizers.PATTERN)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


def op10_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.detect(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    named = (
        op1_simhash, op2_suffix_tree, op3_ogg, op4_inner_product, op5_mixing, op6_ring, op7_bpe, op8_language, op9_credentials, op10_personal,
        op11_resampling, op12_lexical_search, op13_page_text,
    )
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return {"op4_inner_product": inner_product.TOP_K_SQL, "op11_resampling": resampling.RESAMPLE_SQL, "op12_lexical_search": lexical_search.SEARCH_SQL}
