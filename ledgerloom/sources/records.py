"""Extracted records and their line items, as scans that always say who reads: acl is None or a frame of document ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.access import restricted
from ledgerloom.tables import table


def records(spark: SparkSession, sf_dir: str, acl: DataFrame | None, parties: bool = True) -> DataFrame:
    """(document_id, date, day, customer_id, status, category, amount, entity, nation_id, segment) of every order; date is an ISO text, day a date. Without parties the last three are left out, and nothing is joined for them."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"),
    )
    if not parties:
        return restricted(orders, acl)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("entity"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"))
    return restricted(orders, acl).join(customers, "customer_id")


def with_region(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds nation and region by nation_id."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region_id"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))
    return rows.join(nations.join(regions, "region_id"), "nation_id").drop("region_id")


def items(spark: SparkSession, sf_dir: str, acl: DataFrame | None) -> DataFrame:
    """(document_id, line_number, product_id, quantity, amount) of every line item."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("vendor_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"),
    )
    return restricted(lines, acl)


def item_rows(spark: SparkSession, sf_dir: str, acl: DataFrame | None, parties: bool = True) -> DataFrame:
    """Line items with the fields of their record; header_amount is the record's own total, repeated on each line. Records without items have no rows."""
    headers = records(spark, sf_dir, acl, parties).withColumnRenamed("amount", "header_amount")
    return headers.join(items(spark, sf_dir, None), "document_id")


def numbered(documents: DataFrame, key: str, array: str, done: DataFrame | None = None) -> DataFrame:
    """(key, line_number, data): arrays of items as rows numbered from 0; documents that are in `done` are left out."""
    rows = documents if done is None else documents.join(done.select(key).distinct(), key, "left_anti")
    return rows.select(key, F.posexplode(array).alias("line_number", "data"))


def nested(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_items, line_items_count): the rows of each document as an array in the order of line_number."""
    one = F.struct("line_number", *(c for c in lines.columns if c not in (key, "line_number")))
    return lines.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("line_items"), F.count("*").alias("line_items_count"))
