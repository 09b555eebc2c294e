"""Queries of how relevant records are for a question, and of how a result is laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import relevance as R
from ledgerloom.registry import query
from ledgerloom.tables import table


@query("""WITH d AS (SELECT c_custkey, c_name, c_acctbal, c_custkey % 3 AS f, CASE c_mktsegment WHEN 'BUILDING' THEN 'Invoice' WHEN 'AUTOMOBILE' THEN 'Spreadsheet' WHEN 'MACHINERY' THEN 'pdf' WHEN 'FURNITURE' THEN 'contract' END AS kind FROM customer),
a AS (SELECT *, CASE WHEN c_custkey = 12 THEN 0.3::DOUBLE ELSE 0 END AS name_score FROM d),
b AS (SELECT *, (name_score + CASE kind WHEN 'Invoice' THEN 0.25 WHEN 'Spreadsheet' THEN 0.35 WHEN 'pdf' THEN 0.1 ELSE 0 END::DOUBLE) * CASE WHEN kind <> 'Invoice' THEN 0.5 ELSE 1 END AS typed FROM a),
c AS (SELECT *, typed + CASE f WHEN 0 THEN 0.45 WHEN 1 THEN 0.9 ELSE 0 END::DOUBLE + CASE WHEN c_acctbal IS NULL THEN 0 ELSE 0.1 END::DOUBLE AS filled FROM b),
e AS (SELECT *, CASE WHEN f = 2 THEN greatest(filled - 0.2, 0.1) ELSE filled END AS checked FROM c)
SELECT c_custkey AS document_id, round(least(CASE WHEN name_score > 0 THEN checked ELSE checked * 0.4 END, 1), 6)::DOUBLE AS score FROM e""")
def relevant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance of customers' records for a question about one of them."""
    c = F.col
    kind = F.when(c("c_mktsegment") == "BUILDING", "Invoice").when(c("c_mktsegment") == "AUTOMOBILE", "Spreadsheet").when(c("c_mktsegment") == "MACHINERY", "pdf").when(c("c_mktsegment") == "FURNITURE", "contract")
    fields = F.when(c("c_custkey") % 3 == 0, F.array(F.lit("Total Amount"), F.lit("order-date"))).when(c("c_custkey") % 3 == 1, F.array(F.lit("unit_price"), F.lit("Sales"), F.lit("notes")))
    header = F.create_map(F.lit("vendor_name"), c("c_name"), F.lit("balance"), c("c_acctbal").cast("string"))
    score = R.relevance("Total sales amount and price from Customer#000000012 please", kind, header, fields, types=["invoice"])
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("document_id"), F.round(score, 6).alias("score"))


@query("SELECT count(*) AS records, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(28,6))), 2) AS DOUBLE) AS sales_amount, CAST(round(sum(CAST(l_tax AS DECIMAL(28,6))), 2) AS DOUBLE) AS tax FROM lineitem")
def laid_out_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the columns that a layout shows as money: by their name, or by their meaning."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("sales_amount"), F.col("l_quantity").alias("total_quantity"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("ship_date"))
    return R.totals(rows, R.layout(rows.columns, {"tax": "amount", "total_quantity": "quantity"}))
