"""Queries of structured analytics: orders stand for records, line items for their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import format_cell
from ledgerloom.operators import analytics as A
from ledgerloom.plans.phrases import spec_of
from ledgerloom.registry import query
from ledgerloom.sources.records import item_rows, items, records, with_region
from ledgerloom.tables import table

METRICS = """count(*) AS count, coalesce(CAST(sum(a) AS DOUBLE), 0) AS total_amount,
  CASE WHEN count(a) > 0 THEN CAST(sum(a) AS DOUBLE) / count(a) ELSE 0 END AS average,
  coalesce(CAST(min(a) AS DOUBLE), 0) AS least, coalesce(CAST(max(a) AS DOUBLE), 0) AS most"""
ITEMS = "SELECT o.*, c.*, l.*, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN lineitem l ON l_orderkey = o_orderkey"
RECORDS = "SELECT o.*, c.*, n_name, r_name, CAST(o_totalprice AS DECIMAL(18,2)) AS a, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def _group_sql(source: str, key: str) -> str:
    return f"SELECT {key} AS group_key, {METRICS} FROM ({source}) GROUP BY 1"


MONTH, YEAR = "substr(d, 1, 7)", "substr(d, 1, 4)"
QUARTER = "substr(d, 1, 4) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR)"


@query(_group_sql(ITEMS, MONTH))
def monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped(item_rows(spark, sf_dir, None, parties=False), "month", date_field="day")


@query(_group_sql(ITEMS, QUARTER))
def quarterly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped(item_rows(spark, sf_dir, None, parties=False), "quarter", date_field="day")


@query(_group_sql(RECORDS, YEAR))
def yearly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped(records(spark, sf_dir, None, parties=False), "year", date_field="day")


@query(_group_sql(RECORDS, "o_orderpriority"))
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped(records(spark, sf_dir, None, parties=False), "category")


@query(_group_sql(RECORDS, "c_name"))
def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped(records(spark, sf_dir, None), "entity")


@query(_group_sql(RECORDS, "o_orderstatus"))
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped(records(spark, sf_dir, None, parties=False), "status")


@query(_group_sql(RECORDS, "r_name"))
def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouped(with_region(records(spark, sf_dir, None), spark, sf_dir), "region")


@query(_group_sql("SELECT p_name, CAST(l_extendedprice AS DECIMAL(18,2)) AS a FROM lineitem JOIN part ON p_partkey = l_partkey", "p_name"))
def product_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product"))
    return A.grouped(items(spark, sf_dir, None).join(products, "product_id"), "product")


@query(_group_sql("SELECT s_name, CAST(l_extendedprice AS DECIMAL(18,2)) AS a FROM lineitem JOIN supplier ON s_suppkey = l_suppkey", "s_name"))
def vendor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor"))
    return A.grouped(items(spark, sf_dir, None).join(vendors, "vendor_id"), "vendor")


@query(_group_sql(RECORDS, "'All'"))
def ungrouped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouping that the rows don't have."""
    return A.grouped(records(spark, sf_dir, None), "warehouse")


@query(f"SELECT {METRICS} FROM ({RECORDS}) WHERE d > '2999-01-01'")
def empty_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over no rows are zeros, not nulls."""
    return A.summary(A.filtered(records(spark, sf_dir, None), A.Spec(start="2999-01-01")))


@query(f"""SELECT level_1, level_2, CAST(2 - (grouping(level_1) + grouping(level_2)) AS INTEGER) AS depth, {METRICS}
FROM (SELECT {YEAR} AS level_1, r_name AS level_2, a FROM ({RECORDS})) GROUP BY GROUPING SETS ((level_1, level_2), (level_1), (level_2), ())""")
def year_region_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hierarchy(with_region(records(spark, sf_dir, None), spark, sf_dir), ["year", "region"], date_field="day")


@query(f"""SELECT level_1, level_2, level_3, CAST(3 - (grouping(level_1) + grouping(level_2) + grouping(level_3)) AS INTEGER) AS depth, {METRICS}
FROM (SELECT r_name AS level_1, o_orderstatus AS level_2, {QUARTER} AS level_3, a FROM ({RECORDS})) GROUP BY ROLLUP (level_1, level_2, level_3)""")
def region_status_quarter_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hierarchy(with_region(records(spark, sf_dir, None), spark, sf_dir), ["region", "status", "quarter"], date_field="day")


@query(f"SELECT o_orderpriority AS category, count(*) AS count, CAST(sum(t) AS DOUBLE) / count(*) AS average FROM (SELECT o_orderpriority, o_orderkey, sum(a) AS t FROM ({ITEMS}) GROUP BY 1, 2) GROUP BY 1")
def average_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.average_per(item_rows(spark, sf_dir, None, parties=False), "document_id", ["category"])


@query(f"""SELECT o_orderstatus AS status, count(*) AS documents, CAST(sum(n) AS BIGINT) AS items, CAST(sum(h) AS DOUBLE) AS header_total, CAST(sum(t) AS DOUBLE) AS line_total
FROM (SELECT o_orderstatus, o_orderkey, count(*) AS n, max(CAST(o_totalprice AS DECIMAL(18,2))) AS h, sum(a) AS t FROM ({ITEMS}) GROUP BY 1, 2) GROUP BY 1""")
def totals_once_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header totals are not multiplied by the number of lines."""
    return A.once_per(item_rows(spark, sf_dir, None, parties=False), "document_id", "header_amount", "amount", ["status"])


@query(f"""WITH r AS ({RECORDS}), b AS (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM r GROUP BY 1)
SELECT o_orderkey AS document_id, r.o_orderpriority AS category, o_totalprice AS amount, 'MIN' AS record_type FROM r JOIN b ON r.o_orderpriority = b.o_orderpriority AND o_totalprice = lo
UNION ALL SELECT o_orderkey, r.o_orderpriority, o_totalprice, 'MAX' FROM r JOIN b ON r.o_orderpriority = b.o_orderpriority AND o_totalprice = hi""")
def extreme_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extremes(records(spark, sf_dir, None), "amount", ["category"]).select("document_id", "category", "amount", "record_type")


@query(f"""SELECT o_orderkey AS document_id, d AS date, c_name AS entity, o_totalprice AS amount FROM ({RECORDS})
WHERE d >= '1996-01-01' AND d <= '1996-12-31' AND lower(c_name) LIKE '%customer#00000001%' AND o_totalprice BETWEEN 50000 AND 400000 AND o_orderstatus = 'F'""")
def filtered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = A.Spec(start="1996-01-01", end="1996-12-31", entities=("Customer#00000001",), least={"amount": 50000}, most={"amount": 400000}, equal={"status": "F"})
    return A.filtered(records(spark, sf_dir, None), spec).select("document_id", "date", "entity", "amount")


@query(_group_sql(f"{RECORDS} WHERE c_nationkey % 5 = 2", MONTH))
def accessible_monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what the access list of one user lets through."""
    own = table(spark, sf_dir, "customer").where("c_nationkey % 5 = 2").select("c_custkey")
    acl = table(spark, sf_dir, "orders").join(own, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("document_id"))
    return A.grouped(records(spark, sf_dir, acl, parties=False), "month", date_field="day")


@query("SELECT count(DISTINCT l_orderkey) AS documents, count(*) AS items FROM lineitem")
def document_and_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir, None)
    return rows.agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("items"))


@query("""SELECT n AS column_name, count(v) AS count, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS total, min(v) AS least, max(v) AS most, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / count(v) AS mean
FROM (SELECT 'quantity' AS n, l_quantity AS v FROM lineitem UNION ALL SELECT 'amount', l_extendedprice FROM lineitem) GROUP BY 1""")
def item_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.numeric_profile(items(spark, sf_dir, None), ["quantity", "amount"])


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def frequent_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frequent_values(table(spark, sf_dir, "part"), "p_name")


@query("""SELECT o_orderpriority AS category, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS "n_F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "n_O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "n_P" FROM orders GROUP BY 1""")
def status_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_counts(records(spark, sf_dir, None), ["category"], "status", ["F", "O", "P"])


@query("SELECT o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated(records(spark, sf_dir, None), ["customer_id", "date"], "document_id")


@query("""SELECT l_orderkey AS document_id, string_agg('| ' || CAST(l_linenumber AS VARCHAR) || ' | ' || CAST(l_partkey AS VARCHAR) || ' |', chr(10) ORDER BY l_linenumber, l_partkey) AS body,
count(*) AS items, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS subtotal FROM lineitem GROUP BY 1""")
def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = items(spark, sf_dir, None).withColumn("at", F.struct("line_number", "product_id"))
    return A.report(lines, ["document_id"], ["line_number", "product_id"], "amount", "at")


@query("""SELECT s_suppkey AS vendor_id, CASE WHEN s_acctbal IS NULL THEN '-' ELSE '$' || trim(format('{:,.2f}', s_acctbal)) END AS shown FROM supplier""")
def shown_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), format_cell(F.col("s_acctbal"), "balance").alias("shown"))


@query(_group_sql(f"{RECORDS} WHERE o_totalprice >= 100000 AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'", MONTH))
def asked_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question in words, compiled to the same plan as one in code."""
    spec = spec_of("total amount by month in 1997 over $100,000")
    return A.grouped(A.filtered(records(spark, sf_dir, None).withColumn("total_amount", F.col("amount")), spec), spec.group_by[0])
