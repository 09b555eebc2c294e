"""Queries of conditions and of what is done with documents: files, types and topics come from the tables' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import predicates as P
from ledgerloom.operators.access import granted
from ledgerloom.registry import query
from ledgerloom.tables import table

FILES = "SELECT doc_id, text, source || '_' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'en' THEN '.CSV' WHEN 'de' THEN '.pdf' WHEN 'fr' THEN '.xlsx' ELSE '.txt' END AS filename FROM documents"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("lang") == "en", ".CSV").when(F.col("lang") == "de", ".pdf").when(F.col("lang") == "fr", ".xlsx").otherwise(".txt")
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), end).alias("filename"))


@query("""SELECT o_orderkey AS document_id FROM orders WHERE o_totalprice BETWEEN 1000 AND 300000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_orderpriority ILIKE '%ur%'
AND o_custkey > 10 AND o_custkey < 1200 AND o_orderdate <> TIMESTAMP '1998-10-03' AND o_orderkey >= 5 AND o_orderkey <= 14000""")
def filtered_by_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [
        ("o_totalprice", "between", 1000, 300000), ("o_orderstatus", "in", "F", "O"), ("o_orderpriority", "not_in", "5-LOW"), ("o_orderpriority", "ilike", "%UR%"), ("o_custkey", "compound", 10, 1200),
        ("o_orderdate", "!=", F.lit("1998-10-03").cast("timestamp")), ("o_orderkey", ">=", 5), ("o_orderkey", "<=", 14000),
    ]
    return P.conditions(table(spark, sf_dir, "orders"), tests).select(F.col("o_orderkey").alias("document_id"))


@query("SELECT l_orderkey AS document_id, l_linenumber AS line_number FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_returnflag IN ('A', 'R') AND (l_linestatus = 'F' OR l_discount >= 0.05)")
def filtered_by_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    test = P.payload([c("l_quantity") >= 10, c("l_quantity") < 40, c("l_returnflag").isin("A", "R")], [c("l_linestatus") == "F", c("l_discount") >= 0.05])
    return table(spark, sf_dir, "lineitem").where(test).select(c("l_orderkey").alias("document_id"), c("l_linenumber").alias("line_number"))


@query("""SELECT c_custkey AS document_id, CASE WHEN c_nationkey = 3 THEN true WHEN c_acctbal < 0 THEN false WHEN c_mktsegment = 'BUILDING' THEN true WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN true ELSE false END AS allowed FROM customer""")
def permission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document may be read: by anyone who is an admin, and else within the time of a permission that is owned, held or full."""
    c = F.col
    held = F.when(c("c_mktsegment") == "MACHINERY", F.array(F.lit("full"))).when(c("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("write"), F.lit("read"))).otherwise(F.array(F.lit("write")))
    rows = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("document_id"), (c("c_mktsegment") == "BUILDING").alias("is_owner"), held.alias("permissions"), F.when(c("c_acctbal") < 0, F.lit("2020-01-01").cast("timestamp")).alias("expires_at"),
        (c("c_nationkey") == 3).alias("is_admin"),
    )
    return rows.select("document_id", (c("is_admin") | granted("read", F.lit("2026-01-01").cast("timestamp"))).alias("allowed"))


@query("SELECT DISTINCT c_nationkey AS workspace_id, o_orderkey AS document_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (2, 5) AND o_orderstatus <> 'P'")
def workspace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two workspaces that are not deleted."""
    owners = table(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(2, 5)).select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("workspace_id"))
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(owners, "o_custkey").select("workspace_id", F.col("o_orderkey").alias("document_id")).distinct()


@query(f"""SELECT doc_id AS document_id, CASE WHEN length(text) < 40 THEN 'user_disabled:document_flag' WHEN lower(filename) LIKE '%.csv' THEN 'file_type:.csv' WHEN lower(filename) LIKE '%.xlsx' THEN 'file_type:.xlsx'
WHEN filename LIKE '%.pdf' THEN 'document_type:receipt' END AS reason FROM ({FILES}) WHERE length(text) < 40 OR filename LIKE '%.pdf' OR lower(filename) LIKE '%.csv' OR filename LIKE '%.xlsx'""")
def graph_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a flag, a file or a type that no graph is made of; the texts of the others are not looked at."""
    rows = _files(spark, sf_dir)
    kind = F.when(F.col("filename").endswith(".pdf"), " Meal_Receipt").otherwise("memo")
    reason = P.skip_reason(F.col("filename"), kind, F.lit(None).cast("string"), F.length("text") < 40, F.lit(None).cast("string"))
    return rows.select(F.col("doc_id").alias("document_id"), reason.alias("reason")).where("reason IS NOT NULL")


@query(f"""WITH d AS (SELECT doc_id, filename, len([s for s in string_split(text, chr(10)) if length(s) - length(replace(s, '|', '')) >= 2 OR length(s) - length(replace(s, ',', '')) >= 2]) / len(string_split(text, chr(10))) AS tables,
length(regexp_replace(text, '[^0-9.,]', '', 'g')) / greatest(length(text), 1) AS numbers FROM ({FILES}))
SELECT doc_id AS document_id, CASE WHEN lower(filename) LIKE '%.csv' THEN 'file_extension:.csv' WHEN filename LIKE '%.xlsx' THEN 'file_extension:.xlsx' WHEN filename LIKE '%.pdf' THEN 'document_type:bank_statement'
WHEN tables > 0.6 THEN 'table_density' WHEN numbers > 0.4 THEN 'numeric_density' ELSE 'not_tabular' END AS reason,
CASE WHEN filename LIKE '%.txt' AND tables <= 0.6 AND numbers <= 0.4 THEN 'standard' ELSE 'tabular' END AS path FROM d""")
def processing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir)
    kind = F.when(F.col("filename").endswith(".pdf"), "statement").otherwise("memo")
    how = F.col("filename"), kind, F.col("text")
    return rows.select(F.col("doc_id").alias("document_id"), P.tabular_reason(*how).alias("reason"), P.path(*how).alias("path"))


@query(f"""SELECT doc_id AS document_id, CASE WHEN lower(filename) LIKE '%.csv' THEN 'csv' WHEN filename LIKE '%.pdf' THEN 'pdf' WHEN filename LIKE '%.xlsx' THEN 'xlsx' ELSE 'unknown' END AS source_type,
CASE WHEN length(text) < 500 THEN 7 ELSE CAST(1 + length(text) // 2000 AS INTEGER) * CASE WHEN filename LIKE '%.pdf' THEN 30 WHEN filename LIKE '%.xlsx' THEN 50 ELSE 20 END END AS rows,
length(text) >= 100 AND (filename LIKE '%.pdf' OR filename LIKE '%.xlsx') AS eligible FROM ({FILES})""")
def extraction_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of file a document is, how many rows it may have, and whether they are extracted."""
    name, text = F.col("filename"), F.col("text")
    kind = F.when(name.endswith(".pdf"), "Bank_Statement").when(name.endswith(".xlsx"), "spreadsheet")
    pages = (F.lit(1) + F.floor(F.length(text) / 2000)).cast("int")
    rows = P.estimated_rows(F.when(F.length(text) < 500, 7), pages, F.filter(F.array(F.lit("memo"), kind), lambda k: k.isNotNull()))
    state = F.when(F.length(text) < 100, "pending").otherwise("converted")
    return _files(spark, sf_dir).select(F.col("doc_id").alias("document_id"), P.source_type(name).alias("source_type"), rows.alias("rows"), P.eligible(state, kind, ["bank_statement", "spreadsheet"]).alias("eligible"))


@query("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM lineitem WHERE l_quantity = 50 LIMIT 1)")
def any_full_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exists(table(spark, sf_dir, "lineitem").where("l_quantity = 50"))


@query("""SELECT o_orderkey AS document_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND lower(o_orderpriority) IN ('1-urgent', '2-high')
AND (lower(c_mktsegment) LIKE '%build%' OR lower(c_name) LIKE '%00000012%' OR EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND (lower(p_name) LIKE '%build%' OR lower(p_name) LIKE '%00000012%' OR lower(p_name) LIKE '%small ring%')) OR lower(c_mktsegment) LIKE '%small ring%')""")
def orders_on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), "o_custkey", F.col("o_orderpriority").alias("schema_type"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("vendor_name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("description"))
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").alias("document_id"), "description")
    found = P.on_topic(orders.join(customers, "o_custkey", "left"), lines, ["Build", "00000012", "small ring"], ["1-URGENT", "2-HIGH"], ["category", "vendor_name"])
    return found.select("document_id")


#: The ratio of a part's name and `small rings`, whose longest common subsequence is counted by moving a row of 11 bits along the name.
LIKE_RINGS = """200.0 * (11 - bit_count(list_reduce(list_prepend(2047::BIGINT, list_transform(string_split(p_name, ''), lambda c: list_sum(list_transform(range(1, 12), lambda i: CASE WHEN 'small rings'[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)),
lambda v, m: ((v + (v & m)) | (v - (v & m))) & 2047))) / (length(p_name) + 11) >= 80"""


@query(f"""WITH i AS (SELECT DISTINCT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE lower(s_name) LIKE '%supplier#000000007%')
SELECT p_partkey AS document_id, CASE WHEN p_name = 'small rings' THEN 'exact' WHEN contains('small rings', p_name) THEN 'substring' WHEN {LIKE_RINGS} THEN 'fuzzy' ELSE 'item' END AS match
FROM part LEFT JOIN i ON l_partkey = p_partkey WHERE {LIKE_RINGS} OR l_partkey IS NOT NULL""")
def parts_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name is like a wanted one, or that a supplier of a wanted name delivers."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("vendor_name"))
    vendors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("description"))
    lines = table(spark, sf_dir, "lineitem").join(vendors, "l_suppkey").select(F.col("l_partkey").alias("document_id"), "description")
    return P.naming(parts, lines, ["Small Rings", "Supplier#000000007"], ["vendor_name"])


@query("SELECT s_suppkey AS entity_id, CAST(s_suppkey % 100 AS INTEGER) AS score FROM supplier WHERE s_suppkey % 100 >= 60")
def important_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of at least a score."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), (F.col("s_suppkey") % 100).cast("int").alias("score"))
    return nodes.where(P.condition(F.col("score"), ">=", 60))
