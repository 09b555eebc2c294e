"""Queries of rows with named fields: orders stand for records with a header and a summary, their lines for items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import projection as J
from ledgerloom.registry import query
from ledgerloom.tables import dealt, table


def _map(**fields):
    return F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a total in the header or, if they are open, in the summary, and without a date if pending."""
    c = F.col
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    header = _map(total_amount=F.when(c("o_orderstatus") == "F", c("o_totalprice").cast("long")), statement_date=F.when(c("o_orderstatus") != "P", day), company_name=F.concat(F.lit("C"), c("o_custkey")))
    summary = _map(total_amount=F.when(c("o_orderstatus") == "O", c("o_totalprice").cast("long")), grand_total=F.lit("n/a"))
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("document_id"), header.alias("header"), summary.alias("summary"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    data = _map(Price=c("l_extendedprice").cast("long"), Qty=c("l_quantity").cast("long"), Status=c("l_returnflag"), Ship=F.when(c("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd")), Item=c("l_partkey"))
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("document_id"), c("l_linenumber").alias("line_number"), data.alias("data"))


DAY = "CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""SELECT o_orderkey AS document_id, {DAY} AS date, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(trunc(o_totalprice) AS DOUBLE) END AS amount, 'C' || CAST(o_custkey AS VARCHAR) AS entity_name FROM orders""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total in the header before one in the summary; a field that holds no number ends the search."""
    return _records(spark, sf_dir).select("document_id", *J.record_row(F.col("header"), F.col("summary")))


@query("""SELECT o_orderkey AS document_id, l_linenumber AS line_number, CASE WHEN l_orderkey IS NULL THEN CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(trunc(o_totalprice) AS DOUBLE) END ELSE CAST(trunc(l_extendedprice) AS DOUBLE) END AS amount
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def rows_of_all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of records, and a row for each record without any."""
    rows = J.record_rows(_records(spark, sf_dir), _items(spark, sf_dir))
    _, of_record, _ = J.record_row(F.col("header"), F.col("summary"))
    of_item = F.try_element_at("data", F.lit("Price")).try_cast("double")
    return rows.select("document_id", "line_number", F.when(F.col("data").isNull(), of_record).otherwise(of_item).alias("amount"))


@query(f"""SELECT o_orderkey AS document_id, l_linenumber AS line_number, coalesce(CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END, {DAY}) AS date, CAST(trunc(l_extendedprice) AS DOUBLE) AS amount,
CAST(trunc(l_quantity) AS DOUBLE) AS quantity, l_returnflag AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def mapped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the meanings of their columns; a missing date is the record's."""
    rows = _records(spark, sf_dir).join(_items(spark, sf_dir), "document_id")
    meanings = {"Ship": ("date", "datetime"), "Price": ("amount", "number"), "Qty": ("quantity", "number"), "Status": ("status", "string"), "Other": ("status", "string"), "Item": ("identifier", "string")}
    return rows.select("document_id", "line_number", *J.mapped_row(F.col("data"), F.col("header"), meanings))


@query(f"""SELECT l_orderkey AS document_id, l_linenumber AS line_number, CAST(NULL AS VARCHAR) AS date, CAST(trunc(l_extendedprice) AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS entity_name,
CAST(l_partkey AS VARCHAR) AS product, CAST(trunc(l_quantity) AS DOUBLE) AS quantity, l_returnflag AS status, CAST(NULL AS VARCHAR) AS region FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the names that fields usually go by; a statement's date is not among them."""
    rows = _records(spark, sf_dir).join(_items(spark, sf_dir), "document_id")
    return rows.select("document_id", "line_number", *J.listed_row(F.col("data"), F.col("header")))


@query("SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(trunc(o_totalprice) AS DOUBLE) ELSE 0.0 END AS total FROM orders")
def header_or_summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("document_id", J.number_of(F.col("header"), F.col("summary"), "total_amount").alias("total"))


@query("SELECT o_orderkey AS document_id, l_linenumber AS line_number, l_returnflag = 'A' AS is_currency FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey")
def currency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_number")).agg((F.max("l_returnflag") == "A").alias("is_currency"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")).join(items.select("document_id", "line_number"), "document_id", "left")
    return J.with_currency(rows, items)


@query("SELECT o_orderkey AS document_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders")
def serialized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.serialized(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount")))


@query("""SELECT coalesce(nullif(c_mktsegment, 'HOUSEHOLD'), 'unknown') AS schema_type, count(*) AS documents, CASE WHEN bool_and(c_acctbal > -5000) THEN CASE WHEN bool_and(c_nationkey >= 1) THEN ['balance', 'nation', 'name'] ELSE ['balance', 'name'] END
ELSE ['name'] END AS common_fields, count(*) > 1 AS can_combine FROM customer GROUP BY 1""")
def schemas_with_common_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array_compact(F.array(F.lit("name"), F.when(F.col("c_acctbal") > -5000, "balance"), F.when(F.col("c_nationkey") >= 1, "nation")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("schema_type"), fields.alias("fields"))
    return J.schema_groups(rows)


@query("SELECT o_orderkey AS document_id, min(l_linenumber) AS line_number FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_returnflag, l_linestatus")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order without those that are like an earlier one."""
    c = F.col
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"), "l_orderkey")
    first = lines.join(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey")), "l_orderkey")  # a semi-join would be moved in front of the dealing
    once = first.groupBy("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber").count()
    data = F.create_map(F.lit("flag"), c("l_returnflag"), F.lit("state"), c("l_linestatus"))
    found = J.distinct_items(once.select(c("l_orderkey").alias("document_id"), c("l_linenumber").alias("line_number"), data.alias("data")), "document_id", "line_number", "data")
    return found.select("document_id", "line_number")


@query("""WITH r AS (SELECT event_id, user_id AS page, event_type AS category, CAST(trunc(value / 10) AS BIGINT) AS txt, CAST(trunc(value * 10) AS BIGINT) AS box FROM events),
n AS (SELECT event_id, page, count(*) OVER (PARTITION BY page, category, txt) AS pairs, min(event_id) OVER (PARTITION BY page, category, txt) AS first_pair, count(*) OVER (PARTITION BY page, box) AS boxes, min(event_id) OVER (PARTITION BY page, box) AS first_box FROM r)
SELECT event_id, page FROM n WHERE (pairs < 5 OR event_id = first_pair) AND (boxes < 2 OR event_id = first_box)""")
def events_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "events").select("event_id", c("user_id").alias("page"), c("event_type").alias("category"), (c("value") / 10).cast("long").alias("text"), (c("value") * 10).cast("long").alias("box"))
    return J.without_repeats(rows, "page", "event_id", "category", "text", "box").select("event_id", "page")


@query("SELECT c_custkey AS conv_id, count(turn) AS messages FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY 1")
def repaired_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_nationkey").cast("long").alias("messages"))
    return J.repaired(owners, table(spark, sf_dir, "conversations"), "conv_id", "messages")


@query("SELECT conv_id, coalesce(max(turn), 0) + 1 AS place FROM conversations GROUP BY 1")
def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_place(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("""WITH p AS (SELECT conv_id, turn + 1 AS page, max(turn + 1) OVER (PARTITION BY conv_id) AS pages FROM conversations)
SELECT conv_id, page, CASE WHEN page <= 1 THEN 'first' WHEN page > pages - 1 THEN 'last' ELSE 'middle' END AS region FROM p WHERE page <= 1 OR page > pages - 1 OR page = pages // 2 + 1""")
def sampled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last turn of each conversation."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"))
    return J.regions(pages, "conv_id", "page")


@query("SELECT o_orderkey AS document_id, o_totalprice AS amount FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 20 orders by amount."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_totalprice").alias("amount"))
    return rows.orderBy(F.desc("amount"), "document_id").offset(40).limit(20)


@query("""SELECT * FROM ((SELECT o_orderkey AS document_id, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 1)
UNION ALL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 2))""")
def least_and_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of branches that are each sorted and cut."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    least = rows.where("o_orderstatus = 'F'").orderBy("amount", "document_id").limit(1)
    most = rows.where("o_orderstatus = 'O'").orderBy(F.desc("amount"), "document_id").limit(2)
    return least.unionByName(most).drop("o_orderstatus")


@query("SELECT o_orderkey AS document_id, l_linenumber AS line_number FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000) JOIN lineitem ON l_orderkey = o_orderkey")
def items_of_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is on records, before their items are joined."""
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")).orderBy("document_id").limit(1000)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_number"))
    return first.join(items, "document_id")
