"""Questions in words, compiled to plans over orders and their items, each with the statement that it means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.turns import resolved
from ledgerloom.plans.questions import Field, answer
from ledgerloom.registry import query
from ledgerloom.tables import table

FIELDS = (
    Field("Purchase Date", "date", "header"), Field("Customer Name", "entity", "header"), Field("Category", "category", "header", "group_by"), Field("Status", "status", "header", "group_by"),
    Field("Region", "region", "header", "group_by"), Field("Product", "product", "item", "group_by"), Field("Quantity", "quantity", "item", "sum"), Field("Amount", "amount", "item", "sum"),
)
SOURCE = """SELECT o_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%d') AS d, c_name AS customer_name, o_orderpriority AS category, o_orderstatus AS status, r_name AS region, CAST(l_partkey AS VARCHAR) AS product,
l_quantity, CAST(l_extendedprice AS DECIMAL(28,6)) AS a, year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN lineitem ON l_orderkey = o_orderkey"""
#: Each question with the keys that it groups by, in order.
ASKED = (
    ("Summarize total sales by category", ("category",)), ("Show sales by year and category", ("year", "category")), ("Total sales grouped by year then by category", ("year", "category")),
    ("Monthly sales breakdown by category", ("month", "category")), ("Total quantity and sales by region", ("region",)), ("Total by customer name, then by year", ("customer_name", "year")),
    ("Group first by region and status, yearly", ("status", "region", "year")), ("What did we sell per quarter", ("quarter",)), ("Total sales of all products", ("product",)), ("Total sales", ()),
)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, text = F.col, lambda name: F.col(name).cast("string")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("c_nationkey"), "r_name")
    customers = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(c("c_custkey").alias("o_custkey"), "c_name", "r_name")
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey").join(table(spark, sf_dir, "lineitem"), c("o_orderkey") == c("l_orderkey"))
    header = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Purchase Date"), c("c_name").alias("Customer Name"), c("o_orderpriority").alias("Category"), c("o_orderstatus").alias("Status"), c("r_name").alias("Region"),
    )
    item = F.struct(text("l_partkey").alias("Product"), text("l_quantity").alias("Quantity"), text("l_extendedprice").alias("Amount"))
    return rows.select(c("o_orderkey").alias("document_id"), c("l_linenumber").alias("line_number"), header.alias("header"), item.alias("item"))


def _stated(number: int, keys: tuple[str, ...]) -> str:
    shown = [f"CAST({k} AS VARCHAR)" for k in keys] + ["NULL::VARCHAR"] * (3 - len(keys))
    return f"SELECT {number} AS question, {shown[0]} AS k1, {shown[1]} AS k2, {shown[2]} AS k3, count(*) AS item_count, CAST(round(sum(a), 2) AS DOUBLE) AS total_amount FROM items {'GROUP BY ' + ', '.join(keys) if keys else ''}"


@query(f"WITH items AS ({SOURCE}) {' UNION ALL '.join(_stated(i, keys) for i, (_, keys) in enumerate(ASKED))}")
def asked_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questions and their groups, with the keys as texts."""
    rows, told = _items(spark, sf_dir), []
    for number, (question, keys) in enumerate(ASKED):
        found = answer(question, rows, FIELDS, "summary")
        if tuple(found.columns) != (*keys, "item_count", "total_amount"):
            raise AssertionError(f"{question}: {found.columns}")
        shown = [F.col(k).cast("string") for k in keys] + [F.lit(None).cast("string")] * (3 - len(keys))
        told.append(found.select(F.lit(number).alias("question"), *(k.alias(f"k{i + 1}") for i, k in enumerate(shown)), "item_count", "total_amount"))
    return reduce(DataFrame.unionByName, told)


@query(f"""WITH items AS ({SOURCE}) SELECT row_number() OVER (ORDER BY d DESC, l_linenumber, customer_name, product, a) AS place, d AS purchase_date, customer_name, category, status, region, product, l_quantity AS quantity,
CAST(a AS DOUBLE) AS amount, l_linenumber AS row_number FROM items QUALIFY place <= 500""")
def latest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a report that lists every item with all its fields."""
    found = answer("List every line item with details", _items(spark, sf_dir), FIELDS).withColumns({"quantity": F.col("quantity").cast("double"), "amount": F.col("amount").cast("double")})
    page = found.orderBy(F.desc("purchase_date"), "row_number", "customer_name", F.col("product"), "amount").limit(500)
    place = F.row_number().over(Window.orderBy(F.desc("purchase_date"), "row_number", "customer_name", "product", "amount"))  # of the page's rows alone
    return page.withColumn("place", place)


@query("SELECT 'document' AS level, count(DISTINCT l_orderkey) AS total_count FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'item', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def asked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents and of items, as the question words them."""
    rows = _items(spark, sf_dir)
    asked = (("document", "How many orders are there?"), ("item", "Count the lines"))
    return reduce(DataFrame.union, (answer(q, rows, FIELDS).select(F.lit(level).alias("level"), "total_count") for level, q in asked))


CAP, NAME, FILE = "[A-Z][a-z]{2,}", "[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+", "[\\w-]+\\.(?:pdf|docx?|xlsx?|txt|md|csv)"


def _told(pattern: str) -> str:
    return f"list_reverse(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '_', 'g'), '\\b{pattern}\\b'))"


@query(f"""WITH told AS (SELECT conv_id, turn, role, text, {_told(FILE)} AS files, {_told(NAME)} AS people, {_told(CAP)} AS topics FROM conversations),
before AS (SELECT conv_id, turn, role, text, flatten(list_reverse(list(files) OVER w)) AS files, flatten(list_reverse(list(people) OVER w)) AS people, flatten(list_reverse(list(topics) OVER w)) AS topics
  FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, role, files[1] AS it, topics[1] AS this, CASE WHEN len(people) > 1 AND list_filter(people, lambda p: p <> people[1])[1] IS NOT NULL THEN people[1] || ', ' || list_filter(people, lambda p: p <> people[1])[1] ELSE people[1] END AS they FROM before""")
def referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `it`, `this` and `they` stand for at each turn of a conversation, from the ten turns before."""
    return resolved(table(spark, sf_dir, "conversations"), "conv_id", ("turn", "role", "text"), "text").select("conv_id", "turn", "role", "it", "this", "they")
