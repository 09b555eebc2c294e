"""Queries over texts: documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, numbers, scoring
from ledgerloom.operators import entities, fields
from ledgerloom.operators import text as T
from ledgerloom.registry import query
from ledgerloom.tables import table


@query("""WITH l AS (SELECT doc_id, unnest([trim(x, ' ') for x in string_split(coalesce(text, ''), chr(10)) if trim(x, ' ') <> '']) AS line, generate_subscripts([trim(x, ' ') for x in string_split(coalesce(text, ''), chr(10)) if trim(x, ' ') <> ''], 1) AS i FROM documents),
m AS (SELECT *, CASE WHEN left(line, 10) = lag(left(line, 10)) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT doc_id, CAST(min(i) AS INTEGER) AS first_line, CAST(count(*) AS INTEGER) AS lines, arg_min(line, i) AS repeated FROM r GROUP BY doc_id, k HAVING count(*) > 2""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than two lines with the same beginning."""
    return T.loops(table(spark, sf_dir, "documents"), "doc_id", "text", lines=2)


@query("""SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, CASE WHEN length(text) < 4 * 1536 THEN 'whole' ELSE 'cut' END AS handling, sha256(trim(regexp_replace(lower(trim(text, ' ')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS text_key
FROM documents WHERE text IS NOT NULL""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    key = F.sha2(F.trim(F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")), 256)
    return docs.select("doc_id", scoring.tokens(F.col("text"), 1).alias("tokens"), F.when(F.length("text") < 4 * T.LARGE, "whole").otherwise("cut").alias("handling"), key.alias("text_key"))


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS text_md5 FROM pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text_md5"))


@query("""SELECT doc_id, regexp_matches(text, '(?m)^[ \\t]*\\|.*\\|') AS has_table, contains(text, '```') AS has_code, len(regexp_extract_all(text, '(?i)\\b(?:invoice|total|tax|payment|balance)\\b')) AS financial FROM documents WHERE text IS NOT NULL""")
def content_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("m", T.markers(F.col("text")))
    return docs.select("doc_id", F.col("m.table").alias("has_table"), F.col("m.code").alias("has_code"), F.regexp_count("text", F.lit(T.DOMAINS["financial"])).cast("long").alias("financial"))


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every text, split at line ends, merged and cut to size."""
    return T.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", "line")


@query()
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", dates.find_dates(F.coalesce("text", F.lit(""))).cast("array<string>").alias("dates"))


@query()
def tabular_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that count as tabular, and why."""
    reasons = F.array_compact(F.array(scoring.is_tabular(F.col("text"))))  # a filter would find the reason twice
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(reasons).alias("reason"))


@query("SELECT s_suppkey AS vendor_id, md5('w:VENDOR:' || lower(trim(s_name))) AS entity_id, replace(lower(s_name), '#', '') AS slug FROM supplier")
def vendor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vendor_id"), names.entity_key(F.lit("w"), F.lit("VENDOR"), name).alias("entity_id"), names.slug(name).alias("slug"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_acctbal WHEN 2 THEN NULL ELSE CAST(c_custkey AS DOUBLE) END AS number, c_custkey % 4 = 1 AS monetary FROM customer")
def parsed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a table shows them: missing, with a sign of money, in words, and whole."""
    rows = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    shown = F.when(k == 0, "n/a").when(k == 1, F.concat(F.lit("$"), F.format_number("c_acctbal", 2))).when(k == 2, "about ten").otherwise(F.format_number("c_custkey", 0))
    cell = numbers.parse_cell(shown)
    return rows.select("c_custkey", cell["number"].alias("number"), cell["monetary"].alias("monetary"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 10 AND 20")
def filtered_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range over a field inside JSON; values that are no numbers are in none."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k BETWEEN 10 AND 20")


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\b[A-Z]\\d{2}(?:\\.\\d{1,2})?\\b')) AS icd_codes, len(regexp_extract_all(coalesce(text, ''), '(?i)\\b\\w+\\s+\\d+(?:\\.\\d+)?\\s*(?:mg|mcg|ml|units?|g)\\b')) AS medications,
len(regexp_extract_all(coalesce(text, ''), '\\[[\\d,\\s\\-]+\\]|\\([A-Z][a-z]+(?:\\s+et\\s+al\\.?)?,?\\s*\\d{4}[a-z]?\\)')) AS citations, len(regexp_extract_all(coalesce(text, ''), '(?i)(?:Figure|Fig\\.?|Table)\\s+\\d+(?:\\.\\d+)?')) AS figures FROM documents""")
def domain_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, doses, citations and figures in every text."""
    return table(spark, sf_dir, "documents").select("doc_id", T.marks(F.col("text")).alias("m")).select("doc_id", "m.icd_codes", "m.medications", "m.citations", "m.figures")


@query()
def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations and persons that the patterns find in every text, merged by normal form."""
    return entities.merged("doc_id", entities.in_text(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("""WITH v AS (SELECT unnest([{'field': 'l_orderkey', 'value': CAST(l_orderkey AS VARCHAR)}, {'field': 'l_quantity', 'value': CAST(l_quantity AS VARCHAR)}, {'field': 'l_returnflag', 'value': l_returnflag}, {'field': 'l_tax', 'value': CAST(l_tax AS VARCHAR)},
{'field': 'l_shipdate', 'value': CAST(l_shipdate AS VARCHAR)}, {'field': 'l_linestatus', 'value': l_linestatus}], recursive := true) FROM lineitem),
p AS (SELECT field, bool_and(try_cast(value AS DOUBLE) IS NOT NULL) AS numbers, count(DISTINCT value) < 0.5 * count(value) AS few FROM v GROUP BY field)
SELECT field, CASE field WHEN 'l_tax' THEN 'amount' WHEN 'l_quantity' THEN 'quantity' WHEN 'l_shipdate' THEN 'date' WHEN 'l_linestatus' THEN 'status' ELSE CASE WHEN numbers THEN 'quantity' WHEN few THEN 'category' ELSE 'unknown' END END AS semantic_type,
CASE field WHEN 'l_tax' THEN 'number' WHEN 'l_quantity' THEN 'number' WHEN 'l_shipdate' THEN 'datetime' WHEN 'l_linestatus' THEN 'string' ELSE CASE WHEN numbers THEN 'number' ELSE 'string' END END AS data_type FROM p""")
def inferred_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What columns of line items mean, by their names or else by all their values."""
    columns = ["l_orderkey", "l_quantity", "l_returnflag", "l_tax", "l_shipdate", "l_linestatus"]
    return fields.inferred(fields.values(table(spark, sf_dir, "lineitem"), columns)).select("field", "semantic_type", "data_type")
