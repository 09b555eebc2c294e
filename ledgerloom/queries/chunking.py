"""Queries of what documents are and how they are chunked. Lines of the documents are given headings, bars or numbers by their place, so that all structures come up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import chunk_trees as C
from ledgerloom.operators import doc_types as D
from ledgerloom.operators.text import DOMAINS
from ledgerloom.registry import query
from ledgerloom.tables import table

SHAPED = """SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 11 WHEN 1 THEN '_invoice.pdf' WHEN 2 THEN '_Stock_Report.md' WHEN 3 THEN '_user-guide.txt' ELSE '.txt' END AS filename,
  array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE doc_id % 5 WHEN 1 THEN CASE WHEN i % 2 = 1 THEN repeat('#', CAST(1 + i % 3 AS INTEGER)) || ' ' || l ELSE l END
  WHEN 2 THEN CASE WHEN i = 2 THEN '|------|------|' ELSE '| ' || replace(l, ' ', ' | ') || ' |' END WHEN 3 THEN CAST(i AS VARCHAR) || '.1 ' || l ELSE l END), chr(10)) AS text FROM documents"""


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, way = F.col, F.col("doc_id") % 5

    def shape(line, i):
        heading = F.when(i % 2 == 0, F.concat(F.expr("repeat('#', 1)"), F.when((i + 1) % 3 == 1, "#").when((i + 1) % 3 == 2, "##").otherwise(""), F.lit(" "), line)).otherwise(line)
        row = F.when(i == 1, "|------|------|").otherwise(F.concat(F.lit("| "), F.replace(line, F.lit(" "), F.lit(" | ")), F.lit(" |")))
        return F.when(way == 1, heading).when(way == 2, row).when(way == 3, F.concat((i + 1).cast("string"), F.lit(".1 "), line)).otherwise(line)

    end = F.when(c("doc_id") % 11 == 1, "_invoice.pdf").when(c("doc_id") % 11 == 2, "_Stock_Report.md").when(c("doc_id") % 11 == 3, "_user-guide.txt").otherwise(".txt")
    text = F.array_join(F.transform(F.split("text", "\n"), shape), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("_"), c("doc_id").cast("string"), end).alias("filename"), text.alias("text"))


def _first(column: str, rules, place: str) -> str:
    """The rules as the branches of a CASE, one for each pattern, giving type, trust and pattern."""
    return " ".join(f"WHEN contains({column}, '{p}') THEN {{'document_type': '{kind}', 'trust': {trust}::DOUBLE, 'pattern': '{p}', 'found_in': '{place}'}}" for kind, patterns, trust in rules for p in patterns)


TYPED = f"""SELECT *, CASE {_first('name', D.NAME_RULES, 'filename')} {_first('body', D.TEXT_RULES, 'text')} ELSE {{'document_type': 'other', 'trust': 0.5::DOUBLE, 'pattern': NULL, 'found_in': 'domain'}} END AS t
FROM (SELECT *, lower(coalesce(filename, '')) AS name, lower(coalesce(text, '')) AS body FROM ({SHAPED}))"""


@query(f"SELECT doc_id, t.document_type, t.trust, t.pattern, t.found_in FROM ({TYPED})")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each document by the first pattern of all types in its name, or else in its text."""
    return D.document_types(_shaped(spark, sf_dir), "doc_id", "filename", "text")


def _marks() -> str:
    return ", ".join(f"coalesce(regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}'), false) AS {name}" for name, p in D.MARKERS.items())


DOMAIN_WORDS = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) AS n_{name}" for name, p in DOMAINS.items())
BY_WORDS = " ".join(f"WHEN n_{d} > 0 AND n_{d} >= greatest({', '.join(f'n_{x}' for x in DOMAINS)}) THEN '{d}'" for d in DOMAINS)
BY_TYPE = " ".join(f"WHEN t.document_type IN ({', '.join(repr(x) for x in types)}) THEN '{d}'" for d, types in D.TYPE_DOMAINS.items())
PROFILED = f"""
SELECT *, CASE WHEN has_tables THEN CASE WHEN has_headers THEN 'mixed' ELSE 'tabular' END WHEN has_numbered_clauses THEN 'clause_based' WHEN has_form_fields THEN 'form_based' WHEN has_headers THEN 'hierarchical' ELSE 'narrative' END AS structure,
CASE WHEN tokens < 1000 AND NOT has_headers THEN 'whole_document'
WHEN domain IN ('academic', 'medical', 'engineering', 'education') AND has_tables THEN 'table_preserving' WHEN domain = 'legal' THEN 'clause_preserving' WHEN domain = 'academic' THEN 'academic_structure'
WHEN domain = 'medical' THEN 'medical_section' WHEN domain = 'engineering' THEN 'requirement_based' WHEN domain = 'education' THEN 'educational_unit'
WHEN domain = 'financial' AND has_tables THEN 'table_preserving' WHEN domain = 'financial' AND tokens < 1000 THEN 'whole_document' WHEN domain = 'financial' THEN 'semantic_header'
WHEN has_numbered_clauses THEN 'clause_preserving' WHEN has_citations OR has_equations THEN 'academic_structure' WHEN has_tables THEN 'table_preserving' WHEN has_headers THEN 'semantic_header' ELSE 'paragraph' END AS strategy
FROM (SELECT *, CASE {BY_TYPE} {BY_WORDS} ELSE 'general' END AS domain, length(coalesce(text, '')) // 4 AS tokens FROM (SELECT *, {_marks()}, {DOMAIN_WORDS} FROM ({TYPED})))"""
SKIPPED = f"""
SELECT *, CASE WHEN strategy <> 'table_preserving' OR t.document_type IN ({', '.join(repr(x) for x in D.READ_TYPES)}) THEN 0.0 ELSE round(CASE WHEN t.document_type IN ({', '.join(repr(x) for x in D.TABULAR_TYPES)}) THEN 0.4 ELSE 0.1 END
+ CASE WHEN share < 0.5 THEN 0 WHEN share < 0.7 THEN 0.15 WHEN share < 0.85 THEN 0.25 ELSE 0.35 END + CASE WHEN n > 50 AND width < 200 THEN 0.25 WHEN n > 20 AND width < 300 THEN 0.15 WHEN n > 10 THEN 0.1 ELSE 0 END, 2) END AS skip_score
FROM (SELECT *, list_sum(list_transform(tabled, lambda x: length(x))) / greatest(length(text), 1) AS share, len(data) AS n, list_sum(list_transform(data, lambda x: length(x))) / greatest(len(data), 1) AS width
FROM (SELECT *, list_filter(lines, lambda x: ltrim(x, ' ') LIKE '|%' OR contains(x, '|') AND length(x) - length(replace(x, '-', '')) > 5) AS tabled,
list_filter(lines, lambda x: ltrim(x, ' ') LIKE '|%' AND NOT (length(x) - length(replace(x, '-', '')) > 5)) AS data FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM ({PROFILED}))))"""


@query(f"""SELECT doc_id, t.document_type, domain, structure, tokens, strategy, CAST(CASE strategy WHEN 'whole_document' THEN 0 WHEN 'academic_structure' THEN 768 WHEN 'educational_unit' THEN 768 WHEN 'paragraph' THEN 768
WHEN 'semantic_header' THEN 512 ELSE 1024 END AS INTEGER) AS chunk_size, CAST(CASE strategy WHEN 'whole_document' THEN 0 WHEN 'academic_structure' THEN 15 WHEN 'paragraph' THEN 15
WHEN 'table_preserving' THEN CASE domain WHEN 'financial' THEN 15 ELSE 10 END WHEN 'educational_unit' THEN 10 WHEN 'semantic_header' THEN 10 ELSE 5 END AS INTEGER) AS overlap_percent,
skip_score::DOUBLE AS skip_score, skip_score >= 0.6 AS skip_rows FROM ({SKIPPED})""")
def chunking_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document is, how it is built, and the strategy that it is chunked by."""
    return D.profiles(_shaped(spark, sf_dir), "doc_id", "filename", "text").drop("filename", "text")


@query(f"SELECT strategy, skip_score >= 0.6 AS summarized, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM ({SKIPPED}) WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0 GROUP BY ALL")
def adaptively_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with chunks, and their characters, by the strategy that made the chunks; those told by one summary are counted apart."""
    profiled = D.profiles(_shaped(spark, sf_dir), "doc_id", "filename", "text").withColumn("chars", F.length("text"))
    first = C.adaptive_chunks(profiled, "doc_id", kept=["strategy", "chars"]).where("chunk_index = 0")
    return first.groupBy("strategy", (F.col("chunk_type") == "tabular_summary").alias("summarized")).agg(F.count("*").alias("documents"), F.sum("chars").cast("long").alias("chars"))


@query(f"""WITH lines AS (
  SELECT doc_id, i, l, regexp_matches(l, '^#{{1,5}}[ \t]') AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM ({SHAPED}) WHERE trim(text, ' ' || chr(9) || chr(10)) <> '')
), numbered AS (
  SELECT *, sum(heading::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS s, max(i) OVER (PARTITION BY doc_id) AS last, sum(CASE WHEN trim(l, ' ' || chr(9)) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS full_lines FROM lines
), cut AS (
  SELECT doc_id, s, sum(length(l) + CASE WHEN i < last THEN 1 ELSE 0 END) AS n FROM numbered GROUP BY doc_id, s
), counted AS (
  SELECT doc_id, count(*) AS n_sections, count(*) FILTER (n > 1024) AS n_parents FROM cut GROUP BY doc_id
)
SELECT doc_id, n_sections, n_parents, md5(text) AS sections_md5, md5(text) AS leaves_md5 FROM counted JOIN ({SHAPED}) USING (doc_id)""")
def section_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and long sections of each document; the sections together, and the smallest parts together, are its text."""
    nodes = C.chunk_trees(_shaped(spark, sf_dir), "doc_id", "text")
    told = lambda test: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("chunk_index", "chunk")))), lambda x: x["chunk"]), ""))
    own = F.col("parent").isNull()
    return nodes.groupBy("doc_id").agg(
        F.count(F.when(own, 1)).alias("n_sections"), F.count(F.when(F.col("chunk_type") == "parent", 1)).alias("n_parents"),
        told(own).alias("sections_md5"), told(F.col("chunk_type") != "parent").alias("leaves_md5"),
    )


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '(?m)^[ \t]*(?:\\d+\\.)+\\d*\\s+\\S')) AS clauses FROM ({SHAPED}) WHERE doc_id % 5 = 3 AND text IS NOT NULL""")
def clause_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of the documents whose lines are numbered, counted in the groups that they are packed in."""
    shaped = _shaped(spark, sf_dir).where("doc_id % 5 = 3 AND text IS NOT NULL")
    groups = C.clause_chunks(shaped, "doc_id", "text").where("chunk_type = 'clause_group'")
    count = groups.groupBy("doc_id").agg(F.sum(F.regexp_count("chunk", F.lit(r"(?m)^(?:\d+\.)+\d*\s+\S"))).cast("long").alias("clauses"))
    return shaped.select("doc_id").join(count, "doc_id", "left").select("doc_id", F.coalesce("clauses", F.lit(0)).alias("clauses"))


@query("""SELECT doc_id, len(lines) - 1 AS rows, md5(array_to_string(lines[2:], chr(10))) AS rows_md5 FROM (SELECT doc_id, [replace(replace(l, '"', ''), ',', ';') || ',' || i FOR l, i IN string_split(text, chr(10))] AS lines FROM documents WHERE text IS NOT NULL)
WHERE len(lines) > 1 AND length(lines[1]) // 4 < 200""")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of delimited texts from the batches that they are cut in, whose heads are taken off again."""
    clean = lambda x, i: F.concat(F.replace(F.replace(x, F.lit('"'), F.lit("")), F.lit(","), F.lit(";")), F.lit(","), (i + 1).cast("string"))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), clean).alias("lines"))
    rows = docs.where((F.size("lines") > 1) & (F.floor(F.length(F.get("lines", F.lit(0))) / 4) < 200)).select("doc_id", F.array_join("lines", "\n").alias("text"))
    cut = C.csv_chunks(rows, "doc_id", "text", 300).withColumn("own", F.substr("chunk", F.length("table_header") + 2))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "own"))), lambda x: x["own"]), "\n")
    return cut.groupBy("doc_id").agg(whole.alias("body")).select("doc_id", F.size(F.split("body", "\n")).cast("long").alias("rows"), F.md5("body").alias("rows_md5"))
