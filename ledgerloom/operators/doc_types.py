"""What kind of document a text is, how it is built and how it is to be chunked, from its name and from the patterns in it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.text import domain_scores

# Fixed values: (type, what stands in a file's name, trust), tried in this order.
NAME_RULES = (
    ("policy", ("policy", "policies", "_policy", "-policy"), 0.90),
    ("privacy_policy", ("privacy_policy", "privacy-policy", "privacypolicy"), 0.90),
    ("terms_of_service", ("terms_of_service", "terms-of-service", "tos", "terms_and_conditions"), 0.90),
    ("receipt", ("receipt", "rcpt", "_receipt", "-receipt"), 0.85),
    ("invoice", ("invoice", "inv_", "inv-", "_invoice", "-invoice"), 0.85),
    ("bank_statement", ("bank_statement", "bank-statement", "statement"), 0.85),
    ("expense_report", ("expense_report", "expense-report", "expenses"), 0.85),
    ("purchase_order", ("purchase_order", "purchase-order", "po_", "po-"), 0.85),
    ("inventory_report", ("inventory_report", "inventory-report", "stock_report", "stock-report"), 0.85),
    ("shipping_manifest", ("shipping", "manifest", "packing_list", "delivery_note", "bill_of_lading"), 0.85),
    ("contract", ("contract", "_contract", "-contract"), 0.85),
    ("patent", ("patent",), 0.85),
    ("research_paper", ("research_paper", "research-paper"), 0.85),
    ("thesis", ("thesis", "dissertation"), 0.85),
    ("medical_record", ("medical_record", "medical-record", "patient_record"), 0.85),
    ("prescription", ("prescription", "rx_"), 0.85),
    ("lab_result", ("lab_result", "lab-result", "blood_test"), 0.85),
    ("technical_spec", ("spec_", "specification", "requirement"), 0.85),
    ("user_manual", ("manual", "user_guide", "user-guide"), 0.85),
    ("resume", ("resume", "cv_", "_cv"), 0.85),
)
# Fixed values: (type, what stands in the text, trust), tried in this order when the name says nothing.
TEXT_RULES = (
    ("policy", ("return policy", "refund policy", "exchange policy", "company policy", "our policy", "this policy", "policy applies", "policy statement"), 0.75),
    ("privacy_policy", ("privacy policy", "data protection", "personal information", "gdpr"), 0.75),
    ("terms_of_service", ("terms of service", "terms and conditions", "by using this"), 0.75),
    ("contract", ("contract", "agreement", "whereas", "hereby", "party agrees"), 0.70),
    ("receipt", ("receipt", "rcpt", "meal-", "transaction receipt", "purchase receipt", "your receipt", "receipt number"), 0.75),
    ("invoice", ("invoice", "inv-", "bill to", "amount due", "invoice number", "invoice date", "payment terms"), 0.75),
    ("bank_statement", ("bank statement", "account balance", "statement of account", "opening balance", "closing balance", "account summary"), 0.75),
    ("expense_report", ("expense report", "expense claim", "reimbursement request", "employee expenses"), 0.75),
    ("purchase_order", ("purchase order", "p.o. number", "po number", "order confirmation"), 0.75),
    ("shipping_manifest", ("shipping manifest", "packing list", "delivery note", "bill of lading", "shipment details", "tracking number"), 0.75),
    ("inventory_report", ("inventory report", "inventory list", "stock report", "warehouse inventory", "inventory count", "stock level", "inventory management", "stock on hand", "quantity in stock"), 0.75),
    ("research_paper", ("research paper", "abstract", "methodology", "literature review", "findings", "conclusion", "references"), 0.70),
    ("thesis", ("thesis", "dissertation", "submitted in partial fulfillment"), 0.70),
    ("academic_article", ("et al.", "et al,", "[1]", "[2]", "doi:"), 0.65),
    ("medical_record", ("chief complaint", "history of present illness", "assessment and plan", "physical examination", "hpi", "ros"), 0.70),
    ("prescription", ("prescription", "rx", "take as directed", "refills"), 0.70),
    ("lab_result", ("lab result", "laboratory report", "blood test", "reference range"), 0.70),
    ("clinical_report", ("clinical report", "diagnosis", "treatment plan"), 0.65),
    ("textbook", ("textbook", "chapter exercises", "learning objectives"), 0.70),
    ("course_material", ("chapter", "learning objective", "key concepts"), 0.65),
    ("syllabus", ("syllabus", "course schedule", "grading policy"), 0.70),
    ("exam", ("exam", "quiz", "test questions", "answer the following"), 0.65),
    ("technical_spec", ("requirement", "req-", "spec-", "specification", "functional requirement", "technical requirement"), 0.70),
    ("api_documentation", ("api", "endpoint", "request body", "response format"), 0.65),
    ("user_manual", ("user manual", "user guide", "instructions", "how to use"), 0.70),
    ("resume", ("resume", "curriculum vitae", "work experience", "education background"), 0.70),
    ("cover_letter", ("cover letter", "dear hiring manager", "position applied"), 0.70),
)
# The type of a document of a domain whose name and text say nothing, and the domain that a type belongs to.
DOMAIN_TYPES = {
    "legal": "contract", "medical": "medical_record", "academic": "research_paper", "education": "course_material", "engineering": "technical_spec", "logistics": "shipping_manifest",
    "inventory": "inventory_report", "professional": "resume",
}
TYPE_DOMAINS = {
    "academic": ("research_paper", "thesis", "academic_article"), "education": ("textbook", "course_material", "syllabus", "exam", "tutorial"),
    "engineering": ("technical_spec", "api_documentation", "user_manual", "architecture_doc"), "medical": ("medical_record", "clinical_report", "prescription", "lab_result"),
    "legal": ("contract", "agreement", "terms_of_service", "privacy_policy", "policy"), "financial": ("receipt", "invoice", "bank_statement", "expense_report"),
}
# What a text is built of.
MARKERS = {
    "has_tables": r"(?mi)<table>|^\|.+\|.+\|$", "has_headers": r"(?m)^#{1,6}\s+", "has_lists": r"(?m)^\s*[-*•]\s+|^\s*\d+\.\s+", "has_code": r"```|<code>|<pre>",
    "has_equations": r"\$\$|\\\[|\\begin\{equation\}", "has_numbered_clauses": r"(?m)^\s*\d+\.\d+[\.\d]*\s+", "has_citations": r"\[\d+\]|\([A-Z][a-z]+,?\s*\d{4}\)",
    "has_form_fields": r":\s*_{3,}|\[\s*\]", "has_dates": r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}", "has_amounts": r"[\$€£¥]\s*[\d,]+\.?\d*",
}
# What a text must hold, one of them at least, for a marker to be looked for in it; plain search is far faster than the patterns.
NEEDLES = {
    "has_code": ("```", "<code>", "<pre>"), "has_equations": ("$$", "\\[", "\\begin{equation}"), "has_citations": ("[", "("), "has_form_fields": ("___", "["), "has_amounts": ("$", "€", "£", "¥"),
}
# Tokens of four characters below which a document is small, and above which it is large; (strategy, tokens of a chunk, percent that chunks overlap) of each domain.
SMALL, LARGE, TOKEN = 1000, 10000, 4
DOMAIN_STRATEGIES = {
    "legal": ("clause_preserving", 1024, 5), "academic": ("academic_structure", 768, 15), "medical": ("medical_section", 1024, 5), "engineering": ("requirement_based", 1024, 5),
    "education": ("educational_unit", 768, 10), "government": ("semantic_header", 1024, 5),
}
# Types whose tables are data, and types whose text is read also between tables.
TABULAR_TYPES = (
    "spreadsheet", "invoice", "receipt", "bank_statement", "credit_card_statement", "expense_report", "inventory_report", "purchase_order", "sales_order", "payroll", "financial_statement",
    "price_list", "data_export", "transaction_log", "shipping_manifest",
)
READ_TYPES = (
    "research_paper", "academic_article", "thesis", "dissertation", "contract", "agreement", "legal_document", "terms_of_service", "technical_spec", "user_manual", "documentation", "tutorial",
    "news_article", "blog_post", "report",
)
SKIP_AT = 0.6


class Rules:
    """One automaton over all patterns of all rules: a text is walked once, and of all patterns met the one that stands first in the rules counts."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...], float], ...]):
        self.ranked = [(kind, pattern, trust) for kind, patterns, trust in rules for pattern in patterns]
        self.automaton = ahocorasick.Automaton()
        for rank, (_, pattern, _) in reversed(list(enumerate(self.ranked))):  # of equal patterns the first stays
            self.automaton.add_word(pattern, rank)
        self.automaton.make_automaton()

    def first(self, text: str) -> tuple[str, str, float] | None:
        rank = min((r for _, r in self.automaton.iter(text)), default=None)
        return None if rank is None else self.ranked[rank]


def document_types(documents: DataFrame, key: str, filename: str, text: str, domain: str | None = None) -> DataFrame:
    """(key, document_type, trust, pattern, found_in) of every row: by a pattern of its file name, or else of its text, or else by its domain, or else `other`.

    Letter case doesn't matter. Trust is 0.5 without a pattern, and then pattern is null. A financial document without a pattern is a receipt if an amount stands in it, and a report otherwise. Missing names and texts say nothing.
    """
    kind = dict(documents.dtypes)[key]
    other = F.lit("other")
    if domain:
        other = F.when(F.col(domain) == "financial", F.when(F.coalesce(F.col(text), F.lit("")).rlike(MARKERS["has_amounts"]), "receipt").otherwise("report"))
        for d, t in DOMAIN_TYPES.items():
            other = other.when(F.col(domain) == d, t)
        other = other.otherwise("other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_name, by_text = Rules(NAME_RULES), Rules(TEXT_RULES)
        for batch in batches:
            rows = []
            for name, body, rest in zip(*(batch.column(c) for c in ("name", "body", "rest")), strict=True):
                if found := by_name.first(name.as_py() or ""):
                    rows.append((*found, "filename"))
                elif found := by_text.first(body.as_py() or ""):
                    rows.append((*found, "text"))
                else:
                    rows.append((rest.as_py(), None, 0.5, "domain"))
            types, patterns, trust, place = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(types, pa.string()), pa.array(trust, pa.float64()), pa.array(patterns, pa.string()), pa.array(place, pa.string())], ["key", "document_type", "trust", "pattern", "found_in"])

    rows = documents.select(F.col(key).alias("key"), F.lower(filename).alias("name"), F.lower(text).alias("body"), other.alias("rest"))
    return rows.mapInArrow(run, f"key {kind}, document_type string, trust double, pattern string, found_in string").withColumnRenamed("key", key)


def structure(text: Column) -> Column:
    """A struct of what a text is built of; a missing text of nothing."""

    def marked(name: str, pattern: str) -> Column:
        found = text.rlike(pattern.replace("(?m", "(?dm", 1) if pattern.startswith("(?m") else pattern)
        needles = [text.contains(x) for x in NEEDLES.get(name, ())]
        return F.coalesce(F.when(reduce(or_, needles), found) if needles else found, F.lit(False)).alias(name)

    return F.struct(*(marked(name, p) for name, p in MARKERS.items()))


def structure_type(m: Column) -> Column:
    """The kind of a text's structure, from `structure`."""
    tables = F.when(m["has_tables"], F.when(m["has_headers"], "mixed").otherwise("tabular"))
    return tables.when(m["has_numbered_clauses"], "clause_based").when(m["has_form_fields"], "form_based").when(m["has_headers"], "hierarchical").otherwise("narrative")


def domain_of_words(text: Column) -> Column:
    """The domain whose words a text has most of, the first of several; null without any."""
    scores = F.map_entries(domain_scores(F.coalesce(text, F.lit(""))))
    best = F.aggregate(scores, F.struct(F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("value")), lambda a, x: F.when(x["value"] > a["value"], x).otherwise(a))
    return best["key"]


def domain(document_type: Column, by_words: Column) -> Column:
    """The domain of a document's type, or else that of its words, or else `general`."""
    found = F.lit(None).cast("string")
    for name, types in TYPE_DOMAINS.items():
        found = F.when(document_type.isin(*types), name).otherwise(found)
    return F.coalesce(found, by_words, F.lit("general"))


def strategy(domain: Column, m: Column, tokens: Column) -> Column:
    """(strategy, chunk_size, overlap_percent) of a document, from its domain, its structure and its size."""
    way = lambda name, size, overlap: F.struct(F.lit(name).alias("strategy"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("overlap_percent"))
    small = tokens < SMALL
    chosen = F.when(small & ~m["has_headers"], way("whole_document", 0, 0))
    for name, base in DOMAIN_STRATEGIES.items():
        if name != "legal":
            chosen = chosen.when((domain == name) & m["has_tables"], way("table_preserving", 1024, 10))
        chosen = chosen.when(domain == name, way(*base))
    chosen = chosen.when((domain == "financial") & m["has_tables"], way("table_preserving", 1024, 15)).when((domain == "financial") & small, way("whole_document", 0, 0))
    chosen = chosen.when(domain == "financial", way("semantic_header", 512, 10)).when(m["has_numbered_clauses"], way("clause_preserving", 1024, 5))
    chosen = chosen.when(m["has_citations"] | m["has_equations"], way("academic_structure", 768, 15)).when(m["has_tables"], way("table_preserving", 1024, 10))
    return chosen.when(m["has_headers"], way("semantic_header", 512, 10)).otherwise(way("paragraph", 768, 15))


def table_measures(text: Column) -> Column:
    """A struct of the share of a text's characters that is in lines of tables, the number of their rows and the rows' mean length."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    ruled = lambda x: x.contains("|") & (F.regexp_count(x, F.lit("-")) > 5)
    kinds = F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), F.ltrim(x).startswith("|").alias("row"), ruled(x).alias("rule")))
    none = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("rows"), F.lit(0).alias("row_chars"))

    def add(a: Column, x: Column) -> Column:
        data = (x["row"] & ~x["rule"]).cast("int")
        return F.struct((a["chars"] + F.when(x["row"] | x["rule"], x["n"]).otherwise(0)).alias("chars"), (a["rows"] + data).alias("rows"), (a["row_chars"] + data * x["n"]).alias("row_chars"))

    finish = lambda a: F.struct((a["chars"] / F.greatest(F.length(text), F.lit(1))).alias("share"), a["rows"].alias("rows"), (a["row_chars"] / F.greatest(a["rows"], F.lit(1))).alias("width"))
    return F.aggregate(kinds, none, add, finish)


def skip_score(document_type: Column, m: Column) -> Column:
    """How much speaks for one summary instead of a chunk for every few rows of a table: the type, the share of the text in tables, and many short rows. 0 for types that are read."""
    tables = F.when(m["share"] < 0.5, 0.0).when(m["share"] < 0.7, 0.15).when(m["share"] < 0.85, 0.25).otherwise(0.35)
    dense = F.when((m["rows"] > 50) & (m["width"] < 200), 0.25).when((m["rows"] > 20) & (m["width"] < 300), 0.15).when(m["rows"] > 10, 0.1).otherwise(0.0)
    score = F.when(F.lower(document_type).isin(*TABULAR_TYPES), 0.4).otherwise(0.1) + tables + dense
    return F.when(F.lower(document_type).isin(*READ_TYPES), 0.0).otherwise(F.round(score, 2))


def profiles(documents: DataFrame, key: str, filename: str, text: str) -> DataFrame:
    """(key, filename, text, document_type, domain, structure, tokens, strategy, chunk_size, overlap_percent, skip_score, skip_rows): what each document is chunked by.

    A text is measured, then types are found in one pass over the texts, which are carried along with the measures; nothing is shuffled. skip_rows says that a table is told by one summary.
    """
    body = F.col(text)
    measured = documents.select(
        F.struct(
            F.col(key).alias("key"), F.col(filename).alias("filename"), body.alias("text"), structure(body).alias("marks"), domain_of_words(body).alias("words"), table_measures(body).alias("tables"),
            F.floor(F.length(F.coalesce(body, F.lit(""))) / TOKEN).cast("long").alias("tokens"),
        ).alias("row"),
        F.col(filename).alias("filename"), body.alias("text"),
    )
    typed = document_types(measured, "row", "filename", "text").select("row.*", "document_type")
    chosen = typed.withColumn("domain", domain(F.col("document_type"), F.col("words"))).withColumn("way", strategy(F.col("domain"), F.col("marks"), F.col("tokens")))
    score = F.when(F.col("way.strategy") == "table_preserving", skip_score(F.col("document_type"), F.col("tables"))).otherwise(0.0)
    return chosen.select(
        F.col("key").alias(key), "filename", "text", "document_type", "domain", structure_type(F.col("marks")).alias("structure"), "tokens", "way.strategy", "way.chunk_size", "way.overlap_percent",
        score.alias("skip_score"), (score >= SKIP_AT).alias("skip_rows"),
    )
