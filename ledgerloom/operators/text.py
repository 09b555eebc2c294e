"""Cleaning, measuring and chunking of texts, and tables inside them. A text is worked on as a whole, in the task that has read it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens of a chunk (a token is four characters), lines of a loop and what they share, rows of a table's batch.
SMALL, LARGE, TARGET = 256, 1536, 1024
LOOP_LINES, LOOP_PREFIX = 20, 10
TABLE_ROWS = 20
#: Parts of texts that a task hands on at once.
PARTS = 4096
# Where each strategy splits, and the words that speak for a domain.
MEDICAL_HEADINGS = (
    "Chief Complaint", "CC", "History of Present Illness", "HPI", "Past Medical History", "PMH", "Past Surgical History", "PSH", "Medications", "Current Medications", "Meds", "Allergies",
    "Social History", "SH", "Family History", "FH", "Review of Systems", "ROS", "Physical Exam", "PE", "Physical Examination", "Vital Signs", "Vitals", "Laboratory", "Labs", "Lab Results",
    "Imaging", "Radiology", "Assessment", "Impression", "Plan", "Treatment Plan", "Diagnosis", "Diagnoses", "Recommendations", "Follow-up", "Follow Up", "Disposition",
)
ACADEMIC_HEADINGS = (
    "abstract", "introduction", "background", "literature review", "method", "methods", "methodology", "result", "results", "discussion", "discussions", "conclusion", "conclusions",
    "acknowledgment", "acknowledgments", "reference", "references", "bibliography", "appendix",
)
SPLITS = {
    "heading": r"(?m)^(?=#{1,6}\s)", "paragraph": r"\n\s*\n", "clause": r"(?m)^(?=\d+(?:\.\d+)*\.?\s+[A-Z])", "article": r"(?m)^(?=(?:ARTICLE|Article)\s+[IVXLC\d]+)",
    "section": r"(?m)^(?=(?:SECTION|Section)\s+\d+)", "academic": rf"(?im)^(?=(?:#+\s*)?(?:\d+\.?\s+)?(?:{'|'.join(ACADEMIC_HEADINGS)})[:\s]*$)",
    "medical": rf"(?im)^(?=(?:{'|'.join(map(re.escape, MEDICAL_HEADINGS))})[:\s])",
    "educational": r"(?im)^(?=(?:chapter|unit|module|lesson)\s+\d+)", "requirement": r"(?m)^(?=(?:REQ|SPEC|SRS|SDD|ICD|HLD|LLD)-?\d+)", "line": r"\n",
}
DOMAINS = {
    "legal": r"(?i)\b(?:agreement|party|parties|hereby|clause|liability)\b", "medical": r"(?i)\b(?:patient|diagnosis|mg|dose|treatment)\b",
    "financial": r"(?i)\b(?:invoice|total|tax|payment|balance)\b", "academic": r"(?i)\b(?:abstract|references|et al|method|results)\b",
}
REQUIREMENT_WORDS = (("must", r"(?i)\b(?:shall|must)\b"), ("should", r"(?i)\bshould\b"), ("may", r"(?i)\bmay\b"))


def without_images(text: Column) -> Column:
    """Embedded images as `[image]`, runs of blank lines as one, no white space at line ends."""
    bare = F.regexp_replace(text, r"!\[[^\]]*\]\(data:image/[^)]*\)", "[image]")
    bare = F.regexp_replace(bare, r"data:image/[a-z+]+;base64,[A-Za-z0-9+/=]+", "[image]")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def mostly_base64(text: Column, share: float = 0.5) -> Column:
    """Whether more than a share of a text is in long runs of base64."""
    rest = F.length(F.regexp_replace(text, r"[A-Za-z0-9+/=]{100,}", ""))
    return F.coalesce((F.length(text) - rest) / F.greatest(F.length(text), F.lit(1)) > share, F.lit(False))


def loops(documents: DataFrame, key: str, text: str, lines: int = LOOP_LINES, prefix: int = LOOP_PREFIX) -> DataFrame:
    """(key, first_line, lines, repeated): runs of more than so many consecutive non-empty lines that are equal or share their beginning.

    A text's lines are folded in order inside its row, so that no line is shuffled and a very long text needs no window of its own.
    """
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = lambda x: F.left(x, F.lit(prefix))
    starts = F.filter(F.transform(F.col("rows"), lambda x, i: F.when((i == 0) | (head(x) != head(F.get(F.col("rows"), i - 1))), i)), lambda i: i.isNotNull())
    runs = F.transform(F.col("starts"), lambda s, i: F.struct((s + 1).alias("first_line"), (F.coalesce(F.get(F.col("starts"), i + 1), F.size("rows")) - s).alias("lines"), F.get(F.col("rows"), s).alias("repeated")))
    cut = documents.select(key, rows.alias("rows")).withColumn("starts", starts)
    return cut.select(key, F.inline(F.filter(runs, lambda r: r["lines"] > lines)))


def markers(text: Column) -> Column:
    """Whether a text holds a table, a list, code, an image or a formula."""
    return F.struct(
        text.rlike(r"(?m)^\s*\|.*\|").alias("table"), text.rlike(r"(?m)^\s*(?:[-*+]|\d+\.)\s").alias("list"), text.contains("```").alias("code"),
        text.rlike(r"!\[[^\]]*\]\(").alias("image"), text.rlike(r"\$\$|\\\[|\\begin\{").alias("formula"),
    )


# What is counted in a chunk of a domain.
MARKS = {
    "icd_codes": r"\b[A-Z]\d{2}(?:\.\d{1,2})?\b", "medications": r"(?i)\b\w+\s+\d+(?:\.\d+)?\s*(?:mg|mcg|ml|units?|g)\b", "vitals": r"(?i)(?:BP|HR|RR|Temp|SpO2|Weight|Height)[:\s]*[\d/.]+",
    "citations": r"\[[\d,\s\-]+\]|\([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}[a-z]?\)", "figures": r"(?i)(?:Figure|Fig\.?|Table)\s+\d+(?:\.\d+)?",
    "objectives": r"(?im)^(?:Learning\s+)?(?:Objectives?|Outcomes?|Goals?)[:\s]*", "exercises": r"(?im)^(?:Exercise|Problem|Question|Activity|Practice)\s+\d+",
    "answers": r"(?im)^(?:Answer|Solution|Key)[:\s]*", "examples": r"(?im)^Example\s*\d*[:\s]*", "definitions": r"(?im)^(?:Definition|Term)[:\s]*.+",
}


def marks(text: Column) -> Column:
    """Numbers of a domain's marks in a text: codes, doses and vital signs, citations and figures, parts of a lesson; a missing text has none."""
    return F.struct(*(F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long").alias(name) for name, p in MARKS.items()))


def domain_scores(text: Column) -> Column:
    """A map of each domain's words in a text, as a share of the most. The counts are one array that is made once: named for each share and for the most, every pattern would be counted anew each time."""
    counts = F.array(*(F.regexp_count(text, F.lit(p)).cast("double") for p in DOMAINS.values()))
    shares = F.transform(F.array(counts), lambda n: F.transform(n, lambda x: x / F.greatest(F.array_max(n), F.lit(1.0))))
    return F.map_from_arrays(F.array(*map(F.lit, DOMAINS)), F.get(shares, F.lit(0)))


def obligation(text: Column) -> Column:
    """The strongest of must, should and may in a requirement; null without any."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(REQUIREMENT_WORDS):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def split_long(text: str, target: int, most: int) -> list[str]:
    """A text in parts of at most `most` characters: each ends, behind its `target` where it can, at a paragraph, a sentence or a space."""
    parts = []
    while len(text) > most:
        window = text[max(100, target - 200) : most]
        base = max(100, target - 200)
        at = next((base + window.rfind(mark) + len(mark) for mark in ("\n\n", ". ", " ") if window.rfind(mark) >= 0), most)
        parts.append(text[:at].strip())
        text = text[at:]
    return [p for p in [*parts, text.strip()] if p]


def chunk(text: str, pattern: str, small: int = SMALL, large: int = LARGE, target: int = TARGET, overlap: float = 0.0) -> list[str]:
    """Chunks of a text: it is split where the pattern matches outside tables and code, parts below `small` tokens join the one before, parts over `large` are cut, and each may begin with the end of the one before."""
    kept = [m.span() for m in re.finditer(r"(?s)```.*?```|(?m:^\|.*\|[ \t]*(?:\n|$))+", text)]
    inside = lambda at: any(a < at < b for a, b in kept)
    cuts = [0, *(m.end() for m in re.finditer(pattern, text) if 0 < m.end() < len(text) and not inside(m.end())), len(text)]
    parts = [p for a, b in zip(cuts, cuts[1:], strict=False) if (p := text[a:b].strip())]
    joined: list[str] = []
    for p in parts:
        if joined and (len(joined[-1]) < 4 * small or len(p) < 4 * small) and len(joined[-1]) + len(p) <= 4 * large:
            joined[-1] = f"{joined[-1]}\n\n{p}"
        else:
            joined.append(p)
    out = [x for p in joined for x in split_long(p, 4 * target, 4 * large)]
    if not overlap:
        return out
    tails = [""] + [p[-int(len(p) * overlap) :] for p in out[:-1]]
    snapped = [t[m.end() :] if (m := re.search(r"[.!?]\s", t)) else t for t in tails]
    return [f"{t}\n{p}" if t else p for t, p in zip(snapped, out, strict=True)]


def _mapped(documents: DataFrame, key: str, text: str, cut: Callable[[str], list], schema: str) -> DataFrame:
    """A row for each part that cut makes of a text, numbered from 0."""
    kind = dict(documents.dtypes)[key]
    name = schema.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, found = [], [], []
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                parts = cut(t.as_py() or "")
                keys += [k] * len(parts)
                numbers += range(len(parts))
                found += parts
                if len(found) >= PARTS:
                    yield made(batch, keys, numbers, found)
                    keys, numbers, found = [], [], []
            yield made(batch, keys, numbers, found)

    def made(batch: pa.RecordBatch, keys: list, numbers: list[int], found: list[str]) -> pa.RecordBatch:
        columns = [pa.array([k.as_py() for k in keys], batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(found, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[key, "chunk_index", name])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, {schema}")


def chunks(documents: DataFrame, key: str, text: str, strategy: str = "paragraph", **sizes) -> DataFrame:
    """(key, chunk_index, chunk) of every text by a named strategy; an empty or missing text has no chunk."""
    pattern = SPLITS[strategy]
    return _mapped(documents, key, text, lambda t: chunk(t, pattern, **sizes), "chunk string")


def table_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_index, row_number, cells): rows of the markdown tables in a text, as maps by column; rows with another number of cells are left out."""

    def tables(t: str) -> list[str]:
        found = []
        cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
        for block in re.findall(r"(?m)(?:^[ \t]*\|.*\|[ \t]*(?:\n|$))+", t):
            lines = block.strip().split("\n")
            if len(lines) > 2 and re.fullmatch(r"[\s|:\-]+", lines[1]):
                head = cells(lines[0])
                found.append(json.dumps([dict(zip(head, row, strict=True)) for row in map(cells, lines[2:]) if len(row) == len(head)]))
        return found

    rows = F.from_json("rows", "array<map<string,string>>")
    return _mapped(documents, key, text, tables, "rows string").select(key, F.col("chunk_index").alias("table_index"), F.posexplode(rows).alias("row_number", "cells"))


def table_batches(lines: DataFrame, key: str, order: str, size: int = TABLE_ROWS) -> DataFrame:
    """Rows of tables with the number of their batch: `order` counts them from 0, so that no window is needed."""
    return lines.withColumn("batch", F.floor(F.col(order) / size).cast("int"))


def with_rules(text: str) -> str:
    """Markdown tables that lack the line under their head get one."""
    lines = text.split("\n")
    out: list[str] = []
    is_row = lambda x: x.count("|") >= 2 and x.strip().startswith("|")
    for i, line in enumerate(lines):
        out.append(line)
        first = is_row(line) and not (i and is_row(lines[i - 1]))
        if first and i + 1 < len(lines) and is_row(lines[i + 1]) and not re.fullmatch(r"[\s|:\-]+", lines[i + 1]):
            out.append("|" + " --- |" * (line.strip().count("|") - 1))
    return "\n".join(out)


def html_text(html: Column) -> Column:
    """The visible text of a page: no scripts, styles, comments or tags, entities of five signs resolved, single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), "&nbsp;", " ")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def html_rows(html: Column) -> Column:
    """Rows of a page's tables as markdown lines; a cell's tags go."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.replace(html_text(c), F.lit("|"), F.lit("\\|")))
    return F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |")))
