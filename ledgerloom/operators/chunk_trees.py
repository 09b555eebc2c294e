"""Chunks that know where they stand: sections under their headings, parts inside sections, clauses in groups, rows of tables with their head, and the way that suits each document."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.operators.text import PARTS, SPLITS, TABLE_ROWS, chunk

# Characters of a part and the most of a section that isn't parted, headings that make sections, characters of a group of clauses.
PART, WHOLE, DEEPEST, GROUP = 512, 1024, 5, 1024
HEADING = re.compile(rf"(#{{1,{DEEPEST}}})[ \t]+(.*?)[ \t]*#*[ \t]*$")
RULE = re.compile(r"\|?[\s:|-]*-[\s:|-]*$")
# What begins a clause, an article or a section; the first kind that a text has counts.
CLAUSES = (
    ("numbered_clause", re.compile(r"(?m)^[ \t]*((?:\d+\.)+\d*)\s+(?=\S)")),
    ("article", re.compile(r"(?mi)^(Article\s+[IVXLCDM\d]+)[:.\s]")),
    ("section", re.compile(r"(?mi)^(Section\s+\d+)[:.\s]")),
)
# Words in a file's name or a column's that tell what a table is about.
ABOUT = (
    (("sales", "revenue", "transaction", "order"), "This appears to be sales/transaction data suitable for revenue analysis."),
    (("inventory", "stock", "product", "sku"), "This appears to be inventory/product data suitable for stock analysis."),
    (("employee", "hr", "payroll", "staff"), "This appears to be HR/employee data."),
    (("invoice", "receipt", "billing"), "This appears to be financial/billing data."),
)
COLUMN_KINDS = (
    ("Numeric/Amount fields (for aggregation)", ("amount", "price", "cost", "total", "sum", "revenue", "value", "qty", "quantity")),
    ("Date fields (for time-based analysis)", ("date", "time", "created", "updated", "timestamp", "day", "month", "year")),
    ("Category fields (for grouping)", ("category", "type", "status", "group", "class", "department", "region")),
)
SHOWN_COLUMNS, SHOWN_ROWS = 15, 5
# Tokens of a batch of a delimited text, and those left for what stands around it.
CSV_TOKENS, CSV_ROOM = 3000, 100


class Node(NamedTuple):
    """A chunk: its kind, the number of the node that it is a part of, its headings, its text, and the head of the table that it goes on with."""

    kind: str
    parent: int | None
    path: tuple[str, ...]
    text: str
    head: str | None = None


def sections(text: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(headings, text) of each section, from its heading to the next. A heading closes all that are as deep or deeper; lines in fenced code are no headings. The texts together are the whole."""
    stack: list[tuple[int, str]] = []
    begin, at, code = 0, 0, False
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        if bare.lstrip().startswith("```"):
            code = not code
        elif not code and (m := HEADING.match(bare)):
            if text[begin:at].strip():
                yield tuple(title for _, title in stack), text[begin:at]
                begin = at
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
        at += len(line)
    if text[begin:].strip():
        yield tuple(title for _, title in stack), text[begin:]


def is_row(line: str) -> bool:
    return line.strip().startswith("|") and line.count("|") >= 2


def parts(text: str, size: int = PART) -> Iterator[tuple[str, str | None]]:
    """Parts of at most `size` characters that together are the text, each with the head of the table in whose rows it begins. A part ends, in its latter half if it can, behind a paragraph, a line, a sentence or a
    word; rows of a table are parted between lines."""
    heads, at, head, lines = [], 0, None, text.splitlines(keepends=True)
    for i, line in enumerate(lines):
        if not is_row(line):
            head = None
        elif head is None and i + 1 < len(lines) and RULE.match(lines[i + 1].rstrip()) and is_row(lines[i + 1]):
            head = (at, at + len(line) + len(lines[i + 1]), line + lines[i + 1])
        if head:
            heads.append((at, head))
        at += len(line)
    rows, begin, k = heads, 0, 0
    while begin < len(text):
        end = len(text)
        if end - begin > size:
            window = text[begin : begin + size]
            ends = (window.rfind(mark) + len(mark) for mark in ("\n\n", "\n", ". ", " ") if window.rfind(mark) + len(mark) > size // 2)
            end = begin + next(ends, size)
        while k < len(rows) and rows[k][0] < begin:
            k += 1
        inside = k < len(rows) and rows[k][0] == begin and begin >= rows[k][1][1]
        yield text[begin:end], rows[k][1][2] if inside else None
        begin = end


def tree(text: str, size: int = PART, most: int = WHOLE) -> Iterator[Node]:
    """A node for each section, and below those of more than `most` characters one for each of their parts."""
    number = 0
    for path, body in sections(text):
        if len(body) <= most:
            yield Node("section", None, path, body)
            number += 1
            continue
        parent = number
        yield Node("parent", None, path, body)
        number += 1
        for part, head in parts(body, size):
            yield Node("child", parent, path, part, head)
            number += 1


def clauses(text: str, size: int = GROUP) -> Iterator[tuple[list[str], str]]:
    """(numbers, text) of groups of whole clauses, as many as fit in `size` characters; nothing if the text has no clauses, articles or sections."""
    for _, pattern in CLAUSES:
        marks = list(pattern.finditer(text))
        if not marks:
            continue
        ends = [m.start() for m in marks[1:]] + [len(text)]
        numbers, group, held = [], [], 0
        for m, end in zip(marks, ends, strict=True):
            clause = text[m.start() : end].strip()
            if group and held + len(clause) > size:
                yield numbers, "\n\n".join(group)
                numbers, group, held = [], [], 0
            numbers.append(m[1])
            group.append(clause)
            held += len(clause)
        yield numbers, "\n\n".join(group)
        return


def clause_nodes(text: str, size: int = GROUP) -> Iterator[Node]:
    """Groups of clauses, or else the tree of sections."""
    found = False
    for numbers, group in clauses(text, size):
        found = True
        yield Node("clause_group", None, (numbers[0], numbers[-1]) if len(numbers) > 1 else (numbers[0],), group)
    if not found:
        yield from tree(text, size)


def table_nodes(text: str, rows: int = TABLE_ROWS, size: int = GROUP) -> Iterator[Node]:
    """Tables in batches of rows, each with its head, and what stands between them in parts."""
    lines = text.splitlines(keepends=True)
    i = 0
    while i < len(lines):
        begin = i
        while i < len(lines) and is_row(lines[i]) == is_row(lines[begin]):
            i += 1
        block = lines[begin:i]
        if not is_row(block[0]):
            if "".join(block).strip():
                yield from (Node("text", None, (), part) for part, _ in parts("".join(block), size))
            continue
        head = block[:2] if len(block) > 1 and RULE.match(block[1].rstrip()) else []
        body = block[len(head) :]
        for at in range(0, max(len(body), 1), rows):
            yield Node("table_rows", None, (), "".join(body[at : at + rows]), "".join(head) or None)


def table_summary(name: str, kind: str, text: str) -> str:
    """One text about a table: its columns and what they may be, the number of its rows and the first of them."""
    rows = [line for line in text.split("\n") if is_row(line)]
    data = [r for r in rows if not (r.count("-") > 5 and RULE.match(r.strip()))]
    columns = [c for c in (p.strip() for p in data[0].split("|")) if c] if data else []
    out = [f"# {name}", "", f"This is a {kind or 'tabular data'} document containing {len(data)} data rows with {len(columns)} columns.", ""]
    out += [sentence for words, sentence in ABOUT if any(w in name.lower() for w in words)][:1] + [""]
    if columns:
        out += [f"## Data Schema ({len(columns)} columns)", "", f"Column names: {', '.join(columns[:SHOWN_COLUMNS])}"]
        out += [f"...and {len(columns) - SHOWN_COLUMNS} more columns."] if len(columns) > SHOWN_COLUMNS else []
        kinds = [(title, [c for c in columns if any(w in c.lower() for w in words)]) for title, words in COLUMN_KINDS]
        out += ["", "### Field Types (inferred)"] if any(found for _, found in kinds) else [""]
        out += [f"- {title}: {', '.join(found[:5])}" for title, found in kinds if found]
    sample = data[1 : SHOWN_ROWS + 1]
    return "\n".join(out + (["", "## Sample Data", "", *sample] if sample else []))


def csv_nodes(text: str, tokens: int = CSV_TOKENS, delimiter: str = ",") -> Iterator[Node]:
    """Rows of a delimited text in batches that fit so many tokens by the mean of the first ten, each batch with the head in front. A head that leaves no room for rows, and a text without rows, stay whole."""
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    line = lambda row: delimiter.join(row)
    size = lambda row: len(line(row)) // 4
    room = tokens - size(rows[0]) - CSV_ROOM if rows else 0
    if room <= 0 or len(rows) == 1:
        if text.strip():
            yield Node("csv", None, (), text)
        return
    head, data = rows[0], rows[1:]
    mean = sum(map(size, data[:10])) / len(data[:10])
    each = max(1, int(room / mean)) if mean else len(data)
    for at in range(0, len(data), each):
        yield Node("csv_rows", None, (str(at + 1), str(min(at + each, len(data)))), "\n".join(map(line, [head, *data[at : at + each]])), line(head))


def nodes(strategy: str, text: str, size: int, overlap: int, name: str = "", kind: str = "", skip_rows: bool = False) -> Iterator[Node]:
    """Chunks of a text by a strategy; size is in tokens of four characters, overlap in percent."""
    if not text.strip():
        return
    if strategy == "whole_document":
        yield Node("whole_document", None, (), text)
    elif strategy == "clause_preserving":
        yield from clause_nodes(text, size)
    elif strategy == "table_preserving":
        yield from [Node("tabular_summary", None, (), table_summary(name, kind, text))] if skip_rows else table_nodes(text)
    elif strategy in NAMED_SPLITS:
        yield from (Node(strategy, None, (), c) for c in chunk(text, SPLITS[NAMED_SPLITS[strategy]], large=size, target=size, small=size // 4, overlap=overlap / 100))
    else:
        yield from tree(text, size, 2 * size)


#: Strategies that split where a pattern matches, and then join and cut to size.
NAMED_SPLITS = {"academic_structure": "academic", "medical_section": "medical", "requirement_based": "requirement", "educational_unit": "educational", "paragraph": "paragraph"}
SCHEMA = "chunk_index int, node string, parent string, chunk_type string, level int, heading_path string, chunk string, table_header string"


def _mapped(rows: DataFrame, key: str, columns: list[str], cut: Callable[..., Iterator[Node]], kept: list[str] = []) -> DataFrame:  # noqa: B006
    """(key, chunk_index, node, parent, chunk_type, level, heading_path, chunk, table_header): the nodes that cut makes of each row's columns, in their order, and the row's `kept` columns. A node's id is made of the
    document's key and its place."""
    kinds_of = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            at: list[int] = []
            for row, (k, *values) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1 + len(columns))), strict=True)):
                name = lambda i, k=k: None if i is None else hashlib.md5(f"{k}:{i}".encode()).hexdigest()
                for i, n in enumerate(cut(*values)):
                    out.append((k, i, name(i), name(n.parent), n.kind, len(n.path), " > ".join(n.path), n.text, n.head))
                    at.append(row)
                    if len(out) >= PARTS:
                        yield made(batch, out, at)
                        out, at = [], []
            yield made(batch, out, at)

    def made(batch: pa.RecordBatch, out: list[tuple], at: list[int]) -> pa.RecordBatch:
        text, whole = pa.string(), pa.int32()
        kinds = [batch.schema.field(0).type, whole, text, text, text, whole, text, text, text]
        found = zip(*out, strict=True) if out else [()] * len(kinds)
        carried = [batch.column(1 + len(columns) + i).take(pa.array(at, pa.int64())) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(found, kinds, strict=True)), *carried], [key, *(x.split()[0] for x in SCHEMA.split(", ")), *kept])

    return rows.select(key, *columns, *kept).mapInArrow(run, ", ".join([f"`{key}` {kinds_of[key]}", SCHEMA, *(f"`{c}` {kinds_of[c]}" for c in kept)]))


def chunk_trees(documents: DataFrame, key: str, text: str, size: int = PART, most: int = WHOLE) -> DataFrame:
    """The sections of every text under their headings, and the parts of long ones.

    A section of at most `most` characters is one node. A longer one is a parent, with its parts of at most `size` characters as children; a parent's text is that of its children together, and the texts of all nodes without
    a parent are the document. A child that begins within a table names the table's head. Empty and missing texts have no nodes. A text is cut where it was read, in one pass.
    """
    return _mapped(documents, key, [text], lambda t: tree(t or "", size, most))


def clause_chunks(documents: DataFrame, key: str, text: str, size: int = GROUP) -> DataFrame:
    """Whole clauses of every text in groups of at most `size` characters, or articles, or sections; heading_path names the first and the last. A text with none of them is cut as a tree of sections."""
    return _mapped(documents, key, [text], lambda t: clause_nodes(t or "", size))


def csv_chunks(documents: DataFrame, key: str, text: str, tokens: int = CSV_TOKENS, delimiter: str = ",") -> DataFrame:
    """Batches of rows of every delimited text, each with the head; heading_path names the first and the last row of a batch, from 1."""
    return _mapped(documents, key, [text], lambda t: csv_nodes(t or "", tokens, delimiter))


def adaptive_chunks(profiled: DataFrame, key: str, name: str = "filename", text: str = "text", kept: list[str] = []) -> DataFrame:  # noqa: B006
    """Chunks of every document by the strategy of its profile (see doc_types.profiles), with what is `kept` of the profile: documents need not be joined back to their chunks."""
    columns = [name, text, "document_type", "strategy", "chunk_size", "overlap_percent", "skip_rows"]
    return _mapped(profiled, key, columns, lambda n, t, kind, way, size, overlap, skip: nodes(way, t or "", size, overlap, n or "", kind, bool(skip)), kept)
