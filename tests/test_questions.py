import random
import re

import pytest

from ledgerloom.operators import turns as T
from ledgerloom.plans.questions import Field, answer, compiled

FIELDS = (
    Field("Purchase Date", "date", "header"), Field("Customer Name", "entity", "header"), Field("Category", "category", "item", "group_by"), Field("Region", "region", "header", "group_by"),
    Field("Quantity", "quantity", "item", "sum"), Field("Total Sales", "amount", "item", "sum"),
)


@pytest.mark.parametrize(("question", "keys"), [
    ("Summarize total sales by category", ["Category"]), ("Show sales by year and category", ["year", "Category"]), ("Total sales grouped by year then by category", ["year", "Category"]),
    ("Monthly sales breakdown by category", ["month", "Category"]), ("Total quantity and sales by region", ["Region"]), ("by customer name, then by year", ["Customer Name", "year"]),
    ("sales per quarter, first by region", ["Region", "quarter"]), ("everything", []), ("yearly and monthly", ["year"]), ("REGIONS and vendors", ["Customer Name", "Region"]),
])
def test_keys_in_order_of_mention(question, keys):
    assert [k if isinstance(k, str) else k.name for k in compiled(question, FIELDS, "summary").keys] == keys


def test_kinds_and_checks():
    assert compiled("List each item", FIELDS).kind == "detail"
    assert compiled("How many orders?", FIELDS) == compiled("how many ORDERS", FIELDS) and compiled("How many orders?", FIELDS).level == "document"
    assert compiled("count lines", FIELDS).level == "item"
    assert compiled("by year", FIELDS[1:], "summary").keys == ()
    with pytest.raises(ValueError):
        compiled("x", [Field("A b", "date"), Field("a_b", "amount")])


def test_answers(spark):
    rows = [
        (1, 0, {"Purchase Date": "2024-02-03", "Region": "n"}, {"Category": "a", "Total Sales": "1.005"}), (1, 1, {"Purchase Date": "2024-02-03", "Region": "n"}, {"Category": "b", "Total Sales": "x"}),
        (2, 0, {"Purchase Date": "2023-12-31", "Region": "s"}, {"Category": "a", "Total Sales": "2"}), (3, 0, {"Purchase Date": "soon"}, {"Category": "a"}),
    ]
    df = spark.createDataFrame(rows, "document_id int, line_number int, header map<string,string>, item map<string,string>")
    assert [tuple(r) for r in answer("by year and category", df, FIELDS, "summary").collect()] == [(None, "a", 1, None), (2023, "a", 1, 2.0), (2024, "a", 1, 1.01), (2024, "b", 1, None)]
    assert [tuple(r) for r in answer("quarterly", df, FIELDS, "summary").collect()] == [(None, 1, None), ("2023-Q4", 1, 2.0), ("2024-Q1", 2, 1.01)]
    assert answer("How many orders", df, FIELDS).first().total_count == 3 and answer("count", df, FIELDS).first().total_count == 4
    detail = answer("list all", df, FIELDS, "detail")
    assert detail.columns == ["purchase_date", "customer_name", "region", "category", "quantity", "total_sales", "row_number"]
    assert [(r.purchase_date, r.row_number) for r in detail.collect()] == [("soon", 0), ("2024-02-03", 0), ("2024-02-03", 1), ("2023-12-31", 0)]


def plain(turns, before=10):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted(t for t in turns if t[0] == conv)
        for i, (c, turn, text) in enumerate(own):
            said = {"files": [], "people": [], "topics": []}
            for _, _, earlier in reversed(own[max(0, i - before) : i]):
                said["files"] += [m[0] for m in re.finditer(r"\b[\w-]+\.(?:pdf|docx?|xlsx?|txt|md|csv)\b", earlier or "")][::-1]
                said["people"] += re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", earlier or "")[::-1]
                said["topics"] += re.findall(r"\b[A-Z][a-z]{2,}\b", earlier or "")[::-1]
            people = list(dict.fromkeys(said["people"]))
            out[c, turn] = (next(iter(said["files"]), None), next(iter(said["topics"]), None), ", ".join(people[:2]) or None)
    return out


def test_referents_also_where_a_conversation_lies_on_many_tasks(spark):
    rnd = random.Random(3)
    words = ["it", "they", "report.pdf", "a-b.csv", "Ann Lee", "Bob Ray", "Sales", "the", "of", "That"]
    turns = [(0 if i % 3 else i % 7, i, " ".join(rnd.choices(words, k=rnd.randint(0, 4))) if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(turns, "conv long, turn long, text string").repartition(6)
    got = {(r.conv, r.turn): (r.it, r.this, r.they) for r in T.resolved(df, "conv", ("turn",), "text").collect()}
    assert got == plain(turns)


def test_pronouns_are_replaced(spark):
    turns = [(1, 1, "Ann Lee sent costs$1.pdf about Budget"), (1, 2, "Is it late? Itself, IT and they/them, this."), (1, 3, None), (2, 1, "it stays")]
    got = {(r.c, r.t): r.resolved_text for r in T.resolved(spark.createDataFrame(turns, "c int, t int, text string"), "c", ("t",), "text").collect()}
    assert got[1, 2] == 'Is "1.pdf" late? Itself, "1.pdf" and "Ann Lee"/"Ann Lee", "Budget".'
    assert got[1, 3] is None and got[2, 1] == "it stays"
    none = spark.createDataFrame([], "c int, t int, text string")
    assert T.resolved(none, "c", ("t",), "text").collect() == []
