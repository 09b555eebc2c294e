import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names
from ledgerloom.operators import graph as G
from ledgerloom.operators import relevance as R
from ledgerloom.operators.predicates import name_match


def test_words_of_a_question():
    assert R.hints("Meal receipts in Excel") == (["meal"], ["receipt", "spreadsheet"])
    assert R.asked_names("total from Acme Trading Co. and by the vendor Bolt") == ["Acme Trading Co", "Bolt"] and R.asked_names("") == []


@pytest.mark.parametrize(("row", "score"), [
    (("invoice", {"vendor_name": "Acme"}, ["amount"]), 0.3 + 0.25 + 0.3 + 0.15), (("invoice", {"vendor_name": "Acme Ltd"}, ["x"]), 0.24 + 0.25), (("memo", {"vendor_name": "other"}, ["x"]), 0.0),
    ((None, None, None), 0.04), (("spreadsheet", {"vendor_name": "acme", "n": "-1.5"}, ["Order_Amount", "amount"]), min(1.0, (0.3 + 0.2) * 0.5 + 0.6 + 0.3)), (("", {}, []), 0.04),
])
def test_relevance(spark, row, score):
    df = spark.createDataFrame([row], "kind string, header map<string,string>, fields array<string>")
    got = df.select(R.relevance("amount from Acme", F.col("kind"), F.col("header"), F.col("fields"), types=["invoice"]).alias("s")).first().s
    assert got == pytest.approx(score)


def test_layout():
    shown = R.layout(["total_count", "order_date", "qty", "tax_rate", "name", "fee"], {"fee": "amount"})
    assert [(s.header, s.format, s.alignment) for s in shown] == [
        ("Total Count", "currency", "right"), ("Order Date", "date", "center"), ("Qty", "number", "right"), ("Tax Rate", "percentage", "right"), ("Name", "text", "left"), ("Fee", "currency", "right"),
    ]


def test_totals(spark):
    rows = spark.createDataFrame([("1.5", 1), ("x", 2), (None, 3)], "amount string, n int")
    assert tuple(R.totals(rows, R.layout(rows.columns)).first()) == (3, 1.5)
    assert tuple(R.totals(rows.limit(0), R.layout(rows.columns)).first()) == (0, 0.0)


def test_names_in_normal_form(spark):
    rows = ["  Foo  Bar, Inc.", "AMZN", "Apple Inc", "Google Cloud", "Acme Co. Ltd.", "Acme Corp., Inc.", "Stripe Inc.", None, "x-", "Zoom Video Communications Inc."]
    got = [r.n for r in spark.createDataFrame([(r,) for r in rows], "a string").select(names.entity_name(F.col("a")).alias("n")).collect()]
    assert got == ["foo bar", "amazon", "apple", "google cloud", "acme", "acme corp", "stripe", "", "x", "zoom"]


def test_ratio_is_that_of_the_common_subsequence(spark):
    rows = [("acme", "acne", 75.0), ("abc", "abc", 100.0), ("", "", 100.0), ("a", "", 0.0), ("kitten", "sitting", 8 * 100 / 13)]
    got = spark.createDataFrame(rows, "a string, b string, r double").select(names.indel_ratio(F.col("a"), F.col("b")).alias("got"), "r").collect()
    assert [g.got for g in got] == [pytest.approx(g.r) for g in got]
    assert [r.m for r in spark.createDataFrame([("acne",), ("acme inc",), ("acmes",)], "n string").select(name_match(F.col("n"), ["Acme"], 80).alias("m")).collect()] == [None, "exact", "substring"]


def test_dates_come_in_the_order_of_their_patterns(spark):
    text = "On March 5, 2024 and 2024-06-07, then 10/14/2025 08:36:15 PM, 3 April 2024 and 99/99/2024; May 6 2024."
    got = spark.createDataFrame([(text,), (None,), ("14/02/2024 or 01/02/2024",)], "t string").select(dates.find_dates(F.col("t")).cast("array<string>").alias("d")).collect()
    assert got[0].d == ["2025-10-14", "2024-06-07", "2024-03-05", "2024-05-06", "2024-04-03"] and got[2].d == ["2024-02-14", "2024-02-01"]


def test_readable_keeps_rows_as_many_as_they_are(spark):
    rows = spark.createDataFrame([("a", ["1", "2"], [0.1]), ("a", ["1", "2"], [0.1]), ("b", ["3"], [0.2]), ("c", [], [0.3]), ("d", None, [0.4])], "name string, document_ids array<string>, embedding array<double>")
    acl = spark.createDataFrame([("1",), ("2",)], "document_id string")
    assert sorted(r.name for r in G.readable(rows, acl).collect()) == ["a", "a"] and G.readable(rows, None).count() == 5
