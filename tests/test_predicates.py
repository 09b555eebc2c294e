from ledgerloom.operators import predicates as P
from ledgerloom.operators import projection as J
from pyspark.sql import functions as F


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first().x


def test_skip_reasons_in_order(spark):
    schema = "f string, k string, c string, s boolean, r string"
    reason = P.skip_reason(F.col("f"), F.col("k"), F.col("c"), F.col("s"), F.col("r"))
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n" + "words " * 10
    for row, want in (
        (("a.CSV", "contract", "", True, "by hand"), "by hand"), (("a.CSV", "contract", "", True, None), "user_disabled:document_flag"), (("a.CSV", "invoice", "", False, None), "file_type:.csv"),
        (("a.pdf", " Bill ", "", False, None), "document_type:invoice"), (("a.pdf", "contract", table, False, None), "content_pattern:markdown_table"), (("a.pdf", "contract", "a letter", False, None), None),
        ((".csv", None, None, None, None), None), ((None, None, None, None, None), None),
    ):
        assert one(spark, reason, schema, *row) == want


def test_names_match_in_order(spark):
    match = P.name_match(F.col("n"), ["Acme Corp", "Delta"])
    for name, want in (("ACME CORP", "exact"), ("acme", "exact"), ("Acme Holdings of Ohio", "substring"), ("Deltta", "fuzzy"), ("Zebra", None), ("", None), (None, None)):
        assert one(spark, match, "n string", name) == want
    assert P.hard(["Acme"], "list all Acme invoices") and not P.hard(["Acme"], "Acme?") and not P.hard([], "list all")


def test_conditions(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, None), (None, "x")], "n int, s string")
    found = lambda *tests: sorted(r.n for r in P.conditions(rows, tests).collect())
    assert found(("n", "between", 1, 2)) == [1, 2] and found(("n", "compound", 1, 3)) == [2] and found(("s", "ilike", "a%")) == [1, 2]
    assert found(("n", "not_in", 1)) == [2, 3] and found(("n", "!=", 2), ("n", "<", 3)) == [1]


def test_rows_of_records_and_items(spark):
    schema = "i map<string,string>, h map<string,string>, s map<string,string>"
    frame = spark.createDataFrame([({"Price": "$1,200.50", "A": "x", "B": "y", "D": ""}, {"date": "2024-01-02", "total": "7"}, {"total_amount": "abc"})], schema)
    got = frame.select(*J.mapped_row(F.col("i"), F.col("h"), {"A": ("status", "string"), "B": ("status", "string"), "C": ("status", "string"), "D": ("date", "datetime"), "Price": ("amount", "number")})).first()
    assert (got.status, got.date, got.amount) == ("y", "2024-01-02", 1200.5)
    got = frame.select(*J.record_row(F.col("h"), F.col("s"))).first()
    assert (got.date, got.amount, got.entity_name) == ("2024-01-02", None, None)
    assert J.ordered([("amount", "item"), ("description", "item"), ("total", "header"), ("vendor", "header")]) == ["vendor", "total", "description", "amount"]
    assert J.grouped_mappings({"a": {"source": "header", "t": "date"}, "b": {"t": "x"}}) == {"header": {"a": {"t": "date"}}, "summary": {}, "item": {"b": {"t": "x"}}}


def test_repeats_and_regions(spark):
    rows = [(1, i, "c", "t", None) for i in range(6)] + [(1, 10 + i, "d", f"t{i}", "box") for i in range(2)] + [(2, 20, None, None, "box")]
    frame = spark.createDataFrame(rows, "page int, at int, category string, text string, box string")
    assert sorted(r.at for r in J.without_repeats(frame, "page", "at", "category", "text", "box").collect()) == [0, 10, 20]
    pages = spark.createDataFrame([(1, p) for p in range(1, 8)] + [(2, 1)], "d int, page int")
    assert sorted((r.d, r.page, r.region) for r in J.regions(pages, "d", "page").collect()) == [(1, 1, "first"), (1, 4, "middle"), (1, 7, "last"), (2, 1, "first")]
