"""The library's own operators over small frames."""

import random
from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names, numbers, scoring
from ledgerloom.operators import access, analytics, entities, fields, graph, nearest, projection, queue, retrieval
from ledgerloom.operators import text as texts
from ledgerloom.plans import phrases
from ledgerloom.sources import files
from ledgerloom.sources.records import nested, numbered
from ledgerloom.streaming import tasks


def values(df, column):
    return [r[column] for r in df.collect()]


def test_access_none_is_not_empty(spark):
    rows = spark.range(4).withColumnRenamed("id", "document_id")
    assert access.restricted(rows, None).count() == 4
    assert access.restricted(rows, rows.where("document_id < 0")).count() == 0
    now = datetime(2026, 1, 1)
    held = spark.createDataFrame(
        [(1, 1, ["read"], False, None), (1, 2, ["write"], False, None), (1, 3, ["full"], False, None), (1, 4, [], True, None), (1, 5, ["read"], False, datetime(2025, 1, 1)), (2, 6, ["read"], False, None)],
        "user_id int, document_id int, permissions array<string>, is_owner boolean, expires_at timestamp",
    )
    assert sorted(values(access.accessible(held, 1, "read", now), "document_id")) == [1, 3, 4]
    assert values(access.expired(held, now), "document_id") == [5]


def test_metrics_of_nothing_are_zero_and_missing_keys_unknown(spark):
    rows = spark.createDataFrame([("2025-01-05", 1.5, "x"), ("2025-01-06", None, ""), (None, 2.0, None)], "date string, amount double, status string")
    assert analytics.summary(rows.where("false")).first().asDict() == {"count": 0, "total_amount": 0.0, "average": 0.0, "least": 0.0, "most": 0.0}
    by = {r.group_key: (r["count"], r.total_amount) for r in analytics.grouped(rows, "status").collect()}
    assert by == {"x": (1, 1.5), "Unknown": (2, 2.0)}
    assert {r.group_key for r in analytics.grouped(rows, "month").collect()} == {"2025-01", "Unknown"}
    assert values(analytics.grouped(rows, "nothing"), "group_key") == ["All"]
    assert analytics.hierarchy(rows, ["year", "status"]).where("depth = 0").first().total_amount == 3.5


def test_first_fields(spark):
    rows = spark.createDataFrame([("", "b", "n/a", "3"), (None, None, None, "$1,234.50")], "a string, b string, x string, y string")
    got = rows.select(analytics.first_text([F.col("a"), F.col("b")]).alias("t"), analytics.first_amount([F.col("x"), F.col("y")]).alias("n")).collect()
    assert [tuple(r) for r in got] == [("b", None), (None, 1234.5)]


def test_time_range_may_be_met_by_two_fields(spark):
    rows = spark.createDataFrame([("2025-05-01", "2020-01-01"), ("2020-01-01", None)], "a string, b string")
    assert rows.where(analytics.in_time([F.col("a"), F.col("b")], "2025-01-01", "2024-01-01")).count() == 1


def test_extremes_keep_ties(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None)], "id int, amount double")
    found = analytics.extremes(rows.withColumn("g", F.lit(1)), "amount", ["g"])
    assert sorted((r.id, r.record_type) for r in found.collect()) == [(1, "MIN"), (2, "MIN"), (3, "MAX")]


def test_numbers_and_dates(spark):
    row = spark.createDataFrame([("$1,234.50", "2025-1-5", "13/10/2025", "01/02/2024", "May 2024")], "n string, a string, b string, c string, d string").select(
        numbers.parse_number(F.col("n")).alias("n"), dates.month_key(F.col("a")).alias("a"), dates.month_key(F.col("b")).alias("b"), dates.month_key(F.col("c")).alias("c"), dates.quarter_key(F.col("a")).alias("q"),
        dates.quarter_key(F.col("d")).alias("u"), dates.resolve(F.col("b"), F.lit(False)).alias("r"),
    ).first()
    assert tuple(row) == (1234.5, "2025-01", "2025-10", "2024-01", "2025-Q1", "Unknown", date(2025, 10, 13))
    found = spark.createDataFrame([("Due March 5, 2024 and 2024-06-07.",)], "t string").select(dates.find_dates(F.col("t")).alias("d")).first().d
    assert found == [date(2024, 6, 7), date(2024, 3, 5)]
    assert dates.expand_months("sales October 2025") == "sales October 2025 (2025-10)"
    assert dates.named_range("q1 2024", date(2026, 1, 1)) == ("2024-01-01", "2024-03-31")


def test_names(spark):
    row = spark.createDataFrame([("Acme  Co. Ltd.", "ACME", "kitten", "sitting")], "a string, b string, x string, y string").select(
        names.entity_name(F.col("a")).alias("n"), names.alike(F.col("a"), F.col("b")).alias("like"), names.indel_ratio(F.col("x"), F.col("y")).alias("ratio"), names.edge_key(F.lit("w"), F.col("x"), F.col("y")).alias("e"),
        names.edge_key(F.lit("w"), F.col("y"), F.col("x")).alias("f"),
    ).first()
    assert row.n == "acme" and row.like and round(row.ratio, 3) == round(200 * 4 / 13, 3) and row.e == row.f


def test_rewards(spark):
    full = "<think>a</think>\n<answer>b</answer>"
    rows = spark.createDataFrame([(full,), ("<answer>b</answer>",), ("words",)], "t string").select(scoring.format_reward(F.col("t")).alias("r"))
    assert values(rows, "r")[0] == 1.0
    f1 = spark.createDataFrame([("The cat sat", "a cat")], "a string, b string").select(scoring.token_f1(F.col("a"), F.col("b")).alias("f")).first().f
    assert round(f1, 6) == round(2 * 0.5 * 1 / 1.5, 6)


def test_varied_choice_and_greedy_packing(spark):
    vectors = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert retrieval.diverse(vectors, np.array([0.9, 0.9, 0.5]), 2) == [0, 2]
    rows = spark.createDataFrame([("d", i, "x" * n, 1.0 - i / 10, 1) for i, n in enumerate((40, 400, 40, 20))], "doc string, k int, t string, score double, priority int")
    assert sorted(values(retrieval.packed(rows, "doc", "k", "t", 25), "k")) == [0, 2, 3]


def test_packing_goes_through_whole_groups(spark):
    rnd = random.Random(4)
    rows = [("long", i, "x" * 900, 1000.0 - i, 1) for i in range(60)] + [("long", 60 + i, "x" * 40, 100.0 - i, 2) for i in range(60)]
    rows += [("mixed", i, None if i % 50 == 0 else "x" * rnd.randint(0, 1200), rnd.choice([None, *range(9)]), rnd.randint(1, 3)) for i in range(700)]
    rows = [(g, i, t, None if s is None else float(s), p) for g, i, t, s, p in rows]
    want, used = set(), {}
    for g, i, t, s, p in sorted(rows, key=lambda r: (r[4], r[3] is None, -(r[3] or 0), r[1])):
        n = max(1, len(t or "") // 4)
        if used.get(g, 0) + n <= 200:
            used[g] = used.get(g, 0) + n
            want.add((g, i, n))
    df = spark.createDataFrame(rows, "doc string, k int, t string, score double, priority int").repartition(7)
    got = [tuple(r) for r in retrieval.packed(df, "doc", "k", "t", 200).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(g == "long" for g, _, _ in got) == 20


def test_cache(spark):
    cache = spark.createDataFrame([(1, "w", "factual", [1.0, 0.0], [7], datetime(2030, 1, 1), True, 0.9, 0), (2, "w", "factual", [1.0, 0.0], [8], datetime(2030, 1, 1), True, 0.9, 2)], "entry_id int, workspace_id string, intent string, embedding array<double>, source_ids array<int>, expires_at timestamp, is_valid boolean, confidence double, complaints int")
    asked = spark.createDataFrame([(1, "w", "factual", [1.0, 0.01], [8]), (2, "w", "factual", [1.0, 0.0], [9])], "question_id int, workspace_id string, intent string, embedding array<double>, allowed array<int>")
    hits = retrieval.cache_hits(asked, cache, F.lit("2026-01-01").cast("timestamp"))
    assert [(r.question_id, r.entry_id) for r in hits.collect()] == [(1, 2)]
    told = spark.createDataFrame([(2, 1)], "entry_id int, complaints int")
    assert {r.entry_id: r.is_valid for r in retrieval.complained(cache, told).collect()} == {1: True, 2: False}


def test_cached_answers_are_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 40)
    monkeypatch.setattr(nearest, "BAND", 30)
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((12, 6))
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [0.0] * 5, [1e-170] * 6, [1e170] * 6, [1.0, 2.0]]

    def vector(i):
        if i % 17 == 0:
            return odd[i // 17 % len(odd)]
        x = base[rnd.integers(12)]
        return list(map(float, (x, x * rnd.integers(1, 9), x + rnd.standard_normal(6) * 1e-9, x + rnd.standard_normal(6) * 0.1, rnd.standard_normal(6))[i % 5]))

    where = lambda i: ("wv"[i % 3 == 0] if i % 40 else None, ("factual", "summary", "other")[i % 4 % 3])
    late = lambda i: datetime(2020 if i % 19 == 0 else 2030, 1, 1)
    cache = spark.createDataFrame([(i if i % 11 else None, *where(i), vector(i), [str(i % 3), None][: 1 + (i % 7 == 0)], late(i), i % 23 > 0) for i in rnd.permutation(700).tolist()], "entry_id long, workspace_id string, intent string, embedding array<double>, source_ids array<string>, expires_at timestamp, is_valid boolean")
    asked = spark.createDataFrame([(f"q{i}", *where(i), vector(i), [["0", "1", None], ["2"], [], None][i % 4]) for i in range(300)], "question_id string, workspace_id string, intent string, embedding array<double>, allowed array<string>")
    now = F.lit("2026-01-01").cast("timestamp")
    hits = retrieval.cache_hits(asked, cache, now)
    assert "Join" not in hits._jdf.queryExecution().toString()  # a join would make a row of every pair

    held = cache.where("is_valid").where(F.col("expires_at") > now).withColumnRenamed("embedding", "other")
    least = F.when(F.col("intent") == "factual", 0.92).when(F.col("intent") == "summary", 0.88).otherwise(0.90)
    pairs = asked.join(held, ["workspace_id", "intent"]).withColumn("score", scoring.cosine(F.col("embedding"), F.col("other"))).where((F.col("score") >= least) & access.covered(F.col("source_ids"), F.col("allowed")))
    want = analytics.ranked_once(pairs.select("question_id", "entry_id", "score"), ["question_id"], [F.desc("score"), F.asc_nulls_last("entry_id")])
    rows = lambda df: sorted((r.question_id, repr(r.entry_id), repr(r.score)) for r in df.collect())
    assert rows(hits) == rows(want) and hits.count() > 50 and {"nan"} < {s for *_, s in rows(hits)}


def test_graph(spark):
    out = spark.createDataFrame([("c1", "d1", "(entity|org|Acme|Makes tools|80)\n(relationship|Acme|Bolt|sells|trade, parts|2)\nnoise\n(entity|org|Acme)"), ("c2", "d2", "(entity|ORG|acme |Makes|x)\n(relationship|Bolt|Acme|buys|parts|y)")], "chunk_id string, document_id string, text string")
    lines = graph.lines(out)
    nodes = graph.keyed(graph.entities(lines), "w").withColumn("at", F.col("chunk_id"))
    node = graph.merged_nodes(nodes).collect()
    assert [(n.name, n.description, n.score, n.document_ids) for n in node] == [("Acme", "Makes tools", 80, ["d1", "d2"])]
    edges = graph.linked(graph.relationships(lines), "w").withColumn("at", F.col("chunk_id"))
    edge = graph.merged_edges(edges).collect()
    assert [(e.keywords, e.weight, e.description) for e in edge] == [("trade, parts", 2.0, "sells | buys")]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "src string, tgt string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in graph.reached(chain, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert sorted("".join(p) for p in values(graph.paths(chain, start, 2), "path")) == ["ab", "abc"]
    merged = graph.merged_nodes(nodes)
    assert graph.readable(merged, spark.createDataFrame([("d9",)], "document_id string")).count() == 0
    assert graph.without_document(merged, "d1").first().document_ids == ["d2"]


def test_queue(spark):
    rows = spark.createDataFrame([(1, "failed", 1, "2025-01-02"), (2, "pending", 0, "2025-01-01"), (3, "failed", 3, "2025-01-01"), (4, "completed", 0, "2025-01-01"), (5, "failed", 0, "2025-01-03")], "id int, status string, retries int, created_at string")
    assert values(queue.claimed(rows, 3, "id"), "id") == [5, 1, 2]
    docs = spark.createDataFrame([("a", "completed"), ("a", "skipped"), ("b", "failed"), ("b", "completed"), ("c", "pending"), ("c", "failed"), ("d", "processing"), ("d", "pending")], "doc string, status string")
    assert {r.doc: r.status for r in queue.bubbled(docs, "doc").collect()} == {"a": "completed", "b": "failed", "c": "pending", "d": "processing"}
    assert queue.page_tasks(spark.createDataFrame([("a", 3), ("b", 0)], "document_id string, pages int")).count() == 3


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, datetime(2025, 1, 1, 0, i), ("pending", "processing", "failed")[i % 2 + (i > 6)]) for i in range(10)], "task_id int, event_id int, ts timestamp, status string")
    for k in range(3):
        rows.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = tasks.task_states(tasks.arriving(spark, str(tmp_path / "in"), rows.schema), "task_id", ("ts", "event_id"), "status")
    tasks.run_once(stream, "states", str(tmp_path / "checkpoint"))
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, tasks.task_states(rows, "task_id", ("ts", "event_id"), "status").collect()))


def test_chunks_and_tables(spark):
    parts = texts.chunk("# A\n" + "a " * 600 + "\n# B\n" + "b " * 600, texts.SPLITS["heading"], small=100, large=400)
    assert len(parts) == 2 and parts[1].startswith("# B")
    long = texts.split_long("word. " * 2000, 1000, 1500)
    assert max(map(len, long)) <= 1500 and "".join(long).replace(" ", "") == ("word. " * 2000).replace(" ", "")
    fenced = texts.chunk("```\n# not a heading\n```\n" + "x " * 1000, texts.SPLITS["heading"], small=1)
    assert fenced[0].startswith("```\n# not")
    docs = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n"), (2, None)], "id int, t string")
    assert [r.cells for r in texts.table_rows(docs, "id", "t").collect()] == [{"a": "1", "b": "2"}]
    assert texts.chunks(docs.where("id = 2"), "id", "t").count() == 0
    assert texts.with_rules("| a | b |\n| 1 | 2 |") == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    looped = spark.createDataFrame([(1, "start\n" + "1 same beginning here\n" * 22 + "end")], "id int, t string")
    assert [(r.first_line, r.lines) for r in texts.loops(looped, "id", "t").collect()] == [(2, 22)]
    page = spark.createDataFrame([("<table><tr><td>a</td><td><b>b</b>&amp;</td></tr></table><script>x</script>",)], "h string")
    assert page.select(texts.html_rows(F.col("h")).alias("r"), texts.html_text(F.col("h")).alias("t")).first() == (["| a | b & |"], "a b &")


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name,n\na,1\nNaN,\n")
    assert [tuple(r) for r in files.reader_for("x.csv")(spark, str(tmp_path / "x.csv")).collect()] == [("a", "1"), (None, None)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    assert sorted((str(r.a), r.broken) for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [("1", None), ("None", "not json")]
    store = files.Keyed(spark, str(tmp_path / "kv"), "id")
    store.write(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"))
    store.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"))
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert sorted(map(tuple, store.rows().collect())) == [("b", 3), ("c", 4)]
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, [])], "id int, items array<string>")
    lines = numbered(docs, "id", "items")
    assert sorted(map(tuple, lines.collect())) == [(1, 0, "x"), (1, 1, "y")]
    assert nested(lines, "id").first().line_items_count == 2


def test_phrases():
    assert phrases.groupings("total by month and by region") == ("month", "region")
    assert phrases.aggregate("average total per region") == "avg"
    assert phrases.bounds("over $1,000 and under $2000") == (1000.0, 2000.0)
    assert phrases.asks_extremes("highest and lowest total") and not phrases.asks_extremes("highest total")
    assert phrases.cacheable("What is the refund policy?") and not phrases.cacheable("that is wrong") and not phrases.cacheable("hello")
    assert phrases.intent("what is the total per month")[0] == "analytics" and phrases.intent("hello")[0] == "general"
    assert phrases.retrieval_mode("relationship between A and B") == "global"
    assert phrases.fused(["total sales", "how many orders"]) == ("sum", "count")


def test_fields_are_inferred_by_name_then_by_all_values(spark):
    rows = spark.createDataFrame([("2025-01-05", 1.5, "a", "x1", "2025-01-05", None), ("2025-01-06", None, "a", "x2", "2024-02-01", None), ("", 2.0, "a", "x3", None, None)], "`Purchase Date` string, y double, z string, w string, d string, e string")
    got = {r.field: (r.semantic_type, r.data_type, r.aggregation) for r in fields.inferred(fields.values(rows)).collect()}
    assert got == {
        "Purchase Date": ("date", "datetime", None), "y": ("quantity", "number", "sum"), "z": ("category", "string", "group_by"), "w": ("unknown", "string", None), "d": ("date", "datetime", None), "e": ("unknown", "string", None),
    }
    assert fields.inferred(fields.values(rows.where("false"))).count() == 0


def test_canonical_names_and_clashes(spark):
    rules = {"total": fields.Rule(("Total Sales",), ("amount",), ("tax",)), "tax": fields.Rule((), ("tax",))}
    # Literals keep the order of their fields.
    rows = spark.sql("SELECT map('TOTAL SALES', '1', 'Amount due', '2', 'tax amount', '3', 'other', '4') AS data UNION ALL SELECT NULL UNION ALL SELECT CAST(map() AS map<string, string>)")
    assert values(rows.select(fields.renamed(F.col("data"), rules).alias("m")), "m") == [{"total": "1", "tax": "3", "other": "4"}, None, {}]


def test_registry_seeds_and_three_tiers(spark):
    shape = "schema_type string, domain string, is_active boolean, field_mappings string"
    registry = spark.createDataFrame([("invoice", "money", True, "old"), ("receipt", "money", False, "r")], shape)
    seeds = spark.createDataFrame([("invoice", "money", True, "new"), ("memo", None, True, None)], shape)
    kept = lambda update: {r.schema_type: r.field_mappings for r in fields.seeded(registry, seeds, update).collect()}
    assert kept(True) == {"invoice": "new", "receipt": "r", "memo": None} and kept(False)["invoice"] == "old"
    documents = spark.createDataFrame([(1, "invoice", "own"), (2, "invoice", None), (3, "receipt", None), (4, None, None)], "document_id int, schema_type string, field_mappings string")
    guessed = spark.createDataFrame([("receipt", "guess")], "schema_type string, field_mappings string")
    got = {r.document_id: (r.field_mappings, r.mapping_source) for r in fields.mapped(documents, registry, guessed).collect()}
    assert got == {1: ("own", "document"), 2: ("old", "registry"), 3: ("guess", "inferred"), 4: (None, None)}


def test_entities_of_header_and_text(spark):
    rows = spark.createDataFrame([(1, "From: Acme Inc.\nBill to: Jane Roe\nmail a@acme.com", {"vendor_name": " ACME Corp "}), (2, None, None), (3, "", {})], "id int, text string, header map<string,string>")
    found = entities.merged("id", entities.in_header(rows, "id", "header"), entities.in_text(rows, "id", "text"))
    got = {(r.id, r.kind, r.entity): (r.name, r.confidence, r.is_primary) for r in found.collect()}
    assert got == {(1, "organization", "acme"): ("ACME Corp", 0.95, True), (1, "person", "jane roe"): ("Jane Roe", 0.7, True)}


def test_domain_chunks_and_marks(spark):
    assert texts.chunk("Allergies: none\nPlan: rest", texts.SPLITS["medical"], small=0) == ["Allergies: none", "Plan: rest"]
    assert texts.chunk("# Abstract\nx\n1. Methods\ny", texts.SPLITS["academic"], small=0) == ["# Abstract\nx", "1. Methods\ny"]
    assert texts.chunk("Lesson 1\na\nLesson 2\nb", texts.SPLITS["educational"], small=0) == ["Lesson 1\na", "Lesson 2\nb"]
    rows = spark.createDataFrame([("E11.9 metformin 500 mg [1, 2] Fig. 3\nExercise 4",), (None,)], "text string")
    one, none = (r.m.asDict() for r in rows.select(texts.marks(F.col("text")).alias("m")).collect())
    assert (one["icd_codes"], one["medications"], one["citations"], one["figures"], one["exercises"]) == (1, 1, 1, 1, 1) and not any(none.values())


def test_listed_row_takes_the_first_field_that_counts(spark):
    from ledgerloom.operators.projection import listed_row

    rows = [
        (1, {"Date": "", "order_date": "d2", "total": "", "price": "5", "Qty": "1,200", "Type": "t", "category": "c", "Item": "i", "product": "p"}, {"date": "h"}), (2, {"Price": "$7", "price": "8", "Status": None, "order_status": "s"}, {"date": "", "Invoice Date": "h"}),
        (3, {"Amount": None, "Price": "9", "Area": "a"}, None), (4, None, {"Date": "h"}), (5, {}, {}),
    ]
    df = spark.createDataFrame(rows, "id int, data map<string,string>, header map<string,string>")
    out = df.select("id", *listed_row(df.data, df.header))
    got = {r.id: r.asDict() for r in out.collect()}
    want = {1: dict(date="d2", category="c", product="p", quantity=1200.0, amount=None), 2: dict(date="h", amount=7.0, status="s"), 3: dict(amount=9.0, region="a"), 4: dict(date="h"), 5: {}}
    assert got == {i: dict.fromkeys(out.columns) | {"id": i} | w for i, w in want.items()}
    assert out._jdf.queryExecution().analyzed().toString().count("try_element_at") < 20  # one lookup for each column, not for each name


def test_tabular_texts_of_amounts(spark, tmp_path):
    from ledgerloom.queries.text import tabular_documents

    prose = "a line of some words without any number in it\n" * 4
    rows = [(1, prose + "blue paint 2 x $3.50\n" * 3), (2, prose + "blue paint 2 x $3.50\n" * 2), (3, prose + "01/02/2024 a transfer to someone 7.50\n" * 3), (4, prose), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = tabular_documents(spark, str(tmp_path))
    assert {r.doc_id: r.reason for r in found.collect()} == {1: "line_items", 3: "transaction_list"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("markdown_table") == 1  # the reason is found once


def test_distinct_items_of_any_document_are_dealt_once(spark):
    rows = [(1, 1, {"a": "x", "b": "y"}), (1, 2, {"b": "y", "a": "x"}), (1, 3, {"a": "x"}), (2, 1, {"a": "x"}), (None, 1, {"a": "x"}), (None, 2, {"a": "x"}), (3, 4, None), (3, 5, None)]
    items = spark.createDataFrame(rows, "document_id long, line_number int, data map<string,string>")
    found = projection.distinct_items(items.repartition(5, "document_id"), "document_id", "line_number", "data")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.document_id, r.line_number) for r in found.collect()} == {(1, 1), (1, 3), (2, 1), (None, 1), (3, 4)}
