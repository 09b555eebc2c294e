import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.rewards import answer_reward
from ledgerloom.operators import contexts as X
from ledgerloom.operators import stored_records as S


@pytest.mark.parametrize(("answer", "question", "reward"), [
    (None, "q", 0.0), ("  ", "q", 0.0), ("yes", "why", 0.0 + 0.0 + 0.12 + 0.12 + 0.2), ("Based on the report, for example, the total is fine.", "What is the report total", 0.2 + 0.16 + 0.2 + 0.2 + 0.2),
    ("I don't know, maybe this might be, perhaps.", "unknown things", 0.08 + 0.0 + 0.08 + 0.0 + 0.2), ("Total of 3 items:\n1. Pen\n2) Tax fee\n", "how many items were bought", 0.08 + 0 + 0.12 + min(0.2, 0.4 / 4) + 0.0),
    ("- a\n- b\nbought 2, all of them, some twice", "count what was bought", 0.08 + 0 + 0.12 + 0.4 / 3 + 0.15),
])
def test_answer_reward(spark, answer, question, reward):
    got = spark.createDataFrame([(answer, question)], "a string, q string").select(answer_reward(F.col("a"), F.col("q")).alias("r")).first().r
    assert got == pytest.approx(reward)


def test_contexts(spark):
    rows = [("q", i, "x" * n, 1, float(-i)) for i, n in enumerate([200, 100, 400, 40, 4])]
    frame = spark.createDataFrame(rows + [("r", 9, None, 1, 0.0)], "q string, id int, text string, priority int, score double")
    told = spark.createDataFrame([("q", "g" * 100), ("r", "short"), ("s", None)], "q string, text string")
    got = {(r.q, r.section, r.id): r.tokens for r in X.contexts(frame, frame.where("id > 2"), told, "q", "id", "text", 100).collect()}
    assert got == {("q", "chunk", 0): 50, ("q", "chunk", 3): 10, ("q", "parent", 3): 10, ("q", "parent", 4): 1, ("q", "graph", None): 15, ("r", "graph", None): 1}
    text = {r.q: r.context for r in X.told_in_order(X.contexts(frame, frame.limit(0), told, "q", "id", "text", 100), "q", "id", "text").collect()}
    assert text["r"] == "[Knowledge Graph Context]\nshort" and text["q"].startswith("[Knowledge Graph Context]\n" + "g" * 60 + "...\n\n---\n\nxx")


def test_size_of(spark):
    rows = spark.createDataFrame([("ab", 1), (None, 22)], "name string, n int")
    assert X.size_of(rows).first().asDict() == {"row_count": 2, "column_count": 2, "estimated_tokens": 500 + (len("| ab | 1 |\n| - | 22 |\n") + len("| name | n |\n") + len("| --- | --- |\n")) // 4, "exceeds_limit": False}
    assert X.size_of(rows, most_rows=1).first().exceeds_limit and X.size_of(rows, most_tokens=10).first().exceeds_limit
    assert tuple(X.size_of(rows.limit(0)).first()) == (0, 2, 0, False)


def test_documents_by_summary(spark):
    rows = [(1, "a", "tabular_summary", 0.9), (2, "a", "tabular_summary", 0.8), (3, "b", "text", 1.0), (4, "c", "tabular_summary", 0.7), (5, "d", "tabular_summary", 0.1)]
    chunks = spark.createDataFrame(rows, "chunk_id int, document_id string, chunk_type string, score double")
    assert sorted(r.chunk_id for r in X.documents_by_summary(chunks, 10, 0.5).collect()) == [1, 4]
    acl = spark.createDataFrame([("c",)], "document_id string")
    assert [r.chunk_id for r in X.documents_by_summary(chunks, 10, 0.5, acl).collect()] == [4] and X.documents_by_summary(chunks, 10, 0.5, acl.limit(0)).collect() == []


def test_rows_replace_those_with_their_key(spark, tmp_path):
    folder = str(tmp_path / "items")
    rows = lambda pairs: spark.createDataFrame(pairs, "id long, v string")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(S.stored(rows([(i, "a") for i in range(20)] + [(3, "b")]), folder, "id", 4)) == sorted([(i, "a") for i in range(20)] + [(3, "b")])
    got = told(S.replaced(folder, rows([(3, "new"), (99, "more")]), "id", 4))
    assert got == sorted([(i, "a") for i in range(20) if i != 3] + [(3, "new"), (99, "more")])
    assert told(S.replaced(folder, rows([(5, "x")]), "id", 4, of=rows([(5, ""), (6, "")]))) == sorted([(i, "a") for i in range(20) if i not in (3, 5, 6)] + [(3, "new"), (5, "x"), (99, "more")])
    assert S.deleted(folder, rows([(1, ""), (1, ""), (1000, "")]), "id", 4) == 1 and S.deleted(folder, rows([(1, "")]), "id", 4) == 0
    assert S.deleted(folder, rows([(i, "") for i in range(100)]), "id", 4) == 19 and S.read(spark, folder).collect() == []
    assert told(S.replaced(folder, rows([(7, "back")]), "id", 4)) == [(7, "back")]


def test_saved_records(spark, tmp_path):
    records = lambda rows: spark.createDataFrame(rows, "document_id long, name string")
    items = lambda rows: spark.createDataFrame(rows, "document_id long, line_number int")
    a, b = str(tmp_path / "r"), str(tmp_path / "i")
    S.stored(records([(1, "old"), (2, "two")]).withColumn("line_items_count", F.lit(9)), a, "document_id", 4)
    S.stored(items([(1, 0), (1, 1), (2, 0)]), b, "document_id", 4)
    got = S.saved(records([(1, "new"), (3, "three")]), items([(3, 0), (3, 1)]), a, b, parts=4)
    assert sorted(map(tuple, got[0].collect())) == [(1, "new", 0), (2, "two", 9), (3, "three", 2)] and sorted(map(tuple, got[1].collect())) == [(2, 0), (3, 0), (3, 1)]
