from pyspark.sql import functions as F

from ledgerloom.functions.json_values import json_length, json_set, json_type
from ledgerloom.functions.names import document_entity_key
from ledgerloom.operators import chunk_trees as C
from ledgerloom.operators import queue as Q


def test_json_values(spark):
    texts = ['{"a": 1}', "[1, [2], 3]", '"x"', "1.5", "2", "true", "null", "{broken", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(json_type(F.col("t")).alias("k"), json_length(F.col("t")).alias("n"), json_set(F.col("t"), "a", F.lit('{"z": [1]}')).alias("s")).collect()
    assert [r.k for r in got] == ["object", "array", "string", "number", "number", "boolean", "null", None, None, "object"]
    assert [r.n for r in got] == [None, 3, None, None, None, None, None, None, None, None]
    assert got[0].s == got[9].s == '{"a":{"z":[1]}}' and got[1].s == "[1, [2], 3]" and got[7].s == "{broken" and got[8].s is None


def test_keys_within_a_document(spark):
    import hashlib

    row = spark.createDataFrame([("w", "d", "ORG", " Acme ")], "w string, d string, k string, n string").select(document_entity_key(F.col("w"), F.col("d"), F.col("k"), F.col("n")).alias("key")).first()
    assert row.key == hashlib.md5(b"w:d:org:acme").hexdigest()


def test_csv_batches():
    text = "id,name\n" + "\n".join(f'{i},"a, b {i}"' for i in range(50))
    nodes = list(C.csv_nodes(text, 120))
    assert [n.path for n in nodes][:2] == [("1", "9"), ("10", "18")] and all(n.text.startswith("id,name\n") and n.head == "id,name" for n in nodes)
    assert sum(n.text.count("\n") for n in nodes) == 50
    assert [n.kind for n in C.csv_nodes("x" * 5000 + "\n1", 300)] == ["csv"] and list(C.csv_nodes("")) == [] and [n.kind for n in C.csv_nodes("a,b")] == ["csv"]


def test_phases_without_tasks(spark):
    tasks = spark.createDataFrame([("ocr", "failed"), ("ocr", "pending"), ("other", "pending")], "phase string, status string")
    got = {r.phase: (r.pending, r.failed) for r in Q.statistics(tasks).collect()}
    assert got == {"ocr": (1, 1), "other": (1, 0), "vector": (0, 0), "graph": (0, 0)}
