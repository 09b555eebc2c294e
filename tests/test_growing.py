import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph_store as S
from ledgerloom.plans import execution as X
from ledgerloom.streaming.files import settled, settled_stream
from ledgerloom.streaming.tasks import arriving


def found(n=400, seed=1):
    rnd = random.Random(seed)
    words = ["red", "blue", "green", "a", "of", "x", "ed", "lu"]
    text = lambda: rnd.choice([None, "", *(" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(6))])
    return [("hub" if i % 2 else f"n{i % 9}", i, f"name{i % 5}", rnd.randint(0, 99), f"c{i % 50}", f"d{i % 7}", text()) for i in range(n)]


def plain_texts(rows):
    kept = {}
    first = {}
    for key, at, *_, text in sorted(rows, key=lambda r: r[1]):
        if text:
            first.setdefault((key, text), at)
    for (key, text), at in first.items():
        if not any(k == key and a < at and text in t for (k, t), a in first.items()):
            kept[key, text] = at
    return kept


def frame(spark, rows):
    return spark.createDataFrame(rows, "node string, at int, name string, score int, chunk_id string, document_id string, description string")


def test_two_batches_give_what_one_gives(spark, tmp_path):
    rows = found()
    one = S.batch(frame(spark, rows), "node", ["name"], "score")
    first = S.written(S.batch(frame(spark, rows[:150]), "node", ["name"], "score"), str(tmp_path / "1"))
    two = S.written(S.grown(first, S.batch(frame(spark, rows[150:]), "node", ["name"], "score"), "node", ["name"], "score"), str(tmp_path / "2"))
    for part in ("things", "sources", "texts"):
        a, b = getattr(one, part), getattr(two, part)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert {(r.node, r.description): r.at for r in two.texts.collect()} == plain_texts(rows)
    told = {r.node: r.description for r in S.described(one, "node").collect()}
    hub = sorted((at, t) for (k, t), at in plain_texts(rows).items() if k == "hub")
    assert told["hub"] == " | ".join(t for _, t in hub)


def test_a_hub_of_many_texts_is_dealt_over_rows(spark):
    rows = spark.range(20000).select(F.lit("hub").alias("node"), F.col("id").alias("at"), F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" of the hub")).alias("description"))
    more = rows.select("node", (F.col("at") + 20000).alias("at"), F.substring("description", 3, 9).alias("description"))
    kept = S.kept_texts(rows.union(more), "node", "at")
    assert kept.where("at < 20000").count() == 20000
    assert kept.groupBy("node", "at").count().where("count > 1").count() == 0


def test_nothing_to_merge(spark):
    none = S.batch(frame(spark, []), "node", ["name"], "score")
    some = S.batch(frame(spark, found(20)), "node", ["name"], "score")
    assert S.grown(none, some, "node", ["name"], "score").things.count() == some.things.count() == S.grown(some, none, "node", ["name"], "score").things.count()


def test_retrieval_goes_on_from_what_it_found(spark):
    nodes = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(12)], "node long, embedding array<double>")
    edges = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(0, 5), (3, 3)], "src long, tgt long")
    got = {(r.node, r.step) for r in S.retrieved(nodes, edges, [1.0, 0.0], 2, 3).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (5, 1), (3, 2), (4, 2)}
    assert {r.step for r in S.retrieved(nodes, edges, [1.0, 0.0], 2, 9, enough=0.4).collect()} == {0, 1, 2}
    assert S.retrieved(nodes, edges, [1.0, 0.0], 2, 3, least=2.0).collect() == []


def plain_changes(events, quiet):
    out, by = [], {}
    for path, at, digest, gone in events:
        by.setdefault(path, []).append((at, bool(gone), digest or ""))
    for path, rows in by.items():
        rows.sort()
        there, version = False, 0
        for i, (at, gone, digest) in enumerate(rows):
            if i + 1 < len(rows) and (rows[i + 1][0] - at).total_seconds() <= quiet:
                continue
            if not gone or there:
                version += 1
                out.append((path, at, digest, "deleted" if gone else "modified" if there else "created", version))
            there = not gone
    return sorted(out)


def events(seed, n=150):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"p{rnd.randint(0, 5)}.md", start + dt.timedelta(seconds=rnd.randint(0, 3000)), f"d{rnd.randint(0, 9)}", rnd.random() < 0.25) for _ in range(n)]
    return rows + [rows[0], rows[1]]


FIELDS = "path string, modified timestamp, digest string, deleted boolean"


def test_settled(spark):
    rows = events(1)
    got = [tuple(r) for r in settled(spark.createDataFrame(rows, FIELDS), 30).collect()]
    assert sorted(got) == plain_changes(rows, 30)
    assert settled(spark.createDataFrame([], FIELDS), 30).collect() == []


def test_stream_of_changes_is_that_of_the_table(spark, tmp_path):
    rows = sorted(events(2), key=lambda r: r[1])
    rnd = random.Random(3)
    parts = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    for part in parts:
        rnd.shuffle(part)
    last = dt.datetime(2025, 1, 1)
    parts += [[("z.md", last, "x", False)], [("z.md", last + dt.timedelta(days=1), "x", False)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.parquet(str(tmp_path / "new" / f"{i:03}"))
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(len(parts)):
        file = next((tmp_path / "new" / f"{i:03}").glob("*.parquet"))
        file.rename(folder / f"{i:03}.parquet")
    import os

    for i, f in enumerate(sorted(folder.glob("*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = settled_stream(arriving(spark, str(folder), spark.createDataFrame([], FIELDS).schema), 30, "60 seconds")
    q = stream.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = sorted(tuple(r) for r in spark.table("changes").where("path <> 'z.md'").collect())
    assert got == plain_changes(rows, 30)


def test_plans():
    T = X.Task
    plan = X.planned([T("c", "", needs=("a", "b")), T("a", "", priority=1), T("b", "", priority=5), T("d", "", needs=("c",))])
    assert [[t.name for t in s] for s in plan.steps] == [["b", "a"], ["c"], ["d"]] and plan.strategy == "mixed"
    assert X.planned([T("a", ""), T("b", "")]).strategy == "parallel" and X.planned([T("b", "", needs=("a",)), T("a", "")]).strategy == "sequential" and X.planned([]).steps == ()
    for bad in ([T("a", "", needs=("b",)), T("b", "", needs=("a",))], [T("a", "", needs=("x",))], [T("a", ""), T("a", "")]):
        with pytest.raises(ValueError):
            X.planned(bad)
    fields = {"invoice": frozenset({"total", "date"}), "receipt": frozenset({"total"}), "memo": frozenset({"text"})}
    tasks = [T("a", "sum", ("invoice",)), T("b", "sum", ("receipt",), priority=3), T("m", "sum", ("memo",)), T("z", "join", (), ("a", "b", "m"))]
    assert X.combined(tasks, fields) == [T("a", "sum", ("invoice", "receipt"), priority=3), tasks[2], T("z", "join", (), ("a", "m"))]


def test_fused_averages_are_those_of_all_amounts(spark):
    rows = spark.createDataFrame([("x", "k", 1.1), ("x", "k", 2.2), ("y", "k", 30.0), ("y", "l", None), ("x", "m", 5.0)], "kind string, g string, a double")
    parts = [rows.where(f"kind = '{k}'").groupBy("g").agg(*X.partial(F.col("a"))) for k in ("x", "y")]
    got = {r.g: (r["count"], r.sum, r.average, r.least, r.most) for r in X.fused(parts[0].union(parts[1]), ["g"]).collect()}
    assert got == {"k": (3, 33.3, pytest.approx(11.1), 1.1, 30.0), "l": (0, None, None, None, None), "m": (1, 5.0, 5.0, 5.0, 5.0)}


def test_stores_keep_what_they_are_asked_for(spark):
    rows, node = found(60), dict(key="node", keep=["name"], most="score")
    bare = S.held(S.grown(S.batch(frame(spark, rows[:30]), **node, texts=False), S.batch(frame(spark, rows[30:]), **node, texts=False), **node, texts=False), ("things", "sources"))
    full = S.batch(frame(spark, rows), **node)
    assert sorted(map(tuple, bare.sources.collect())) == sorted(map(tuple, full.sources.collect())) and sorted(map(tuple, bare.things.collect())) == sorted(map(tuple, full.things.collect()))
    assert bare.texts.count() == 0 and bare.texts.columns == full.texts.columns
    plan = full.texts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [run" in plan and "BroadcastHashJoin [run" not in plan  # runs are far more than Spark's estimate
