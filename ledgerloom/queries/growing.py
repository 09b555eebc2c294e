"""Queries of a graph that grows in batches, of retrieval in steps, of files that settle, and of plans whose parts are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph_store as S
from ledgerloom.plans.execution import Task, executed, fused, partial, planned
from ledgerloom.registry import query
from ledgerloom.streaming.files import settled, wanted
from ledgerloom.tables import table

FOUND = """SELECT o_custkey % 97 AS node, o_orderkey AS place, 'Node ' || (o_orderkey % 5) AS name, CAST(o_totalprice AS BIGINT) % 100 AS score, 'o' || o_orderkey AS chunk_id, o_orderstatus AS document_id,
substr(o_orderpriority || ' of ' || o_orderstatus || ' in ' || year(o_orderdate), CAST(1 + o_orderkey % 9 AS INTEGER), CAST(1 + o_orderkey % 23 AS INTEGER)) AS description FROM orders"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = F.concat("o_orderpriority", F.lit(" of "), "o_orderstatus", F.lit(" in "), F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select(
        (c("o_custkey") % 97).alias("node"), c("o_orderkey").alias("place"), F.concat(F.lit("Node "), (c("o_orderkey") % 5).cast("string")).alias("name"), (F.round("o_totalprice").cast("long") % 100).alias("score"),
        F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("chunk_id"), c("o_orderstatus").alias("document_id"),
        F.substring(text, (1 + c("o_orderkey") % 9).cast("int"), (1 + c("o_orderkey") % 23).cast("int")).alias("description"),
    )


def _in_batches(spark: SparkSession, sf_dir: str, part: str) -> S.Stored:
    """Three batches by date, merged one after the other; `place` says which was first. The store keeps its things and one other part, sources or texts."""
    rows, stored = _found(spark, sf_dir), None
    cuts = [r[0] for r in rows.select(F.percentile_approx("place", [0.3, 0.7]).alias("c")).select(F.explode("c")).collect()]
    bounds = [F.lit(True) if not cuts else (F.col("place") <= cuts[0]), *([] if not cuts else [(F.col("place") > cuts[0]) & (F.col("place") <= cuts[1]), F.col("place") > cuts[1]])]
    for test in bounds:
        new = S.batch(rows.where(test), "node", ["name"], "score", "place", part == "texts")
        stored = S.held(new if stored is None else S.grown(stored, new, "node", ["name"], "score", "place", part == "texts"), ("things", part))
    return stored


@query(f"""WITH f AS ({FOUND}), t AS (SELECT node, description, min(place) AS place FROM f WHERE description <> '' GROUP BY 1, 2)
SELECT node, place, description FROM t WHERE NOT EXISTS (SELECT 1 FROM t e WHERE e.node = t.node AND e.place < t.place AND contains(e.description, t.description))""")
def descriptions_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of each node that no earlier one contains, from three batches."""
    return _in_batches(spark, sf_dir, "texts").texts.select("node", "place", "description")


@query(f"SELECT node, arg_min(name, place) AS name, max(score) AS score, count(DISTINCT chunk_id) AS chunks, count(DISTINCT document_id) AS documents FROM ({FOUND}) GROUP BY 1")
def nodes_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of three batches with their sources counted."""
    stored = _in_batches(spark, sf_dir, "sources")
    counted = stored.sources.groupBy("node").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("document_id").alias("documents"))
    return stored.things.select("node", "name", "score").join(counted, "node")


@query("""WITH RECURSIVE s AS (SELECT e.vec_id AS v, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
w AS (SELECT a, b FROM (SELECT vec_id AS a, (vec_id * 7 + label) % (SELECT count(*) FROM embeddings) AS b FROM embeddings) UNION SELECT b, a FROM (SELECT vec_id AS a, (vec_id * 7 + label) % (SELECT count(*) FROM embeddings) AS b FROM embeddings)),
near AS (SELECT a, list({'v': v, 'score': score}) AS ways FROM w JOIN s ON v = b WHERE score >= -0.2 GROUP BY a),
known AS (SELECT map_from_entries(list({'k': a, 'v': ways})) AS m FROM near),
steps AS (
  SELECT 0 AS step, list_slice(list_sort(list({'late': -score, 'v': v})), 1, 6) AS front, [x.v FOR x IN list_slice(list_sort(list({'late': -score, 'v': v})), 1, 6)] AS seen FROM s WHERE score >= -0.2
  UNION ALL SELECT step + 1, fresh, list_concat(seen, [x.v FOR x IN fresh]) FROM (
    SELECT step, seen, list_slice(list_sort(list_distinct([{'late': -x.score, 'v': x.v} FOR x IN flatten([coalesce(m[f.v], []) FOR f IN front]) IF NOT list_contains(seen, x.v)])), 1, 6) AS fresh FROM steps, known WHERE step < 4 AND len(front) > 0
  )
)
SELECT f.v AS node, round(-f.late, 9) AS score, step FROM (SELECT step, unnest(front) AS f FROM steps)""")
def retrieved_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to vector 0, and those that four steps along edges find from them."""
    rows = table(spark, sf_dir, "embeddings")
    n, question = rows.count(), rows.where("vec_id = 0").select("embedding").first()
    nodes = rows.select(F.col("vec_id").alias("node"), "embedding")
    edges = rows.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + F.col("label")) % max(n, 1)).alias("tgt"))
    return S.retrieved(nodes, edges, list(question.embedding) if question else [], 6, 4, least=-0.2).withColumn("score", F.round("score", 9))


@query("""WITH e AS (SELECT 'f' || user_id || '.md' AS path, ts AS modified, md5(props) AS digest, event_type = (SELECT min(event_type) FROM events) AS deleted FROM events WHERE user_id % 10 <> 3),
m AS (SELECT *, coalesce(modified - lag(modified) OVER (PARTITION BY path ORDER BY modified) > INTERVAL 3600 SECONDS, true) AS fresh FROM e),
n AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY path ORDER BY modified) AS run FROM m),
r AS (SELECT path, max({'modified': modified, 'deleted': deleted, 'digest': digest}) AS l FROM n GROUP BY path, run),
t AS (SELECT path, l.modified AS modified, l.digest AS digest, l.deleted AS deleted, coalesce(lag(NOT l.deleted) OVER (PARTITION BY path ORDER BY l.modified), false) AS there FROM r)
SELECT path, modified, digest, CASE WHEN deleted THEN 'deleted' WHEN there THEN 'modified' ELSE 'created' END AS change, row_number() OVER (PARTITION BY path ORDER BY modified) AS version FROM t WHERE there OR NOT deleted""")
def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that users' events change, as they settle after an hour; one kind of event deletes, and other endings are passed over."""
    events = table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type")).first()[0]
    ending = F.when(F.col("user_id") % 10 == 3, ".txt").otherwise(".md")
    rows = events.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string"), ending).alias("path"), F.col("ts").alias("modified"), F.md5("props").alias("digest"), (F.col("event_type") == F.lit(least)).alias("deleted"),
    )
    return settled(wanted(rows), 3600)


@query("""SELECT r_name AS region, count(l_extendedprice) AS count, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS sum, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) / count(l_extendedprice) AS average,
min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def fused_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by region: one task for each kind of record, and a last one that joins their answers."""
    c = F.col
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").alias("c_nationkey"), c("r_name").alias("region"))
    customers = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(c("c_custkey").alias("o_custkey"), "region")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey")).join(customers, "o_custkey")
    kinds = {"finished": c("o_orderstatus") == "F", "open": c("o_orderstatus") == "O", "other": ~c("o_orderstatus").isin("F", "O")}
    tasks = [Task("all", "averages", needs=tuple(kinds)), *(Task(name, "amounts", (name,)) for name in kinds)]

    def answer(task: Task, given) -> DataFrame:
        if task.needs:
            return fused(reduce(DataFrame.unionByName, given.values()), ["region"])
        return rows.where(kinds[task.name]).groupBy("region").agg(*partial(c("l_extendedprice")))

    return executed(planned(tasks), answer)["all"]
