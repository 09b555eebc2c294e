"""Queries of names that are alike, and of JSON that arrives broken. Names are made of the keys of customers and suppliers, with variants that lack, add or swap characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.broken_json import json_in, json_objects
from ledgerloom.operators.name_lookup import looked_up
from ledgerloom.operators.similar_names import representatives, similar_names
from ledgerloom.registry import query
from ledgerloom.tables import table

PARTIES = """
names AS (
  SELECT kind, key * 4 + v AS place, CASE v WHEN 0 THEN n WHEN 1 THEN n[1:4] || n[6:] WHEN 2 THEN n || 'x' ELSE n[2] || n[1] || n[3:] END AS name
  FROM (SELECT 'customer' AS kind, c_custkey AS key, md5(c_name)[1:14] AS n FROM customer UNION ALL SELECT 'supplier', s_suppkey, md5(s_name)[1:14] FROM supplier), range(4) r(v)
  WHERE v = 0 OR v = 1 AND key % 3 = 0 OR v = 2 AND key % 4 = 0 OR v = 3 AND key % 5 = 0
), one AS (
  SELECT kind, name, min(place) AS place, length(name) AS n, (1::BIGINT << length(name)) - 1 AS bits, list_transform(string_split(name, ''), lambda c: strpos('0123456789abcdefx', c)) AS codes,
    list_transform(range(1, 18), lambda c: list_sum(list_transform(range(1, length(name) + 1), lambda i: CASE WHEN name[i] = '0123456789abcdefx'[c] THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT) AS places
  FROM names GROUP BY kind, name
), pairs AS (
  SELECT kind, first, second, first_place, second_place, 200.0 * lcs / both_n AS ratio FROM (
    SELECT a.kind, a.name AS first, b.name AS second, a.place AS first_place, b.place AS second_place, a.n + b.n AS both_n,
      a.n - bit_count(list_reduce(list_prepend(a.bits, list_transform(b.codes, lambda c: a.places[c])), lambda v, m: ((v + (v & m)) | (v - (v & m))) & a.bits)) AS lcs
    FROM one a JOIN one b ON a.kind = b.kind AND (a.n < b.n OR a.n = b.n AND a.name < b.name)
  ) WHERE 200 * lcs >= 85 * both_n
)"""


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(f"{p}key").alias("key"), F.left(F.md5(name), F.lit(14)).alias("n")) for t, p, name in (("customer", "c_cust", "c_name"), ("supplier", "s_supp", "s_name"))]
    n, key = F.col("n"), F.col("key")
    variants = F.array(
        n, F.when(key % 3 == 0, F.concat(F.left(n, F.lit(4)), F.substring(n, 6, 14))), F.when(key % 4 == 0, F.concat(n, F.lit("x"))),
        F.when(key % 5 == 0, F.concat(F.substring(n, 2, 1), F.substring(n, 1, 1), F.substring(n, 3, 14))),
    )
    return parties[0].union(parties[1]).select("kind", "key", F.posexplode(variants).alias("v", "name")).where("name IS NOT NULL").select("kind", "name", (key * 4 + F.col("v")).alias("place"))


@query(f"WITH {PARTIES} SELECT kind, first, second, round(ratio, 6) AS ratio FROM pairs")
def alike_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of names of one kind of party that are at least 85 % alike."""
    return similar_names(_parties(spark, sf_dir), within=("kind",)).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH RECURSIVE {PARTIES}, ordered AS (
  SELECT kind, name, row_number() OVER (ORDER BY kind, place, name) AS k FROM one
), near AS (
  SELECT o.k, o.kind, o.name, coalesce(list(e.k ORDER BY e.k) FILTER (e.k < o.k), []) AS before FROM ordered o
  LEFT JOIN (SELECT kind, first AS a, second AS b FROM pairs UNION ALL SELECT kind, second, first FROM pairs) p ON p.kind = o.kind AND p.a = o.name
  LEFT JOIN ordered e ON e.kind = p.kind AND e.name = p.b GROUP BY ALL
), gone_through AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS heads, NULL::BIGINT AS by
  UNION ALL SELECT n.k, CASE WHEN list_has_any(heads, before) THEN heads ELSE list_append(heads, n.k) END, coalesce(list_min(list_intersect(heads, before)), n.k) FROM gone_through g JOIN near n ON n.k = g.k + 1
)
SELECT n.kind, n.name, h.name AS representative FROM gone_through g JOIN near n USING (k) JOIN ordered h ON h.k = g.by""")
def name_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that stands for each name: names are gone through by key, and one that is like a representative belongs to the first such."""
    return representatives(_parties(spark, sf_dir), "place", within=("kind",))


@query("""WITH b AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, CAST(1 + CASE WHEN before IS NULL OR json(before) = json(props) THEN 0 ELSE 1 END AS INTEGER) + 1 AS objects, CAST(coalesce(before, props)->>'k' AS BIGINT) AS first_k, event_id AS last_id FROM b WHERE props IS NOT NULL""")
def repaired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two events and a number, joined with and without commas, with a fourth that is cut off: repeats and the cut one go, all others come back."""
    events = table(spark, sf_dir, "events")
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("event_id"))
    own = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}"))
    comma = F.when(F.col("event_id") % 2 == 0, ", ").otherwise(F.when(F.col("event_id") % 3 == 0, "\n").otherwise(""))
    cut = F.left(F.concat(F.lit('{"text": "a } ] \\" b", "list": [1, {"k": '), F.col("event_id").cast("string")), F.lit(2) + F.pmod(F.xxhash64("event_id"), F.lit(40)).cast("int"))
    broken = F.concat(F.lit("["), F.coalesce("before", "props"), comma, "props", comma, own, F.lit(", "), cut)
    found = events.withColumn("before", before).where("props IS NOT NULL").select("event_id", json_objects(broken).alias("found"))
    first, last = F.element_at("found", 1), F.element_at("found", -1)
    return found.select("event_id", F.size("found").alias("objects"), F.get_json_object(first, "$.k").cast("long").alias("first_k"), F.get_json_object(last, "$.id").cast("long").alias("last_id"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(props->>'k' AS BIGINT) END AS k FROM events WHERE props IS NOT NULL")
def salvaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in an answer that has it bare, between fences or inside other text; none where it is cut off."""
    c, way = F.col, F.col("event_id") % 5
    answer = F.when(way == 0, c("props")).when(way == 1, F.concat(F.lit("Here:\n```json\n"), c("props"), F.lit("\n```\nDone {it}"))).when(way == 2, F.concat(F.lit("```\n"), c("props"), F.lit("```")))
    answer = answer.when(way == 3, F.concat(F.lit("The answer is "), c("props"), F.lit(" as asked."))).otherwise(F.left(c("props"), F.length("props") - 1))
    return table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.get_json_object(json_in(answer), "$.k").cast("long").alias("k"))


@query(f"""WITH {PARTIES}, wanted AS (SELECT name AS w, min(place) AS place FROM (SELECT name, place FROM names WHERE kind = 'supplier' UNION ALL SELECT name[3:10], place + 1000000 FROM names WHERE kind = 'customer' AND place % 200 = 0) GROUP BY 1),
n AS (SELECT DISTINCT name FROM names WHERE kind = 'customer' OR place % 3 = 0), f AS (
  SELECT n.name, w, place, CASE WHEN n.name = w THEN 0 WHEN contains(n.name, w) OR contains(w, n.name) THEN 1 WHEN 200 * (length(w) - bit_count(list_reduce(list_prepend((1::BIGINT << length(w)) - 1,
    list_transform(string_split(n.name, ''), lambda c: coalesce(list_sum(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN w[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END)), 0)::BIGINT)),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(w)) - 1)))) >= 80 * (length(w) + length(n.name)) THEN 2 END AS way FROM n, wanted
)
SELECT name, arg_min(w, place) AS wanted, CASE arg_min(way, place) WHEN 0 THEN 'exact' WHEN 1 THEN 'substring' ELSE 'fuzzy' END AS match FROM f WHERE way IS NOT NULL GROUP BY 1""")
def names_looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers, and some of suppliers, looked up among those of suppliers and parts of customers' names."""
    rows = _parties(spark, sf_dir)
    place = F.col("place")
    wanted = rows.where("kind = 'supplier'").select("name", "place").union(rows.where("kind = 'customer'").where(place % 200 == 0).select(F.substring("name", 3, 8), place + 1000000))
    return looked_up(rows.where((F.col("kind") == "customer") | (place % 3 == 0)), wanted)
