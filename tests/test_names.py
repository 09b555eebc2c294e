import json
import random

import pytest

from ledgerloom.functions import broken_json as J
from ledgerloom.operators import similar_names as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def like(a, b, least=85):
    return 200 * lcs(a, b) >= least * (len(a) + len(b))


def variants(seed, n=120):
    rnd = random.Random(seed)
    names = ["".join(rnd.choices("abcdé ", k=rnd.randint(1, 16))) for _ in range(n)]
    for name in list(names):
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(name))
            names.append(name[:at] + rnd.choice("abcz") + name[at + rnd.randint(0, 1) :])
    return names


@pytest.mark.parametrize("least", [67, 85, 95, 100])
def test_alike_names_share_a_segment(least):
    rnd = random.Random(least)
    for _ in range(4000):
        a = "".join(rnd.choices("abc", k=rnd.randint(1, 20)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b"])
        a, b = sorted((a, "".join(b)), key=len)
        assert S.common(a, b) == lcs(a, b)
        if b and a and like(a, b, least):
            assert set(S.kept_segments(a, least)) & set(S.sought_segments(b, least)), (a, b)


def test_similar_names_finds_every_pair(spark):
    names = variants(1)
    rows = [(("x", "y", None)[i % 3], n, i) for i, n in enumerate(names)] + [("x", None, 0), ("x", "", 0), ("x", names[0], 5), ("x", names[0], 6)]
    got = S.similar_names(spark.createDataFrame(rows, "kind string, label string, first int"), "label", ("kind",))
    want = set()
    for kind in ("x", "y", None):
        own = sorted({n for k, n, _ in rows if k == kind and n}, key=lambda n: (len(n), n))
        want |= {(kind, a, b) for i, a in enumerate(own) for b in own[i + 1 :] if like(a, b)}
    found = got.collect()
    assert len(found) == len(want) and {(r.kind, r.first, r.second) for r in found} == want
    assert all(abs(r.ratio - 200 * lcs(r.first, r.second) / (len(r.first) + len(r.second))) < 1e-9 for r in found)


@pytest.mark.parametrize("least", [80, 85])
def test_unlike_names_share_no_key(least):
    rnd = random.Random(5)
    names = ["".join(rnd.choices("0123456789abcdef", k=rnd.choice([14, 15]))) for _ in range(300)]
    names += [n[:4] + n[5:] for n in names[:40]]
    holders, lengths = {}, {13, 14, 15}
    for n in names:
        for k in S.kept_segments(n, least, lengths):
            holders.setdefault(k, []).append(n)
    met = {(min(a, n), max(a, n)) for n in names for k in S.sought_segments(n, least, lengths) for a in holders.get(k, ()) if a != n}
    assert len(met) >= 40 and all(like(a, b, least) for a, b in met)


def test_keys_of_names_are_not_broadcast(spark):
    names = spark.createDataFrame([(n,) for n in variants(9, 20)], "name string")
    plan = S.similar_names(names)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan


@pytest.mark.parametrize("seed", [2, 3])
def test_representatives_are_those_of_going_through_in_order(spark, seed):
    names = variants(seed) + ["a" * k for k in range(6, 30)]  # a chain: each is like the next
    rows = [("k" if i % 4 else None, n, i) for i, n in enumerate(names)]
    got = {(r.kind, r.name): r.representative for r in S.representatives(spark.createDataFrame(rows, "kind string, name string, at int"), "at", within=("kind",)).collect()}
    want = {}
    for kind in ("k", None):
        first = {}
        for k, n, i in rows:
            if k == kind:
                first.setdefault(n, i)
        heads = []
        for n in sorted(first, key=lambda n: (first[n], n)):
            by = next((h for h in heads if like(h, n)), None)
            if by is None:
                heads.append(n)
            want[kind, n] = by or n
    assert got == want


def test_no_names(spark):
    none = spark.createDataFrame([], "name string, at int")
    assert S.similar_names(none).collect() == [] and S.representatives(none, "at").collect() == []
    with pytest.raises(ValueError):
        S.similar_names(none, least=50)


@pytest.mark.parametrize(("text", "objects"), [
    ('[{"a":1}{"a":2},{"a":1},{"b":"x}y"', ['{"a":1}', '{"a":2}']), ('{"a": "un', ['{"a":"un"}']), ('[{"bbox":[1,2],"text":"ab\\', ['{"bbox":[1,2],"text":"ab"}']), ("none", []), ("", []), (None, []),
    ('see {"k": [1, {"z": 2}, 3], "u": tr', ['{"k":[1,{"z":2},3]}']), ('[{"a": 1 {"a": 2}, {"a":]} {"c":3}]', ['{"a":2}', '{"c":3}']), ('{"a":1,"b":', ['{"a":1}']), ('{"a":{"b":"x","c', ['{"a":{"b":"x"}}']),
    ('```json\n[{"b":1,"a":2}]\n```', ['{"a":2,"b":1}']), ('[{"a":"\\"}{"}{"b":2}', ['{"a":"\\"}{"}', '{"b":2}']), ("{" * 20000, ["{}"][:0]),
])
def test_repaired(text, objects):
    assert J.repaired(text) == objects


def test_every_cut_keeps_what_is_whole():
    rnd = random.Random(4)
    value = lambda deep=0: rnd.choice([lambda: rnd.randint(-9, 99), lambda: 'x"}]{[,\\' * rnd.randint(0, 2), lambda: None, lambda: [value(deep + 1) for _ in range(rnd.randint(0, 3))] if deep < 3 else 1, lambda: {f"k{i}": value(deep + 1) for i in range(rnd.randint(0, 3))} if deep < 3 else 2])()
    for _ in range(150):
        objects = [{"n": i, "v": value()} for i in range(rnd.randint(1, 5))]
        texts = [json.dumps(o) for o in objects]
        joined = "[" + "".join(t + rnd.choice([", ", "", "\n"]) for t in texts)
        at = rnd.randint(0, len(joined))
        whole, begin = [], 1
        for o, t in zip(objects, texts):
            begin = joined.index(t, begin) + len(t)
            if begin <= at:
                whole.append(o)
        got = [json.loads(x) for x in J.repaired(joined[:at])]
        if whole:
            assert got == whole
        assert len(got) <= max(1, len(whole))
        for g in got:
            assert not whole or g in whole


def test_json_columns(spark):
    rows = [(1, 'x {"b": 1, "a": {"c": "é"}} y'), (2, None), (3, "[1]"), (4, '```\n{"k": 1}\n```')]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.one, r.all) for r in df.select("id", J.json_in(df.text).alias("one"), J.json_objects(df.text).alias("all")).collect()}
    assert got == {1: ('{"a":{"c":"é"},"b":1}', ['{"a":{"c":"é"},"b":1}']), 2: (None, []), 3: (None, []), 4: ('{"k":1}', ['{"k":1}'])}


def test_names_are_looked_up_as_one_by_one(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators.name_lookup import looked_up
    from ledgerloom.operators.predicates import name_match

    rnd = random.Random(8)
    names = [n.strip() for n in variants(8, 60)] + ["Acme Inc.", "ACME", "Acme Trading", "amzn", "", None, "Bolt Ltd", "b"]
    wanted = [*rnd.sample([n for n in names if n], 12), "acme", "Amazon.com", "Boltt", "zzzz"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.wanted, r.match) for r in looked_up(df, spark.createDataFrame(list(enumerate(wanted)), "place int, name string")).collect()}
    tested = df.select("name", *(name_match(F.col("name"), [w], 80).alias(f"w{i}") for i, w in enumerate(wanted))).distinct().collect()
    want = {}
    for r in tested:
        hit = next(((i, r[f"w{i}"]) for i in range(len(wanted)) if r[f"w{i}"]), None)
        if hit:
            want[r.name] = hit
    assert {n: m for n, (_, m) in got.items()} == {n: m for n, (_, m) in want.items()}
    form = lambda w: spark.createDataFrame([(w,)], "n string").select(names_form(F.col("n")).alias("f")).first().f
    from ledgerloom.functions.names import entity_name as names_form

    assert all(form(got[n][0]) == form(wanted[i]) for n, (i, _) in list(want.items())[:15])


def test_lookup_broadcasts_neither_keys_nor_runs(spark):
    import re

    from ledgerloom.operators.name_lookup import looked_up

    names = spark.createDataFrame([(n, i) for i, n in enumerate(variants(11, 20))], "name string, place int")
    plan = looked_up(names.select("name"), names.where("place % 3 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[(key|run)", plan) and not re.search(r"Broadcast\w+Join \[(key|run)", plan)


def test_lookup_without_names(spark):
    from ledgerloom.operators.name_lookup import looked_up

    some, none = spark.createDataFrame([("abc", 1)], "name string, place int"), spark.createDataFrame([], "name string, place int")
    assert looked_up(some, none).collect() == [] and looked_up(none, some).collect() == [] and looked_up(none, none).collect() == []
