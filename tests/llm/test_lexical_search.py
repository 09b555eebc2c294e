import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plainly(docs, items, k=20):
    read = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    df = Counter(x for _, t in read for x in set(t))
    rows = []
    for i, text in items:
        wanted, scored = Counter(terms(text)), []
        for d, t in read:
            tf = Counter(t)
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * (75 + 25 * len(t) * n_docs // total)))
                for x, n in wanted.items() if tf[x]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        rows += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return rows


def tables(seed):
    rnd = random.Random(seed)
    common, rare = ["the", "The", "of", "and", "É", "x1"], [f"r{i}" for i in range(400)]
    word = lambda: rnd.choice(common) if rnd.random() < 0.6 else rare[int(400 * rnd.random() ** 3)]
    docs = [(i, rnd.choice([" ", "\n", "--"]).join(word() for _ in range(rnd.randint(0, 60)))) for i in range(900)]
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 25)))) for i in range(40)]
    docs += [(1000 + i, items[i % 7][1] + " " + word()) for i in range(60)]  # passages of items
    docs += [(2000 + i, "the same copy of r1 r2") for i in range(50)] + [(5, "the same copy of r1 r2")] * 3 + [(None, "r1 r2 r3"), (None, None), (7, None), (8, ""), (9, "r5 " * 20000)]
    return docs, items + [(None, "r1 the"), (3, "r2 r2 r2 the"), (90, None), (91, "nowhere"), (92, "the and of"), (93, "r1 " * 500 + "r9")]


def compared(rows):
    return sorted(tuple((x is not None, x) for x in r) for r in rows)


@pytest.mark.parametrize(("seed", "block", "pairs", "cells"), [(1, 4096, 1 << 19, 1 << 20), (2, 7, 300, 50), (3, 4096, 1, 1)])
def test_search(spark, seed, block, pairs, cells):
    docs, items = tables(seed)
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item long, score string").repartition(5)
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert compared(lexical_search.search(frame, asked, block=block, pairs=pairs, cells=cells).collect()) == compared(plainly(docs, items))


def test_sql_says_the_same(spark):
    docs, items = tables(4)
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    db = duckdb.connect()
    for name, df in (("documents", frame), ("benchmark", asked)):
        db.register(name, df.toArrow())
    assert compared(db.sql(lexical_search.SEARCH_SQL).fetchall()) == compared(plainly(docs, items))


def test_thresholds_bound_the_kth_score_and_leave_terms_out():
    df, greatest, kth = np.array([900, 30, 5]), np.array([800_000, 500_000, 500_000]), np.array([700_000, 400_000, 0])
    plan = lexical_search.Plan([Counter({0: 1, 1: 1, 2: 1}), Counter({0: 2}), Counter()], df, greatest, kth, 1000)
    w = [lexical_search.weight(1000, d) for d in df]
    assert plan.floor.tolist() == [w[1] * 400_000, 2 * w[0] * 700_000, 1]
    assert plan.rest.tolist() == [w[0] * 800_000, 0, 0]  # the common term of the first item brings no candidates
    assert plan.asked_count.tolist() == [1, 1, 1]


def test_empty(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    no_item, item = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((none, no_item), (none, item), (some, no_item)):
        assert lexical_search.search(docs, items).collect() == []
    assert [tuple(r) for r in lexical_search.search(some, item).collect()] == plainly([(1, "a b")], [(1, "a")])
