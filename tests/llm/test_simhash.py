import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows, budget=2):
    root = {}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    prints = {d: plain_print(t) for d, t in rows}
    for d in prints:
        root[d] = d
    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(d, f"{prints[d]:016x}", find(d)) for d in prints}


def texts():
    rnd = random.Random(5)
    words = ["Ab", "the", "ÉTÉ", "of", "zum", "Query", "row", "key", "x1", "ñandú"]
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(60)]
    near = [b.replace("row", "key", 1) for b in base] + [b + " the" for b in base]
    return base + near + base[:9] + ["", None, " \n\t", "a", "A", "a b", "x" * 5000, "w " * 3000]


def test_against_brute_force(spark):
    rows = list(enumerate(texts(), 10))
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, id string").withColumn("fp", F.lit(1))
    got = {tuple(r) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("sent", [simhash.SENT, 0])
def test_large_nodes_are_split(spark, monkeypatch, sent):
    monkeypatch.setattr(simhash, "NODE_ROWS", 40)
    monkeypatch.setattr(simhash, "SENT", sent)
    rnd = random.Random(3)
    hub = rnd.getrandbits(64)
    prints = {hub} | {hub ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)}
    prints |= {rnd.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    classes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp long")
    found = {r.node: r.component for r in simhash.connected(simhash.near_edges(classes)).collect()}
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert {i: found.get(i, i) for i in range(len(prints))} == dict(enumerate(label))


def test_empty_table_and_nulls(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_pairs_come_in_portions(monkeypatch):
    rnd = random.Random(4)
    keys = np.array(sorted({rnd.getrandbits(9) << 30 for _ in range(300)}), np.uint64)
    bounds = np.array([0, len(keys) // 3, len(keys)])
    monkeypatch.setattr(simhash, "HELD_PAIRS", 50)
    got = [pair for left, right in simhash.trie_pairs(keys, bounds, 2) for pair in zip(left.tolist(), right.tolist())]
    wanted = {(i, j) for a, b in zip(bounds[:-1], bounds[1:]) for i in range(a, b) for j in range(i + 1, b) if bin(int(keys[i] ^ keys[j])).count("1") <= 2}
    assert len(got) == len(wanted) and {tuple(sorted(p)) for p in got} == wanted


def test_a_node_reached_by_several_routes_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 512)
    rnd = random.Random(11)
    high = rnd.getrandbits(46) << 18
    prints = np.array(sorted({high | rnd.getrandbits(18) for _ in range(3000)}), np.uint64)
    classes = spark.createDataFrame(list(enumerate(prints.view(np.int64).tolist())), "id long, fp long")
    found = {r.node: r.component for r in simhash.connected(simhash.near_edges(classes)).collect()}
    left, right = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    label = simhash.spanning(len(prints), left, right)
    assert len(prints) > 2000 and len(set(label.tolist())) > 1
    assert [found.get(i, i) for i in range(len(prints))] == label.tolist()


def test_null_ids_link_others(spark):
    base = [" ".join(f"w{i}" for i in range(400))]
    words = base[0].split()
    fp = lambda text: simhash.fingerprint(text.encode())
    near = lambda text, budget: next(t for k in range(400) if 0 < bin(fp(t := " ".join(text.split()[:k] + [f"new{k}"] + text.split()[k + 1 :])) ^ fp(text)).count("1") <= budget)
    middle = near(base[0], 2)
    last = next(t for k in range(400) if bin(fp(t := " ".join([*middle.split()[:k], "other", *middle.split()[k + 1 :]])) ^ fp(middle)).count("1") <= 2 < bin(fp(t) ^ fp(base[0])).count("1"))
    rows = [(1, base[0]), (None, middle), (2, last), (3, " ".join(reversed(words))), (None, "alone here and now")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, None), (None, 1), (1, 1), (2, 1), (3, 3)}


def jaccard(a, b, shingle=5):
    parts = lambda t: {tuple(w[i : i + shingle]) for w in [t.lower().split()] for i in range(max(1, len(w) - shingle + 1))}
    return len(parts(a) & parts(b)) / len(parts(a) | parts(b))


def test_similar_texts_are_found(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows, wanted, i = [], [], 0
    for k in range(60):
        base = [word() for _ in range(rnd.randrange(60, 400))]
        other = list(base)
        for at in rnd.sample(range(len(other)), max(1, len(other) * (k % 6) // 100)):
            other[at] = word()
        other = " ".join(other).upper()
        rows += [(i, " ".join(base)), (i + 1, other)]
        wanted.append((i, jaccard(" ".join(base).upper(), other)))
        i += 2
    rows += [(i, None), (i + 1, " "), (None, "one two"), (i + 2, "one two"), (i + 3, "one three"), (0, rows[0][1])]
    got = simhash.similar(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component long").repartition(4)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of[i + 1] == of[i] == i and of[i + 3] == i + 3 and [r.component_id for r in got if r.doc_id is None] == [i + 2]
    near = [of[a + 1] == a for a, j in wanted if j >= 0.85]
    assert len(near) > 20 and sum(near) >= 0.95 * len(near)
    assert not any(of[a + 1] == a for a, j in wanted if j < 0.55)
    assert all(of[a] == a for a, _ in wanted)
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []
