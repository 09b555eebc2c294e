import math
import random

import numpy as np
import pytest

from ledgerloom.llm import inner_product as ip


def ranked(rows, k=20, every=20):
    """The answers as a list, in which rows of one id stand as often as they are among the best."""
    dot = lambda a, b: sum(math.floor(64 * x) * math.floor(64 * y) for x, y in zip(a, b))
    for q in {i for i, _ in rows if i % every == 0}:
        best = sorted((-dot(x, y), i) for x in {tuple(v) for i, v in rows if i == q} for i, y in rows if i != q)[:k]
        yield from ((q, r, i, -s) for r, (s, i) in enumerate(best, 1))


def brute(rows, k=20, every=20):
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for q in {q for q, _ in fit if q % every == 0}:
        best = sorted((-dot(x, y), i) for x in {tuple(x) for p, x in fit if p == q} for i, y in fit if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def cases():
    rnd = random.Random(1)
    f32 = lambda: float(np.float32(rnd.gauss(0, 1)))
    rows = [(i, [f32() * (1 + i % 7) for _ in range(12)]) for i in range(400)]
    hot = [f32() for _ in range(12)]
    rows += [(1000 + i, hot) for i in range(300)]
    rows += [(2000, None), (2020, [1.0, None] + [0.0] * 10), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (None, hot), (2080, [0.0] * 12), (2100, [5.0, -5.0]), (2101, [])]
    rows += [(60, rows[61][1]), (63, rows[63][1]), (80, rows[80][1]), (80, rows[80][1])]  # a second vector of one id, and repeated rows
    return rows


@pytest.mark.parametrize(("asked", "parts", "block"), [(16384, 16, 1024), (8, 3, 16)])
def test_against_brute_force(spark, monkeypatch, asked, parts, block):
    monkeypatch.setattr(ip, "BLOCK", block)
    rows = cases()
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(6)
    got = [tuple(r) for r in ip.top_k(frame, asked=asked, parts=parts).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_few_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ip.top_k(frame).collect() == []
    frame = spark.createDataFrame([(20, [1.0]), (3, [-2.0]), (40, [0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in ip.top_k(frame).collect()} == brute([(20, [1.0]), (3, [-2.0]), (40, [0.5])])


@pytest.mark.parametrize("rows", [
    [(0, [1.0, 2.0])] * 25 + [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(0, [1.0])] * 3 + [(7, [1.0])] * 40 + [(8, [1.0]), (9, [0.5])], [(i // 2, [1.0, 1.0]) for i in range(90)] + [(20, [3.0, 1.0])],
])
def test_repeated_ids_among_equal_vectors(spark, rows):
    got = [tuple(r) for r in ip.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert sorted(got) == sorted((q, r, i, s) for q, r, i, s in ranked(rows))


@pytest.mark.parametrize("lengths", ["skewed", "equal"])
def test_blocks_are_pruned_without_loss(monkeypatch, lengths):
    monkeypatch.setattr(ip, "HELD", 1 << 13)
    rng = np.random.default_rng(0)
    x = rng.integers(-200, 200, (900, 32)) // rng.integers(1, 9, (900, 1)) if lengths == "skewed" else rng.integers(-2, 3, (900, 32))
    x = x[np.argsort(-(x * x).sum(axis=1), kind="stable")].astype(float)
    ids = rng.permutation(900)
    q, q_ids = x[::45], ids[::45]
    search = ip.Search(q_ids, q, np.linalg.svd(x.T @ x)[0], 5)
    for at in range(0, 900, 100):
        search.see(ids[at : at + 100], x[at : at + 100])
    places, found, scores = search.best
    for i, own in enumerate(q_ids):
        want = sorted((-int(s), j) for s, j in zip(x @ q[i], ids) if j != own)[:5]
        assert list(zip(-scores[places == i], found[places == i])) == want


def test_products_beyond_doubles():
    x = np.array([[3.0e8, 1.0], [3.0e8, 2.0], [3.0e8, 3.0]])
    search = ip.Search(np.array([9]), np.array([[3.0e8, 7.0]]), np.eye(2), 2)
    search.see(np.arange(3), x)
    assert search.best[2].tolist() == [9 * 10**16 + 21, 9 * 10**16 + 14]
