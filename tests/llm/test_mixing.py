import random
import re

from ledgerloom.llm import mixing


def test_fit_is_exact_on_small_cases():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = rnd.sample(range(1, 60), rnd.randint(1, 6))
        counts = [rnd.randint(1, 4) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts))
        budget = rnd.randint(0, total)
        taken = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        got = sum(n * t for n, t in zip(lengths, taken))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * j for s in sums for j in range(c + 1)}
        assert got == max(s for s in sums if s <= budget)


def test_fit_is_exact_where_few_long_documents_are_left(monkeypatch):
    rnd = random.Random(3)
    for small in (1 << 16, 64):
        monkeypatch.setattr(mixing, "EXACT", small)
        for _ in range(12):
            lengths, counts = rnd.sample(range(70_000, 90_000), 8), [rnd.randint(1, 3) for _ in range(8)]
            budget = rnd.randint(0, sum(n * c for n, c in zip(lengths, counts)))
            sums = {0}
            for n, c in zip(lengths, counts):
                sums = {s + n * j for s in sums for j in range(c + 1)}
            taken = mixing.fit(lengths, counts, budget)
            assert all(0 <= t <= c for t, c in zip(taken, counts))
            assert sum(n * t for n, t in zip(lengths, taken)) == max(s for s in sums if s <= budget)


def test_fit_of_large_budgets():
    lengths, counts = list(range(5, 3000, 7)), [10_000_000] * 428
    budget = 10**12 + 12345
    assert sum(n * t for n, t in zip(lengths, mixing.fit(lengths, counts, budget))) == budget


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["b", "a", "hot", "hot", "hot", None, "tiny"][: 6 if i > 4 else 7]), " ".join(["w"] * rnd.randint(0, 40)), i) for i in range(900)]
    rows += [(1000, "empty", "", 0), (1001, "empty", None, 0), (1002, None, "a\tb\nc", 0), (2000, "a", "w w", 1), (2000, "a", "w w", 1), (None, "b", "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size long")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    size = {}
    for d, s, t, _ in rows:
        size.setdefault(s, 0)
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(x for x in size if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    source = {d: s for d, s, _, _ in rows}
    got["source"] = [source[None if d != d else d] for d in got["doc_id"]]
    assert ((got["taken"] <= 3 * got["size"]) & (got["taken"] % got["size"].clip(lower=1) == 0)).all()
    for s in order:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert (part["source_size"] == size[s]).all()
        assert (abs(part["target"] - target[s]) < 1e-6).all()
        assert abs(part["taken"].sum() - target[s]) <= 1
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].fillna(-1).to_numpy())) == sorted(map(tuple, again[key].fillna(-1).to_numpy()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).collect() == []
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix(docs).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
