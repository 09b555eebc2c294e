import random
import zlib

import numpy as np

from ledgerloom.llm import language

WORDS = {"en": "the and of thing with that".split(), "fr": "le été que façon pour une".split(), "de": "der über und straße nicht".split()}


def rows(n=400):
    rnd = random.Random(1)
    out = []
    for i in range(n):
        lang = rnd.choice(list(WORDS))
        out.append((i, " ".join(rnd.choices(WORDS[lang], k=rnd.randint(3, 120))), lang if i % 9 else None, lang))
    return out


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language.Network.new(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    cells = rng.integers(97, 102, (6, 4))
    use = np.ones((6, 4), bool)
    use[4:, 1] = False
    target = np.array([0, 1, 2, 1])
    _, grad = net.gradients(cells, use, target)
    for name, value in net.p.items():
        spots = [np.unravel_index(np.abs(grad[name]).argmax(), value.shape), tuple(rng.integers(0, s) for s in value.shape)]
        for at in spots:
            old, h = value[at], 1e-3
            value[at] = old + h
            up = net.gradients(cells, use, target)[0]
            value[at] = old - h
            down = net.gradients(cells, use, target)[0]
            value[at] = old
            assert abs((up - down) / (2 * h) - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at]))


def test_held_out_accuracy_and_edges(spark):
    data = rows()
    edges = [(1000, None, "en", ""), (1001, "", None, ""), (1002, "123 !!", "fr", ""), (1003, "der und " * 20000, None, "de"), (None, "le été que", "fr", "fr"), (5, "the of", "en", "en"), (5, "the of", "en", "en")]
    docs = spark.createDataFrame([(d, t, g, 0.5) for d, t, g, _ in data + edges], "doc_id long, text string, lang string, score double").repartition(5)
    got = language.identify(docs).collect()
    assert len(got) == len(data) + len(edges)
    truth = {d: g for d, _, _, g in data}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    (r,) = language.identify(docs).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.identify(docs.limit(0)).collect() == []


def test_repeated_and_null_ids_don_t_empty_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.append((texts, langs)) or "fitted")
    many = spark.range(15000).selectExpr("4L AS doc_id", "concat('abc ', id) AS text", "if(id % 2 = 0, 'a', 'b') AS lang")
    for frame in (many, many.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang"), many.selectExpr("id AS doc_id", "text", "lang") if "id" in many.columns else many):
        assert language.train(frame, sample=300) == "fitted"
        texts, langs = seen.pop()
        assert len(texts) == len(set(texts)) == 300 and set(langs) == {"a", "b"}
    copies = spark.range(15000).selectExpr("4L AS doc_id", "if(id < 14000, 'same text', concat('abc ', id)) AS text", "'a' AS lang")
    assert language.train(copies, sample=900) == "fitted"
    assert len(seen.pop()[0]) == 900
    assert language.train(copies, sample=5000) == "fitted"
    assert len(seen.pop()[0]) == 1001
    assert language.train(copies.where("false")) is None
