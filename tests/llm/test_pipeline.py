import base64
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerloom.llm import language, mixing, personal, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def rows():
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "und", "straße", "of", "casa"]) + str(rnd.randrange(300))
    out = []
    for i in range(90):
        text = " ".join(word() for _ in range(rnd.randrange(1, 120)))
        out.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["web", "web", "book", None]), len(text)))
    for i in range(20):
        words = out[i][1].split()
        words[len(words) // 2] = "changed"
        out.append((200 + i, " ".join(words), "en", "web", None))
    out += [(300 + i, "copied text of one place " * 9, "en", "web", 1) for i in range(30)]
    out += [(400, "copied text of one place " * 9, "en", "book", 1)] * 25
    out += [(500, None, "en", "web", None), (501, "", None, None, 0), (502, "12 34 !", "de", "web", 7), (None, "no id here at all", "en", "web", 5), (None, "no id here at all", "en", "web", 5)]
    out += [(503, "write to ann.lee@mail.org or +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.7 now", "en", "web", 9), (504, "long " * 20000 + "end", "en", "web", 9)]
    return out


@pytest.fixture
def docs(spark, tmp_path):
    frame = spark.createDataFrame([(*r, 1.5, "x", True) for r in rows()], SCHEMA + ", found_lang double, row string, times boolean")
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def plain(docs):
    return [tuple(r) for r in docs.collect()]


def same(a, b):
    assert Counter(map(repr, a)) == Counter(map(repr, b))


def test_languages(spark, docs, monkeypatch):
    network = language.Network.new(["de", "en"], seed=3)
    network.p["out"] *= 4
    monkeypatch.setattr(cp.language, "train", lambda docs: network)
    monkeypatch.setattr(cp, "LEAST_SCORE", 0.55)
    want = []
    for r in plain(docs):
        if r[1] and any(c.isalpha() for c in r[1]):
            [k], [p] = language.predict(network, [r[1].encode()])
            if p >= 0.55:
                want.append((*r[:2], r[2] or network.langs[k], *r[3:]))
    got = cp.keep_languages(spark, docs, "")
    assert got.columns == docs.columns and 0 < len(want) < docs.count()
    same(plain(got), want)
    monkeypatch.setattr(cp.language, "train", lambda docs: None)
    assert cp.keep_languages(spark, docs, "").count() == 0


def test_near_duplicates(spark, docs):
    found = plain(docs)
    sketch = simhash.sketches([(r[1] or "").encode() for r in found], 5)
    bits = np.unpackbits(sketch.view(np.uint8), axis=1)
    bands, checks = bits[:, :-128].reshape(len(found), simhash.BANDS, -1), bits[:, -128:]
    group = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if ((bands[i] != bands[j]).sum(axis=1) <= simhash.BAND_BUDGET).any() and (checks[i] != checks[j]).sum() <= simhash.CHECK_BUDGET:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    groups = {}
    for g, r in zip(group, found):
        groups.setdefault(g, []).append(repr(r))
    got = list(map(repr, plain(cp.drop_near_duplicates(spark, docs, ""))))
    assert len(got) == len(groups) < len(found) - 50
    for members in groups.values():
        assert sum(g in members for g in set(got)) == 1
    assert cp.drop_near_duplicates(spark, docs, "").columns == docs.columns


def test_personal_data(spark, docs):
    weights = personal.learn(docs)
    spans = {r.doc_id: r.spans for r in personal.detect(docs.where("doc_id is not null"), weights=weights).collect()}
    want = []
    for r in plain(docs):
        text, out, at = r[1], "", 0
        for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in (spans.get(r[0]) or "").split(",") if x)):
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, end)
        text = None if text is None else out + text[at:]
        want.append((r[0], text, r[2], r[3], r[4] if text is None else len(text), *r[5:]))
    got = plain(cp.redact_personal_data(spark, docs, ""))
    same(got, want)
    assert "<email>" in next(r[1] for r in got if r[0] == 503)


def test_mixture(spark, docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        if r.size:
            assert r.taken % r.size == 0 and r.taken <= 3 * r.size
            taken[r.doc_id, r.size] += r.taken // r.size
    got = plain(cp.mix_sources(spark, docs, ""))
    assert Counter((r[0], len(r[1].split())) for r in got) == +taken
    assert set(map(repr, got)) <= set(map(repr, plain(docs)))
    equal = spark.createDataFrame([(4, "one two three", "en", "a", 13)] * 30 + [(5, "one " * 700, "en", "b", 13)], SCHEMA)
    assert sum(r.taken for r in mixing.mix(equal).where("doc_id = 4").collect()) == 3 * cp.mix_sources(spark, equal, "").where("doc_id = 4").count()


def test_encoding(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(cp.TOKENIZER), "rb"))}
    plainly = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r.doc_id, r.n_tokens, r.ids) for r in cp.encode(spark, docs, "").collect()]
    same(got, [(r[0], len(ids), ids) for r in plain(docs) for ids in [plainly.encode_ordinary(r[1] or "")]])


@pytest.mark.parametrize("empty", [False, True])
def test_run(spark, tmp_path, monkeypatch, empty):
    monkeypatch.setattr(language, "STEPS", 20)
    docs = spark.createDataFrame(rows()[: 0 if empty else None], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path))
    if empty:
        assert got.count() == 0
        return
    assert 0 < got.count() and set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    ids = {r[0] for r in rows()}
    assert {r.doc_id for r in got.select("doc_id").collect()} <= ids - {500, 501, 502}
    assert got.where(F.size("ids") != F.col("n_tokens")).count() == 0
