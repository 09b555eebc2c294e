import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm import bpe

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXTS = ["", None, " ", "Hello  world\n\n x", "don't stop", "été ñandú über", "a" * 3000, "日本語 テスト🙂", "x1y2 " * 400, "<|endoftext|>", "\x00\xa0  z"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(encoder):
    keys = encoder.tokens
    assert sorted(encoder.whole.place) == list(range(len(keys)))
    assert all(encoder.whole.index(k) == i for i, k in enumerate(keys))


def test_ids_as_tiktoken(encoder, reference):
    rnd = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choices("abcdefghijklmnop .é'1\n", k=rnd.randint(1, 300))) for _ in range(300)]
    texts += ["".join(rnd.choices("ab", k=5000)), "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(3000))]
    for text in texts:
        assert encoder.encode(text) == reference.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_query(spark, reference):
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS + TEXTS[3:4])] + [(None, "a", "n")], "doc_id long, text string, n_tokens string")
    rows = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    texts = dict(enumerate(TEXTS + TEXTS[3:4])) | {None: "a"}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert ids[3] == reference.encode_ordinary(TEXTS[3])
