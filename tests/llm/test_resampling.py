import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plainly(docs, target):
    """doc_id, n_features, weight, score and rank of each row, each feature on its own."""
    read = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in read for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + 10000)) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for d, words, f in read:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    return rows


def texts():
    rnd = random.Random(3)
    words = ["the", "The", "of", "a1", "é", "É", "straße", "日本", "x" * 300, "don't", "B", "b", "0"] + [f"w{i}" for i in range(200)]
    out = [rnd.choice([" ", "\n", ", ", "\x00", "[", " "]).join(rnd.choices(words, k=rnd.randint(0, 70))) for _ in range(700)]
    return out + [None, "", "?!", "one", "one two", "q " * 30000] + ["copied text of more than twenty words " * 4] * 40


def compared(rows):
    return sorted((tuple((x is not None, x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("block", [1, 500, 1 << 21])
def test_resample(spark, block):
    docs = [(i, t) for i, t in enumerate(texts())] + [(None, "null " * 25), (3, "again " * 25), (3, "again " * 25)]
    target = ["the of a1 w3 w4 w5", "É b B", None, "", "w3 w4"]
    frame = spark.createDataFrame([(d, t, 1, "x", 0) for d, t in docs], "doc_id long, text string, bucket long, score string, place int").repartition(7)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    got = resampling.resample(frame, wanted, block=block).collect()
    assert compared(got) == compared(plainly(docs, target))


def test_runs_of_a_text_do_not_reach_into_the_next():
    runs = resampling.Runs([b"a b", b"", b"c d e", b"f"])
    assert [len(text) for text, _, _ in runs.of_length] == [6, 3, 1]
    assert runs.words.tolist() == [2, 0, 3, 1]
    buckets = sorted(b for _, which, bucket in runs.of_length for b in bucket[which].tolist())
    assert buckets == sorted(zlib.crc32(x) % 10000 for x in (b"a", b"b", b"c", b"d", b"e", b"f", b"a b", b"c d", b"d e", b"c d e"))


def test_sql_says_the_same(spark):
    docs = [(i, t) for i, t in enumerate(texts()[:60] + texts()[-20:])]
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "the w3 w4 É")], "item_id long, text string")
    db = duckdb.connect()
    for name, df in (("documents", frame), ("benchmark", wanted)):
        db.register(name, df.toArrow())
    assert compared(resampling.resample(frame, wanted).collect()) == compared(db.sql(resampling.RESAMPLE_SQL).fetchall())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    assert resampling.resample(none, some).collect() == []
    assert compared(resampling.resample(some, none).collect()) == compared(plainly([(1, "a " * 30), (2, None)], []))
