import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import suffix_tree as st


def plain_tokens(text):
    low = (text or "").encode().lower()
    for c in b"\t\n\x0b\x0c\r":
        low = low.replace(bytes([c]), b" ")
    return [w for w in low.split(b" ") if w] + ["END"]


def held(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 7 == 2


def plain(rows, depth=2, prior=st.PRIOR, hot=math.inf):
    """The same model over dictionaries: all strings are counted, then the tree is grown level by level."""
    texts = [(i, held(i), ["END", *plain_tokens(t)]) for i, t in rows]
    counts = Counter(w for _, out, ws in texts if not out for w in ws[1:])
    total, distinct = sum(counts.values()), len(counts)
    root = lambda w: (counts[w] + 1) / (total + distinct + 1)
    after = defaultdict(Counter)
    for _, out, ws in texts:
        if not out:
            for t in range(1, len(ws)):
                for d in range(1, depth + 1):
                    if t - d >= 0:
                        after[tuple(ws[t - d : t])][ws[t]] += 1
    tree = {(): None}

    def estimate(context, w):
        while context not in tree:
            context = context[1:]
        if not context:
            return root(w)
        return (after[context][w] + prior * estimate(context[1:], w)) / (sum(after[context].values()) + prior)

    for d in range(1, depth + 1):
        fresh = {}
        for context, follow in after.items():
            n = sum(follow.values())
            if len(context) != d or n < st.LEAST or context[1:] not in tree:
                continue
            gain = 0.0
            for w, c in follow.items():
                base = 2.0 ** (-min(255, round(-math.log2(estimate(context[1:], w)) * st.STEPS)) / st.STEPS)
                gain += c * math.log((c + prior * base) / (n + prior) / base)
            if gain >= st.DIVERGENCE * n and gain >= st.EVIDENCE or n > hot:
                fresh[context] = None
        tree |= fresh
    out = []
    for i, is_out, ws in texts:
        score = base = 0.0
        deep = 0
        for t in range(1, len(ws)):
            context = next((c for d in range(depth, 0, -1) if t - d >= 0 and (c := tuple(ws[t - d : t])) in tree), ())
            score += math.log10(estimate(context, ws[t]))
            base += math.log10(root(ws[t]))
            deep += bool(context)
        out.append((i, is_out, len(ws) - 1, sum(counts[w] > 0 for w in ws[1:]), total, base, score, deep))
    return out, len(tree) - 1


def corpus():
    rnd = random.Random(4)
    names = ["the", "cat", "Sat", "on", "mat", "émile", "x" * 5000, "a-b", "ÀB"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        at, text = rnd.randrange(len(names)), []
        for _ in range(rnd.randrange(40)):
            at = (at * 7 + rnd.choice((1, 1, 1, 2, 30))) % len(names)
            text.append(names[at] + rnd.choice((" ", "\n", " \t ", "\x0b")))
        rows.append((i, "".join(text)))
    rare = " ".join(f"unique{i}" for i in range(80))
    rows += [(1000, rare), (1001, rare), (1002, rare + " once more"), (1003, " ".join(f"single{i}" for i in range(80)))]
    return rows + [(5, None), (None, ""), (None, "the cat sat"), (7, "the cat sat"), (7, "the cat sat"), (8, "  \n "), (9, "word " * 3000)]


@pytest.mark.parametrize(("depth", "group_bytes", "bucket_bytes"), [(2, 8 << 20, 16 << 20), (3, 2000, 4000), (1, 2000, 1 << 20)])
def test_against_plain_tree(spark, monkeypatch, depth, group_bytes, bucket_bytes):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, words string").repartition(5)
    got = st.score(frame, depth=depth, group_bytes=group_bytes, bucket_bytes=bucket_bytes).collect()
    want, contexts = plain(rows, depth)
    assert contexts > 20
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 4) for x in r[5:7]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    for g, w in zip(got, want):
        assert g[5:7] == pytest.approx(w[5:7], rel=1e-9, abs=1e-9)


def test_texts_that_repeat_stand_apart(spark):
    rows = corpus()
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in st.score(spark.createDataFrame(rows, "doc_id long, text string"), prior=4.0).collect() if r.doc_id in (1000, 1001, 1003)}
    assert min(got[1000], got[1001]) > got[1003] + 0.3


def test_followers_of_a_hot_context_are_dealt(monkeypatch):
    monkeypatch.setattr(st, "HOT", 100)
    rnd = random.Random(2)
    ids = [i for i in range(120) if not held(i)]
    texts = [" ".join(f"the n{rnd.randrange(30)}" for _ in range(30)) for _ in ids]
    want, _ = plain(list(zip(ids, texts)), hot=100)
    for buckets in (1, 3, 7):
        assert local_scores([t.encode() for t in texts], buckets) == pytest.approx([w[6] for w in want], abs=1e-6)


def local_scores(texts, buckets):
    """The rounds of questions and answers of one group without Spark."""
    import pyarrow as pa

    hashes, sizes = st._token_hashes(texts)
    words, tokens = np.unique(hashes, return_inverse=True)
    raw = len(tokens).to_bytes(8, "little") + pa.compress(st.packed(tokens.astype(np.uint32)), "zstd", asbytes=True)
    train = np.bincount(tokens, minlength=len(words)).astype(np.uint32)
    state = pa.table({
        "group": [0], "ids": pa.array([list(range(len(texts)))], pa.list_(pa.int64())), "held": pa.array([[False] * len(texts)], pa.list_(pa.bool_())), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())),
        "tokens": pa.array([raw], pa.binary()), "words": pa.array([st.packed(np.diff(words, prepend=np.uint64(0)))], pa.binary()),
    })
    room = float(len(tokens) + len(words) + 1)
    asked = st._requests(0, st.home(words, buckets), words, train, np.zeros(len(words), np.uint8))
    answers = []
    for level in range(3):
        for bucket in set(asked.column("bucket").to_pylist()):
            rows = asked.filter(pa.compute.equal(asked.column("bucket"), bucket))
            answers.append(st._count(level, st.PRIOR)(rows))
        group = st.Group(state, pa.concat_tables(answers), room, st.PRIOR)
        asked = group.walk(2, buckets)
        if asked is None:
            break
    return group.scored().column("score").to_pylist()


def test_contexts_of_one_bucket_keep_apart(monkeypatch):
    """Equal upper halves of all contexts' hashes, as many contexts have in a large corpus, change nothing."""
    rows = [(i, t) for i, t in corpus() if i is not None and t and not held(i)]
    monkeypatch.setattr(st, "home", lambda hashed, buckets: np.full(len(hashed), buckets - 1, np.uint64))
    want, _ = plain(rows)
    assert local_scores([t.encode() for _, t in rows], 5) == pytest.approx([w[6] for w in want], abs=1e-6)


def test_numbers_of_any_size_come_back():
    for n in (0, 1, 31, 33, 5000):
        for kind in (np.uint8, np.uint32, np.uint64):
            a = np.arange(n, dtype=kind)
            assert st.expanded(st.squeezed(a), kind).tolist() == a.tolist()


def test_empty_table(spark):
    assert st.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_and_their_hashes():
    assert st.words_of(b"")[1].tolist() == st.words_of(b" \t\n")[1].tolist() == []
    starts, hashes = st.words_of(b"Ab  cd\x0bAB x" + "é".encode())
    assert starts.tolist() == [0, 4, 7, 10] and hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 12))) for _ in range(20000)]
    found = st.words_of(b" ".join(words))[1].tolist()
    assert len(set(found)) == len(set(words)) and len({*zip(words, found)}) == len(set(words))
    text = b" ".join(words) + b" " + b"y" * 300_000
    parts = st.words_of(text)
    st_piece, st.PIECE = st.PIECE, 1000
    try:
        again = st.words_of(text)
    finally:
        st.PIECE = st_piece
    assert all((a == b).all() for a, b in zip(parts, again))


def plain_whole(rows, depth):
    """The tree of every context that is seen often enough and diverges from its suffix, with all suffixes of those; scores of rows."""
    texts = [(i, held(i), ["END", *plain_tokens(t)]) for i, t in rows]
    counts = Counter(w for _, out, ws in texts if not out for w in ws[1:])
    room = sum(counts.values()) + len(counts) + 1
    after = defaultdict(Counter)
    for _, out, ws in texts:
        for t in range(1, len(ws) if not out else 0):
            for d in range(1, min(depth, t) + 1):
                after[tuple(ws[t - d : t])][ws[t]] += 1
    total = {c: sum(f.values()) for c, f in after.items()}

    def estimate(context, w):
        return (after[context][w] + st.PRIOR * estimate(context[1:], w)) / (total[context] + st.PRIOR) if context else (counts[w] + 1) / room

    tree, alone = set(), 0
    for context, follow in after.items():
        if total[context] >= st.LEAST:
            gain = 0.0
            for w, c in follow.items():
                base = 2.0 ** (-min(255, round(-math.log2(estimate(context[1:], w)) * st.STEPS)) / st.STEPS)
                gain += c * math.log((c + st.PRIOR * base) / (total[context] + st.PRIOR) / base)
            if gain >= max(st.DIVERGENCE * total[context], st.EVIDENCE):
                tree |= {context[k:] for k in range(len(context))}
    out = []
    for i, _, ws in texts:
        found = [next((c for d in range(min(depth, t), 0, -1) if (c := tuple(ws[t - d : t])) in tree), ()) for t in range(1, len(ws))]
        out.append((i, sum(math.log10(estimate(c, w)) for c, w in zip(found, ws[1:])), sum(map(bool, found))))
    return out, tree


def xor_corpus():
    """Each word is mostly decided by the two before it together, and by neither of them alone."""
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        bits = [rnd.randrange(2), rnd.randrange(2)]
        for _ in range(400):
            bits.append(bits[-1] ^ bits[-2] ^ (rnd.random() < 0.1))
        rows.append((i, " ".join("pq"[b] for b in bits)))
    return rows


@pytest.mark.parametrize(("made", "depth", "hot"), [(corpus, 2, 1 << 20), (corpus, 3, 1 << 20), (corpus, 3, 60), (xor_corpus, 1, 100), (xor_corpus, 2, 1 << 20), (xor_corpus, 2, 100)])
def test_every_context_is_tried(spark, monkeypatch, made, depth, hot):
    """Whether a context's suffix diverges decides nothing, nor does it how often it was seen."""
    rows = [r for r in {i: (i, t) for i, t in made()}.values() if r[0] is not None]
    want, tree = plain_whole(rows, depth)
    if made is xor_corpus:
        assert tree == (set() if depth == 1 else {c for n in (1, 2) for c in itertools.product((b"p", b"q"), repeat=n)})
    if hot == 1 << 20:
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.score, r.n_context) for r in st.score(frame, depth=depth, group_bytes=4000, bucket_bytes=8000, gated=False).collect()}
    else:
        monkeypatch.setattr(st, "HOT", hot)
        got = whole_local([(i, held(i), t) for i, t in rows], depth, 7)
    for i, score, deep in want:
        assert got[i] == (pytest.approx(score, abs=1e-6), deep)


def whole_local(rows, depth, buckets):
    """The rounds of three groups without Spark."""
    import pyarrow as pa

    batch = lambda part: pa.RecordBatch.from_pylist([{"id": i, "held_out": out, "text": t} for i, out, t in part], pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())]))
    states = []
    for k in range(3):
        (table,) = list(packed_states(batch(rows[k::3])))
        states.append(table.set_column(0, "group", pa.array([k], pa.int64())))
    asked = pa.concat_tables([pa.Table.from_batches(st._ask_words(buckets)(iter(s.to_batches()))) for s in states])
    words, n, *_ = st._summed(asked)
    room, answers = float(n.sum() + (n > 0).sum() + 1), []
    for level in range(depth + 2):
        for bucket in sorted(set(asked.column("bucket").to_pylist())):
            answers.append(st._count(level, st.PRIOR, level <= depth)(asked.filter(pa.compute.equal(asked.column("bucket"), bucket))))
        got = pa.concat_tables(answers)
        groups = [st.Group(s, got.filter(pa.compute.equal(got.column("group"), k)), room, st.PRIOR, False) for k, s in enumerate(states)]
        found = [f for g in groups if (f := g.walk(depth, buckets, level + 1)) is not None]
        asked = pa.concat_tables(found) if found else asked.slice(0, 0)
    return {r["doc_id"]: (r["score"], r["n_context"]) for g in groups for r in g.scored().to_pylist()}


def packed_states(batch):
    from unittest import mock

    import pyarrow as pa

    with mock.patch.object(st.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 0)):
        yield from (pa.Table.from_batches([b]) for b in st._pack_groups(1 << 30)(iter([batch])))
