import zlib
from collections import Counter

from ledgerloom.llm import ring


def test_walk_by_single_keys():
    counts = {p: 1 + p % 5 for p in range(0, ring.PLACES, 97)}
    nodes = ring.virtual_nodes(7)
    total = sum(counts.values())
    free = [total // 7 + (s < total % 7) for s in range(7)]
    segments = ring.walk(counts, 7)
    used = Counter()
    by_place = {}
    for place, first, last, shard, slot, home in segments:
        assert slot == used[shard]
        used[shard] += last - first
        by_place.setdefault(place, []).append((first, last))
        owner = next((s for at, s in nodes if at >= place), nodes[0][1])
        assert home == owner
    assert [used[s] for s in range(7)] == free
    for place, parts in by_place.items():
        assert sorted(x for a, b in parts for x in range(a, b)) == list(range(counts[place]))
    # a key that is not at home found its home full
    full_at = [s for s in range(7) if used[s] == free[s]]
    assert {home for *_, shard, _, home in segments if shard != home} <= set(full_at)


def test_assign(spark):
    rows = [(i, f"t{i % 50} é", "x") for i in range(1000)] + [(3, None, "y"), (3, None, "y"), (None, "", "z"), (None, "q" * 9999, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = ring.assign(docs).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in ring.assign(docs.repartition(9)).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got}


def test_growth_moves_few(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    before = {r.doc_id: r.shard for r in ring.assign(docs, 24).collect()}
    after = {r.doc_id: r.shard for r in ring.assign(docs, 25).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.5 * len(before)


def test_empty_and_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ring.assign(docs).collect() == []
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.slot for r in ring.assign(docs).collect()) == [0, 0]


def test_each_key_goes_where_a_walk_of_single_keys_leads(spark):
    """All keys of a place offer themselves, step by step, to the next virtual node clockwise, and each finds its shard and slot on its own."""
    from pyspark.sql import functions as F

    rows = [(i * 37 % 5000, f"t{i}") for i in range(1500)] + [(7, None)] * 40 + [(None, "n")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shards, virtual in ((24, ring.VIRTUAL), (5, 3)):
        keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).collect()
        nodes = ring.virtual_nodes(shards, virtual)
        waiting = {}
        for r in keyed:
            raw = (r.text or "").encode()
            waiting.setdefault(r.h % ring.PLACES, []).append((r.h, r.doc_id or 0, len(raw) + 8, zlib.crc32(raw), r.doc_id))
        free = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
        room, want = list(free), Counter()
        first = {p: next((i for i, (at, _) in enumerate(nodes) if at >= p), 0) for p in waiting}
        for keys in waiting.values():
            keys.sort()
        for step in range(len(nodes)):
            for p in sorted(waiting):
                shard = nodes[(first[p] + step) % len(nodes)][1]
                while waiting[p] and room[shard]:
                    _, _, size, crc, doc = waiting[p].pop(0)
                    want[doc, size, crc, shard, free[shard] - room[shard]] += 1
                    room[shard] -= 1
        assert not any(waiting.values())
        got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in ring.assign(docs, shards, virtual=virtual).collect())
        assert got == want
