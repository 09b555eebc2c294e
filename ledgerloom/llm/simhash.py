"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join over a binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, text_bytes
from ledgerloom.llm.components import connected
from ledgerloom.llm.suffix_tree import mixed, words_of

BITS = 64
SEED = 42
#: Fingerprints that may meet in one task; larger trie nodes are split further, which brings each of their rows budget + 1 times.
NODE_ROWS = 1 << 13
#: Rows of whole nodes that a task joins at once, and pairs of nodes or of rows that it holds at once.
TASK_ROWS, HELD_PAIRS = 1 << 15, 1 << 17
#: Parts over which the rows of a large node are dealt while they are marked.
SALTS = 64
#: Large nodes, or classes of several texts, that are sent to every task, about 5 MB at most; more of them are joined by a shuffle.
SENT = 1 << 16
ALL = (1 << BITS) - 1
#: A sketch has so many bands of so many bits, and twice 64 bits to check. Texts of shingles with a Jaccard similarity of 0.8 differ in 15 % of the bits, so that 92 % of them, and 99 %
#: at 0.85, have a band that differs in BAND_BUDGET bits or fewer.
BANDS, BAND_BITS, BAND_BUDGET = 20, 32, 2
#: Bits of the two checks in which similar sketches may differ.
CHECK_BUDGET = 22
#: The same for sketches that share a band with the first one of its class. Unrelated texts pass with a chance of 1 in 70,000; copies that resemble the first less than each other pass.
CLASS_BUDGET = 40


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the text: bit b is 1 if it is set in over half of the shingles' XXH64; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        last = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
    counts = np.zeros(BITS, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 1 << 15):
        part = values[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in text_bytes(batch, "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, fp long")


#: Columns of a class that has bits to check.
CHECKS = ("check_a", "check_b")
_SEEDS = mixed(np.arange(1, BANDS * BAND_BITS // BITS + 3, dtype=np.uint64))


def sketches(texts: list[bytes], shingle: int) -> np.ndarray:
    """A row of SimHash fingerprints of each text, over its distinct shingles of words, A-Z lowered; the first ones make the bands, the last two the checks. No words give 0."""
    out = np.zeros((len(texts), len(_SEEDS)), np.uint64)
    starts, hashes = words_of(b"\n".join(texts))
    upto = [0, *np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()]
    for i, (a, b) in enumerate(zip(upto[:-1], upto[1:], strict=True)):
        if a == b:
            continue
        n = max(1, b - a - shingle + 1)
        found = np.zeros(n, np.uint64)
        for k in range(min(shingle, b - a)):
            found = mixed(found * np.uint64(3) + hashes[a + k : a + k + n])
        found = np.unique(found)
        counts = np.zeros(len(_SEEDS) * BITS, np.int64)
        for at in range(0, len(found), 255):
            rows = mixed(found[at : at + 255, None] ^ _SEEDS)
            counts += np.add.reduce(np.unpackbits(rows.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
        out[i] = np.packbits(counts * 2 > len(found)).view(np.uint64)
    return out


def split_bits(mask: int, budget: int) -> list[int]:
    """The mask with each of budget + 1 parts of its clear bits added.

    Two fingerprints that agree on mask and differ in no more than budget bits agree on one of the results.
    """
    clear = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(clear, budget + 1)] if clear else [mask]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def trie_pairs(keys: np.ndarray, bounds: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys within budget bits of each other, inside each of the groups [bounds[i], bounds[i + 1]), in portions.

    keys are distinct in a group and sorted; a trie node is then a range of them. All groups' pairs of nodes are traversed together, a
    bit at a time from the highest: a pair of nodes becomes up to four pairs of children, the unlike ones with one more differing
    bit, and a pair over the budget is pruned with everything below it. Beyond HELD_PAIRS one half waits until the other is through.
    """
    zeros: dict[int, np.ndarray] = {}
    lo, hi = bounds[:-1], bounds[1:]
    big = hi - lo > 1
    waiting = [(BITS, lo[big], hi[big], lo[big], hi[big], np.zeros(int(big.sum()), np.int8))]
    while waiting:
        bit, a_lo, a_hi, b_lo, b_hi, err = waiting.pop()
        if len(a_lo) > HELD_PAIRS:
            half = len(a_lo) // 2
            waiting += [(bit, *(x[half:] for x in (a_lo, a_hi, b_lo, b_hi, err))), (bit, *(x[:half] for x in (a_lo, a_hi, b_lo, b_hi, err)))]
            continue
        bit -= 1
        if bit < 0 or not len(a_lo):
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit) & np.uint64(1)) == 0)))
        a_mid, b_mid = (low + zeros[bit][high] - zeros[bit][low] for low, high in ((a_lo, a_hi), (b_lo, b_hi)))
        own = a_lo == b_lo  # a node with itself: its two children meet once
        kinds = (
            (a_lo, a_mid, b_lo, b_mid, err, None),
            (a_mid, a_hi, b_mid, b_hi, err, None),
            (a_lo, a_mid, b_mid, b_hi, err + 1, None),
            (a_mid, a_hi, b_lo, b_mid, err + 1, ~own),
        )
        kept = []
        for al, ah, bl, bh, e, only in kinds:
            use = (ah > al) & (bh > bl) & (e <= budget) & ~((al == bl) & (ah - al == 1))
            if only is not None:
                use &= only
            kept.append(tuple(x[use] for x in (al, ah, bl, bh, e)))
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*kept, strict=True))
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if single.any():
            i, j = a_lo[single], b_lo[single]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            yield i[near], j[near]
            a_lo, a_hi, b_lo, b_hi, err = (x[~single] for x in (a_lo, a_hi, b_lo, b_hi, err))
        waiting.append((bit, a_lo, a_hi, b_lo, b_hi, err))


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n items, the smallest item that its links reach."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def _relabelled(label: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest items reached once these links join those behind the label."""
    left, right = zip((np.arange(len(label)), label), *held, strict=True)
    return spanning(len(label), np.concatenate(left), np.concatenate(right))


def _join_nodes(budget: int, check: int | None):
    """Links inside each trie node of a partition sorted by (mask, prefix): one edge for each item that is not its group's smallest. Linked are pairs within the budget, and within `check` bits of their checks."""

    def links(part: pa.Table) -> pa.RecordBatch:
        mask, fp, node = (part.column(c).to_numpy() for c in ("mask", "fp", "id"))
        prefix = fp & mask
        checks = [part.column(c).to_numpy().view(np.uint64) for c in CHECKS] if check is not None else []
        keys = fp.view(np.uint64)
        order = np.lexsort((keys, prefix, mask))
        mask, prefix, keys, node = mask[order], prefix[order], keys[order], node[order]
        once = np.concatenate(([True], (mask[1:] != mask[:-1]) | (prefix[1:] != prefix[:-1]) | (keys[1:] != keys[:-1])))  # rounds may enter one node
        mask, prefix, keys, node = mask[once], prefix[once], keys[once], node[once]
        checks = [c[order][once] for c in checks]
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (prefix[1:] != prefix[:-1])) + 1
        label, held, pairs = np.arange(len(keys)), [], 0
        for left, right in trie_pairs(keys, np.concatenate(([0], new, [len(keys)])), budget):
            if check is not None:
                near = sum(np.bitwise_count(c[left] ^ c[right]).astype(int) for c in checks) <= check
                left, right = left[near], right[near]
            held.append((left, right))
            pairs += len(left)
            if pairs > HELD_PAIRS:
                label, held, pairs = _relabelled(label, held), [], 0
        label = _relabelled(label, held)
        moved = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < TASK_ROWS:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            mask = part.column("mask").to_numpy()
            prefix = part.column("fp").to_numpy() & mask
            cut = int(np.argmax((mask == mask[-1]) & (prefix == prefix[-1])))  # the last node may go on in the next batch
            if cut:
                yield links(part.slice(0, cut))
                held = part.slice(cut).to_batches()
                rows = part.num_rows - cut
        if rows:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def near_edges(classes: DataFrame, budget: int = 2, shared: int = 0, check: int | None = None) -> DataFrame:
    """Edges (u, v) that join the ids of all distinct fingerprints within budget bits, directly or through others.

    classes has one row (id, fp) for each distinct fingerprint. A trie is entered once for each of budget + 1 parts of the bits,
    through the nodes that agree on this part, since no pair within the budget differs in all parts. Nodes of over NODE_ROWS
    fingerprints are entered again, by each part of their remaining bits, until no node is larger; every node is then joined
    in one task. All pairs have to agree on the bits of `shared`. With `check`, classes also have CHECKS, and a pair that differs in more of their bits is none. Where several routes lead to one node, each of them brings all its fingerprints, and the repeats go. At most one edge for each fingerprint and node comes out.
    """
    prefix = F.col("fp").bitwiseAND(F.col("mask")).alias("prefix")
    nodes = _entered(classes, {None: split_bits(shared, budget)})
    parts = []
    while True:
        large = nodes.groupBy("mask", prefix).count().where(F.col("count") > NODE_ROWS).select("mask", "prefix")
        large = durable(large)
        masks = [r.mask for r in large.select("mask").distinct().collect()]  # sets of bits, not of rows
        if not masks:
            parts.append(nodes)
            break
        if large.count() <= SENT:
            marked = nodes.withColumn("prefix", prefix).join(F.broadcast(large.withColumn("large", F.lit(True))), ["mask", "prefix"], "left").drop("prefix")
        else:
            deal = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
            salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("large", F.lit(True))
            marked = durable(nodes.withColumn("prefix", prefix).withColumn("salt", deal).join(salted, ["mask", "prefix", "salt"], "left").drop("salt", "prefix"))
        parts.append(marked.where("large is null").drop("large"))
        nodes = durable(_entered(marked.where("large"), {m: split_bits(m & ALL, budget) for m in masks}).distinct())
    small = parts[0]
    for part in parts[1:]:
        small = small.unionByName(part)
    dealt = small.repartition("mask", prefix).sortWithinPartitions("mask", prefix)
    return dealt.mapInArrow(_join_nodes(budget, check), "u long, v long")


def _entered(rows: DataFrame, below: dict[int | None, list[int]]) -> DataFrame:
    """Rows (id, fp) with each mask that follows their own."""
    if None in below:
        masks = F.array(*(F.lit(_signed(m)) for m in below[None]))
    else:
        pairs = [x for m, ms in below.items() for x in (F.lit(m), F.array(*(F.lit(_signed(b)) for b in ms)))]
        masks = F.element_at(F.create_map(*pairs), F.col("mask"))
    return rows.select("id", "fp", *(c for c in CHECKS if c in rows.columns), F.explode(masks).alias("mask"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): each document's fingerprint in hex and the smallest id that links reach.

    Documents link if their fingerprints differ in budget bits or fewer; the fingerprints are the nodes of the graph, so copies
    are never paired. A null or blank text has the fingerprint zero and links like any other. A row with a null id links others like any other,
    but counts in no minimum; the component of a group of null ids alone is null. Repeated ids give one row each; an empty table gives none. Other columns are ignored.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("id")))
    found = connected(near_edges(classes.select(F.col("fp").alias("id"), "fp"), budget))
    least = classes.join(found, classes.fp == found.node).groupBy("component").agg(F.min("id").alias("least"))
    named = classes.join(found.join(least, "component"), classes.fp == F.col("node"), "left").select("fp", F.coalesce("least", "id").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, check: int = CHECK_BUDGET) -> DataFrame:
    """(doc_id, component_id): each document and the smallest id that links reach, where texts link whose sets of word shingles have an estimated Jaccard similarity of 0.8 or more.

    A text has one long SimHash sketch. Its bands are joined over a trie, each with those of the same number; of the pairs that differ in BAND_BUDGET bits at most, those link that differ in `check` of 128 other bits at
    most. Sketches with an equal band are linked to the first of them if they differ in CLASS_BUDGET of those bits at most. The estimate blurs the bound: of pairs at 0.8, 0.75, 0.7 and 0.6 about 80, 50, 30 and 5 % pass the check. Equal sketches are one node, and equal bands one class, which meets others by its first sketch. Nulls, blanks, repeats and other
    columns are as in near_duplicates; texts of fewer words than a shingle link if they have the same words.
    """
    per_fp = BANDS * BAND_BITS // BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done, size = [], 0, 0
            for i, text in enumerate(text_bytes(batch, "text")):
                texts.append(text)
                size += len(text)
                if size >= 1 << 20 or i + 1 == batch.num_rows:
                    found = sketches(texts, shingle)
                    rows = pa.array([r.tobytes() for r in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(texts)), rows], names=["id", "sketch"])
                    done, texts, size = i + 1, [], 0

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            bits = np.unpackbits(np.ascontiguousarray(sketch[:, :per_fp]).view(np.uint8), axis=1).reshape(-1, BANDS, BAND_BITS)
            band = np.zeros((batch.num_rows, BANDS, 8), np.uint8)
            band[:, :, : BAND_BITS // 8] = np.packbits(bits, axis=2)
            fp = band.view(np.uint64)[:, :, 0] | np.arange(BANDS, dtype=np.uint64) << np.uint64(BAND_BITS)
            columns = np.repeat(batch.column("node").to_numpy(), BANDS), fp.ravel().view(np.int64), *(np.repeat(sketch[:, k].view(np.int64), BANDS) for k in (per_fp, per_fp + 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "fp", *CHECKS])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = durable(narrow.mapInArrow(run, "id long, sketch binary"))
    nodes = durable(prints.groupBy("sketch").agg(F.min("id").alias("least")).withColumn("node", F.xxhash64("sketch")))
    bands = nodes.mapInArrow(banded, "id long, fp long, check_a long, check_b long")
    first = bands.groupBy("fp").agg(F.min(F.struct("id", *CHECKS)).alias("first"), F.count("*").alias("members"))
    first = durable(first.select("fp", "first.*", "members"))
    several = first.where("members > 1").select("fp", F.col("id").alias("v"), *(F.col(c).alias(f"first_{c}") for c in CHECKS))
    if several.count() <= SENT:
        several = F.broadcast(several)
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"first_{c}"))) for c in CHECKS), F.lit(0))
    equal = bands.withColumnRenamed("id", "u").join(several, "fp").where((F.col("u") != F.col("v")) & (apart <= CLASS_BUDGET)).select("u", "v")
    links = near_edges(first.drop("members"), BAND_BUDGET, ALL ^ ((1 << BAND_BITS) - 1), check)
    found = connected(equal.unionByName(links))
    least = nodes.join(found, "node").groupBy("component").agg(F.min("least").alias("reached"))
    named = nodes.join(found.join(least, "component"), "node", "left").select("sketch", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(named, "sketch").select(F.col("id").alias("doc_id"), "component_id")
