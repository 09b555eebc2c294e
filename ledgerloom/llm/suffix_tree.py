"""Language-model scoring by a probabilistic suffix tree over words. The tree is never in one place: groups of texts ask for counts, buckets of contexts answer."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import remainder, text_bytes

#: Words of the longest context.
DEPTH = 2
#: A context has been seen so often at least.
LEAST = 2
#: It stays if its next-word estimates diverge from its suffix's by so many nats a word, and by so many in all.
DIVERGENCE, EVIDENCE = 0.005, 12.0
#: Occurrences that a suffix's estimate counts for in a longer context's.
PRIOR = 16.0
#: Followers of a context seen more often are dealt over several buckets; if growth is gated by suffixes, such a context is always in the tree.
HOT = 1 << 20
#: The lowest byte of a key that asks for the evidence of a part of such a context; followers have 0 there.
MARK = np.uint64(1)
#: Bytes of text in a group, and of text whose contexts share a bucket.
GROUP_BYTES, BUCKET_BYTES = 5 << 20, 8 << 20
#: Bytes that are cut into words at once.
PIECE = 1 << 20
#: Bytes that are sent as they are.
SMALL = 256
#: Estimates go to the buckets in steps of so many to a bit.
STEPS = 8

_RANDOM = np.random.PCG64(42).random_raw(256 + (1 << 16)) | np.uint64(1)
_BYTES, _PLACES = _RANDOM[:256], _RANDOM[256:]
#: The hash of the token that ends a text and stands before it.
END = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")

STATE = "group long, ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, train binary"
REQUEST = "group long, bucket long, keys binary, n binary, bits binary"
ANSWER = "group long, level int, bucket long, codes binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, n_context long, base_score double, score double"


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every bit dependent on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the data starts, and its 64-bit hash, A-Z lowered."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.end() if cut else len(data)
        raw = np.frombuffer(data[at:end].lower(), np.uint8)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, size = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        size -= first
        if len(first):
            before = np.cumsum(size) - size
            place = np.arange(before[-1] + size[-1]) - np.repeat(before, size)
            terms = _BYTES[raw[inside]] * (_PLACES[place & 0xFFFF] + (place >> 16).astype(np.uint64) * END)
            hashes.append(mixed(np.add.reduceat(terms, before) + size.astype(np.uint64)))
            starts.append(first + at)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def _token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, one after the other, and the number of each text's; a text's last token is END."""
    starts, hashes = words_of(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, ends)
    return np.insert(hashes, upto, END), np.diff(upto, prepend=0) + 1


def packed(a: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, which compress better."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeezed(a: np.ndarray) -> bytes:
    """Planes of bytes behind their number, compressed where that pays."""
    raw = packed(a)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if len(raw) > SMALL else raw)


def expanded(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return unpacked(pa.decompress(data[8:], size, "zstd", asbytes=True) if size > SMALL else data[8:], kind)


def home(hashed: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its upper 32 bits."""
    return (hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def distinct(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order: where each stands first, and the place of every pair among them."""
    order = np.lexsort((key, bucket))
    fresh = np.r_[True, (bucket[order][1:] != bucket[order][:-1]) | (key[order][1:] != key[order][:-1])][: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return order[fresh], place


def _pack_groups(group_bytes: int):
    """STATE rows of (id, held_out, text): of up to group_bytes of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        ids, held, sizes, hashes, texts = [], [], [], [], []
        waiting = total = 0

        def hash_waiting() -> None:
            nonlocal texts, waiting
            if texts:
                found, size = _token_hashes(texts)
                hashes.append(found)
                sizes.append(size)
                texts, waiting = [], 0

        def state() -> pa.RecordBatch:
            nonlocal group, ids, held, sizes, hashes, total
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            hashes = []
            size = np.concatenate(sizes)
            learned = np.repeat(~np.array(held), size)
            train = np.bincount(tokens[learned], minlength=len(words)).astype(np.uint32)
            small = pa.compress(packed(tokens.astype(np.uint32)), "zstd", asbytes=True)
            columns = [group], [ids], [held], [size.tolist()], [len(tokens).to_bytes(8, "little") + small], [packed(np.diff(words, prepend=np.uint64(0)))], [packed(train)]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()
            group += 1
            ids, held, sizes, hashes, total = [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["group", "ids", "held", "sizes", "tokens", "words", "train"])

        for batch in batches:
            for doc_id, out, text in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), text_bytes(batch, "text"), strict=True):
                ids.append(doc_id)
                held.append(out)
                texts.append(text)
                waiting += len(text)
                total += len(text) + 64
                if waiting >= PIECE:
                    hash_waiting()
                if total >= group_bytes:
                    hash_waiting()
                    yield state()
        hash_waiting()
        if ids:
            yield state()

    return run


def _requests(group: int, of: np.ndarray, keys: np.ndarray, n: np.ndarray, bits: np.ndarray) -> pa.Table:
    """A REQUEST row for each bucket in `of`. Pairs of bucket and key are distinct and sorted."""
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    last = [*first[1:], len(keys)]
    delta = lambda part: squeezed(np.diff(part, prepend=np.uint64(0)))
    columns = (
        pa.array([group] * len(first), pa.int64()), pa.array(of[first].astype(np.int64)), pa.array([delta(keys[a:b]) for a, b in zip(first, last, strict=True)], pa.binary()),
        pa.array([squeezed(n[a:b]) for a, b in zip(first, last, strict=True)], pa.binary()), pa.array([squeezed(bits[a:b]) for a, b in zip(first, last, strict=True)], pa.binary()),
    )
    return pa.Table.from_arrays(list(columns), names=["group", "bucket", "keys", "n", "bits"])


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, words, train in zip(*(batch.column(c).to_pylist() for c in ("group", "words", "train")), strict=True):
                found = np.cumsum(unpacked(words, np.uint64), dtype=np.uint64)
                yield from _requests(group, home(found, buckets), found, unpacked(train, np.uint32), np.zeros(len(found), np.uint8)).to_batches()

    return run


def _summed(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket's requests with their counts and bits, the place of each asked key among them, and where each request ends."""
    keys = [np.cumsum(expanded(k, np.uint64), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
    n = np.concatenate([expanded(x, np.uint32) for x in asked.column("n").to_pylist()])
    bits = np.concatenate([expanded(x, np.uint8) for x in asked.column("bits").to_pylist()])
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    of_key = np.zeros(len(found), np.uint8)
    of_key[place] = bits
    return found, np.bincount(place, weights=n, minlength=len(found)), of_key, place, np.cumsum([len(k) for k in keys])


def _totals(asked: pa.Table) -> pa.Table:
    _, n, _, _, _ = _summed(asked)
    return pa.table({"n": pa.array([int(n.sum())]), "words": pa.array([int((n > 0).sum())])})


def _count(level: int, prior: float, tested: bool = True):
    """Answers to the requests of a bucket: twice the count of each key, and one more if its context diverges. A part of a hot context answers to its MARK with what its followers add to the context's evidence."""

    def run(asked: pa.Table) -> pa.Table:
        keys, n, bits, place, ends = _summed(asked)
        codes = 2 * n.astype(np.uint64)
        if level and tested:
            context = keys >> np.uint64(32)
            first = np.flatnonzero(np.diff(context, prepend=context[0] + np.uint64(1)))
            size = np.diff(first, append=len(keys))
            total = np.add.reduceat(n, first)
            base = np.exp2(bits.astype(np.float64) / -STEPS)
            estimate = (n + prior * base) / (np.repeat(total, size) + prior)
            gain = np.add.reduceat(n * np.log(estimate / base), first)
            kept = (total >= LEAST) & (gain >= DIVERGENCE * total) & (gain >= EVIDENCE)
            codes += np.repeat(kept, size).astype(np.uint64)
            mark = (keys & np.uint64(255)) == MARK
            if mark.any():
                evidence = np.add.reduceat(n * np.log((n + prior * base) / base), first)
                codes[mark] = np.repeat(evidence, size)[mark].view(np.uint64)
        answers = [squeezed(np.ascontiguousarray(c)) for c in np.split(codes[place], ends[:-1])]
        names = ["group", "level", "bucket", "codes"]
        return pa.Table.from_arrays([asked.column("group"), pa.array([level] * len(ends), pa.int32()), asked.column("bucket"), pa.array(answers, pa.binary())], names=names)

    return run


class Step(NamedTuple):
    """Tokens whose context of one length was tried: their places, the contexts, whether these diverge, and the estimates in them."""

    at: np.ndarray
    context: np.ndarray
    kept: np.ndarray
    logp: np.ndarray


class Hot:
    """The contexts among tokens' contexts that were seen over HOT times, and the names of all parts of each."""

    def __init__(self, context: np.ndarray, often: np.ndarray, parts: np.ndarray):
        self.at = np.flatnonzero(often > HOT)
        found, first, self.of = np.unique(context[self.at], return_index=True, return_inverse=True)
        self.total, pieces = often[self.at][first], parts[self.at][first].astype(np.int64)
        self.owner = np.repeat(np.arange(len(found)), pieces)
        nth = np.arange(len(self.owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.part = mixed(found[self.owner] + nth.astype(np.uint64) * END)

    def __bool__(self) -> bool:
        return len(self.at) > 0

    def test(self, kept: np.ndarray, evidence: np.ndarray, prior: float) -> None:
        """Whether each of these contexts diverges, from what all its parts add to its evidence, into kept."""
        gain = np.bincount(self.owner, evidence, len(self.total)) - self.total * np.log(self.total + prior)
        kept[self.at] = ((gain >= DIVERGENCE * self.total) & (gain >= EVIDENCE))[self.of]


class Group:
    """The texts of one group, and how far the answers bring their tokens' estimates."""

    def __init__(self, state: pa.Table, answers: pa.Table, room: float, prior: float, gated: bool = True):
        one = {c: state.column(c)[0] for c in state.column_names}
        self.group, self.ids, self.held = one["group"].as_py(), one["ids"].values, one["held"].values
        self.sizes = one["sizes"].values.to_numpy()
        raw = one["tokens"].as_py()
        size = int.from_bytes(raw[:8], "little")
        self.tokens = unpacked(pa.decompress(raw[8:], 4 * size, "zstd", asbytes=True), np.uint32)
        self.words = np.cumsum(unpacked(one["words"].as_py(), np.uint64), dtype=np.uint64)
        self.prior, self.room, self.gated = prior, room, gated
        self.answers: dict[int, np.ndarray] = {}
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "codes")), strict=True))
        for level in {r[0] for r in rows}:
            self.answers[level] = np.concatenate([expanded(codes, np.uint64) for at, _, codes in rows if at == level])

    def walk(self, depth: int, buckets: int, asking: int | None = None) -> pa.Table | None:
        """Goes from short contexts to long as far as there are answers; returns the requests of the next level, None at depth or where no context is left. If growth isn't gated, the level behind depth tells
        which contexts have a longer one in the tree; `asking` is the level whose requests are due."""
        counts = (self.answers[0] >> np.uint64(1)).astype(np.float64)
        self.known = counts[self.tokens] > 0
        self.logp = np.log2((counts + 1) / self.room)[self.tokens]
        self.base = self.logp.copy()
        self.level = np.zeros(len(self.tokens), np.int8)
        inside = np.concatenate(([False], self.words[self.tokens[:-1]] != END))
        last = np.concatenate(([np.uint64(0)], self.words[self.tokens[:-1]]))
        last[0] = END
        of_end = counts[np.searchsorted(self.words, END)]
        seen = np.concatenate(([of_end], counts[self.tokens[:-1]]))
        context = mixed(last)
        open_ = seen >= LEAST
        learned = np.repeat(~self.held.to_numpy(zero_copy_only=False).astype(bool), self.sizes)
        steps: list[Step] = []
        for level in range(1, depth + 1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            word = self.words[self.tokens[at]]
            often = seen[at]
            parts = np.ceil(np.maximum(often / HOT, 1)).astype(np.uint64)
            part = mixed(context[at] + (word % parts) * END)
            bucket, key = home(part, buckets), (part << np.uint64(32)) | (word >> np.uint64(40) << np.uint64(8))
            hot = Hot(context[at], often, parts) if not self.gated else None
            if hot:
                bucket, key = np.concatenate((bucket, home(hot.part, buckets))), np.concatenate((key, (hot.part << np.uint64(32)) | MARK))
            first, place = distinct(bucket, key)
            if level not in self.answers:
                n = np.bincount(place[: len(at)][learned[at]], minlength=len(first)).astype(np.uint32)
                bits = np.clip(np.round(np.concatenate((self.logp[at], np.zeros(len(key) - len(at))))[first] * -STEPS), 0, 255).astype(np.uint8)
                return _requests(self.group, bucket[first], key[first], n, bits)
            codes = self.answers[level][place[: len(at)]]
            n = (codes >> np.uint64(1)).astype(np.float64)
            kept = (codes & np.uint64(1)) == 1
            if hot:
                hot.test(kept, self.answers[level][place[len(at) :]].view(np.float64), self.prior)
            elif self.gated:
                kept |= often > HOT
            to = kept if self.gated else np.ones(len(at), bool)
            on = at[to]
            self.logp[on] = np.log2((n[to] + self.prior * np.exp2(self.logp[on])) / (often[to] + self.prior))
            self.level[at[kept]] = level
            if not self.gated:
                steps.append(Step(at, context[at], kept, self.logp[at]))
            longer, after = mixed(context * np.uint64(3) + self.words[self.tokens]), np.zeros(len(seen))
            after[at] = n
            context, seen = np.concatenate((context[:1], longer[:-1])), np.concatenate(([0.0], after[:-1]))
            open_ = inside & (seen >= LEAST) & ((self.level == level) | (not self.gated))
        return None if self.gated else self._closed(steps, depth, buckets, asking)

    def _closed(self, steps: list[Step], depth: int, buckets: int, asking: int | None) -> pa.Table | None:
        """A context that doesn't diverge is in the tree as well if a longer one that ends in it is. Groups tell of the longer ones that they have, and hear of the others'."""
        failed = [step.at[~step.kept] for step in steps[: depth - 1]]
        name = np.concatenate([step.context[~step.kept] for step in steps[: depth - 1]] or [np.zeros(0, np.uint64)])
        if len(name):
            longer = np.concatenate([self.level[at] > k for k, at in enumerate(failed, 1)])
            bucket = home(name, buckets)
            first, place = distinct(bucket, name)
            if depth + 1 not in self.answers:
                n = (np.bincount(place[longer], minlength=len(first)) > 0).astype(np.uint32)
                return _requests(self.group, bucket[first], name[first], n, np.zeros(len(first), np.uint8)) if asking in (None, depth + 1) else None
            found = np.split(self.answers[depth + 1][place] > 0, np.cumsum([len(at) for at in failed])[:-1])
            for k, (at, there) in enumerate(zip(failed, found, strict=True), 1):
                self.level[at[there]] = np.maximum(self.level[at[there]], k)
        self.logp = self.base.copy()
        for k, step in enumerate(steps, 1):
            chosen = self.level[step.at] == k
            self.logp[step.at[chosen]] = step.logp[chosen]
        return None

    def scored(self) -> pa.Table:
        first = np.cumsum(self.sizes) - self.sizes
        sums = lambda x, kind: pa.array(np.add.reduceat(x, first, dtype=kind))
        columns = [self.ids, self.held, pa.array(self.sizes.astype(np.int64)), sums(self.known, np.int64), sums(self.level > 0, np.int64)]
        logs = [pa.array(np.add.reduceat(x, first) * math.log10(2)) for x in (self.base, self.logp)]
        return pa.Table.from_arrays(columns + logs, names=["doc_id", "held_out", "n_tokens", "n_known", "n_context", "base_score", "score"])


def _asker(depth: int, buckets: int, room: float, prior: float, gated: bool, asking: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    empty = pa.schema([("group", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("bits", pa.binary())]).empty_table()

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        found = Group(state, answers, room, prior, gated).walk(depth, buckets, asking)
        return empty if found is None else found

    return run


def _scorer(depth: int, buckets: int, room: float, prior: float, gated: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(state, answers, room, prior, gated)
        group.walk(depth, buckets)
        return group.scored()

    return run


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 7, held_out: int = 2, depth: int = DEPTH, prior: float = PRIOR, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES,
    gated: bool = True,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_context) of every row.

    Learns from the rows whose crc32(doc_id as text) modulo divisor is not held_out. The tree's contexts are the last one to `depth` tokens. Every context that was seen LEAST times is tried, whether or not its suffix
    diverges. It is in the tree if its next-token counts diverge from the suffix's estimates by DIVERGENCE a token and by EVIDENCE in all, or if a longer one that ends in it is; so all suffixes of a context in the tree
    are in it too. With `gated`, a context is tried only if its suffix diverges, and one seen over HOT times is in the tree untested. These are numbers of occurrences, not shares, so the tree grows with the corpus. The root's estimates are the base's; a context's are its counts, smoothed by `prior` occurrences of its suffix's estimate. A token has the estimate of the longest context in the tree; score is the sum of
    log10 over the tokens, and n_context the number of tokens with a context in the tree.

    Texts are packed into groups where they are read. Level by level, each group sends its distinct pairs of context and token, with their counts, to the buckets of the contexts; a bucket adds them up, tests
    its contexts and answers. Nothing of this passes the driver but two sums. Tokens stand for themselves by 64-bit hashes. A context has
    one half of its hash for its bucket and the other, 32 bits, for its name inside, so names don't get scarce as buckets get many; tokens after a context have 24 bits.

    A null text counts as empty: its only token is the end. A null id counts as the empty text in the split. Repeated rows are scored, and learned from, each time. With nothing to learn from, all tokens are
    one unknown. Texts are scored whole; a text is held in one task.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), (remainder(F.col(id_col), divisor) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // bucket_bytes))
    state = narrow.mapInArrow(_pack_groups(group_bytes), STATE)
    sums = state.mapInArrow(_ask_words(buckets), REQUEST).groupBy("bucket").applyInArrow(_totals, "n long, words long")
    total, distinct = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    room = float(total + distinct + 1)

    state = state.repartition("group")
    asked = state.mapInArrow(_ask_words(buckets), REQUEST)
    answers: DataFrame | None = None
    last = depth if gated or depth < 2 else depth + 1
    for level in range(last + 1):
        found = asked.groupBy("bucket").applyInArrow(_count(level, prior, level <= depth), ANSWER).repartition("group")
        answers = found if answers is None else answers.unionByName(found)
        both = state.groupBy("group").cogroup(answers.groupBy("group"))
        if level < last:
            asked = both.applyInArrow(_asker(depth, buckets, room, prior, gated, level + 1), REQUEST)
    rows = both.applyInArrow(_scorer(depth, buckets, room, prior, gated), SCORED)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_context")
