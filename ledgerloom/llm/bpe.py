"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, all others by a heap of merges over linked bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that a worker remembers before it forgets them all, about 70 MB.
REMEMBERED = 3 << 17
#: Displacements that are tried at once.
TRIED = 256
#: Bytes of texts whose results a task holds at once, or one text.
PORTION = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [ranked[i] for i in range(len(ranked))]


class PerfectHash:
    """A minimal perfect hash of distinct keys: as many places as keys, each key in its own.

    Keys fall into buckets by one half of their hash. The largest buckets first, each gets the least displacement of the other half that leads all
    its keys to free places; a bucket with one key gets a free place itself, stored as a negative number. Displacements are tried by arrays of TRIED.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket, high = (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets), hashes >> np.uint64(32)
        shift, place = np.zeros(self.buckets, np.int64), np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
        size = np.diff(first, append=self.n)
        single = []
        for g in np.argsort(-size, kind="stable"):
            members = order[first[g] : first[g] + size[g]]
            if len(members) == 1:
                single.append(int(members[0]))
                continue
            d, found = 0, np.zeros(0, np.int64)
            while not len(found):
                at = np.sort(self._mixed(high[members], np.arange(d, d + TRIED, dtype=np.uint64)[:, None]), axis=1)
                found = np.flatnonzero((place[at] < 0).all(axis=1) & (np.diff(at, axis=1) != 0).all(axis=1))
                d += TRIED
            d += int(found[0]) - TRIED
            place[self._mixed(high[members], np.uint64(d))] = members
            shift[bucket[members[0]]] = d
        for member, at in zip(single, np.flatnonzero(place < 0).tolist(), strict=True):
            place[at] = member
            shift[bucket[member]] = -at - 1
        self.shift, self.place = shift.tolist(), place.tolist()

    def _mixed(self, high: np.ndarray, d: np.ndarray) -> np.ndarray:
        """A place for the upper half of a hash and a displacement, both below 2^32."""
        turned = (high ^ (d * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))) * np.uint64(0x85EBCA6B)
        return (((turned >> np.uint64(13)) + d) % np.uint64(self.n)).astype(np.int64)

    def index(self, key: bytes) -> int:
        """The place's key number; right only if the key is one of them, so that the caller compares the key."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        return self.place[-d - 1 if d < 0 else ((((h >> 32 ^ d * 0x9E3779B1 & 0xFFFFFFFF) * 0x85EBCA6B) >> 13) + d) % self.n]


class Encoder:
    """Encodes and decodes by a ranked vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str, whole: PerfectHash | None = None):
        self.tokens = tokens
        self.whole = whole or PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}  # tuples of numbers, which the collector of garbage needn't look at

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        data = text.encode("utf-8")
        i = self.whole.index(data)
        ids = (i,) if self.tokens[i] == data else tuple(self.merged(data))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(data) <= 64:
            self.known[text] = ids
        return ids

    def merged(self, data: bytes) -> list[int]:
        """Merges the pair of neighbours of the least rank, the leftmost among equals, until none is a token.

        Parts are linked by the start of the next and of the previous; the heap holds rank and start of each pair, and a pair that has another rank since is passed over.
        """
        n = len(data)
        ranks, get = self.ranks, self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here
        prev = list(range(-1, n - 1))
        rank = [get(data[i : i + 2], -1) for i in range(n - 1)]  # of the pair that starts here, -1 if it is no token
        rank.append(-1)
        shift = max(14, n.bit_length())
        low = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & low
            if rank[i] != top >> shift:
                continue
            j = end[i]
            k = end[i] = end[j]
            rank[j] = -1  # no part starts there any more
            if k < n:
                prev[k] = i
                r = rank[i] = get(data[i : end[k]], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                rank[i] = -1
            h = prev[i]
            if h >= 0:
                r = rank[h] = get(data[h:k], -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str) -> list[int]:
        known, piece = self.known.get, self.piece
        ids: list[int] = []
        for p in self.split(text):
            ids += known(p) or piece(p)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(tokens: list[bytes], whole: PerfectHash, pattern: str, key: int) -> Encoder:
    """A worker's own encoder, kept between its tasks."""
    if (key, pattern) not in _encoders:
        _encoders.clear()
        _encoders[key, pattern] = Encoder(tokens, pattern, whole)
    return _encoders[key, pattern]


def _mapped(docs: DataFrame, columns: list, path: str, pattern: str, schema: str, rows: Callable[[Encoder, str], tuple]) -> DataFrame:
    """Columns of docs, the last one a text, with what rows gives for the text in its place."""
    tokens = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))  # as large as the vocabulary; the hash is built once, here
    key = xxhash.xxh64_intdigest(b"\n".join(map(base64.b64encode, tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = _encoder(*sent.value, pattern, key)
            *kept, texts = batch.columns
            found, done, size = [], 0, 0
            for i, t in enumerate(texts.cast(pa.large_binary())):
                data = t.as_py() or b""
                found.append(rows(encoder, data.decode("utf-8", "replace")))
                size += len(data)
                if size >= PORTION or i + 1 == batch.num_rows:
                    out = [c.slice(done, len(found)) for c in kept] + [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    found, done, size = [], i + 1, 0

    narrow = docs.select(*columns)
    fields = [f"`{n}` {t}" for n, t in narrow.dtypes[:-1]]
    names = [*narrow.columns[:-1], *(f.split()[0] for f in schema.split(", "))]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[f.split()[1]] for f in schema.split(", ")]
    return narrow.mapInArrow(run, ", ".join([*fields, schema]))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every text, for a vocabulary file that the driver reads; null counts as empty."""
    ids = lambda encoder, text: (encoder.encode(text),)
    return _mapped(docs, [F.col(id_col).alias("doc_id"), F.col(text_col)], path, pattern, "ids array<long>", ids)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row: sums of the ids of its whole text, and of what they decode to.

    A null text counts as empty and has no tokens. Rows are mapped one by one, so repeated rows repeat and other columns don't matter.
    """
    decimal = list(map(str, range(len(read_ranks(path)))))

    def digest(encoder: Encoder, text: str) -> tuple:
        ids = encoder.encode(text)
        written = " ".join(map(decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest(), *([np.array(ids, np.int64)] if keep_ids else [])

    columns = [F.col(id_col).alias("doc_id"), F.col(text_col)]
    return _mapped(docs, columns, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids, digest)
