"""Importance resampling towards a target: documents are drawn by how much more usual their word runs are in the target than in the corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, numbered, text_bytes

#: Word runs are counted in so many buckets, whatever the input.
BUCKETS = 10_000
#: Longest run of words.
LONGEST = 3
#: Bytes of texts that share one dictionary of words; a longer text has its own.
BLOCK = 2 << 20
#: What becomes of each byte: A-Z turn small; digits, a-z and all bytes of other characters stay; what is left parts words.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Runs:
    """The word runs of a block of texts, as tuples of integers.

    Distinct words of the block get ids. A run of n words is the pair (id of its first n - 1 words, id of its last word), and the distinct pairs get ids in turn. Each distinct run's bytes are
    hashed once, those of its last word after the checksum of the words before it, and `which` brings the result back to all places where the run stands.
    """

    def __init__(self, texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS):
        split = [t.translate(FOLD).split() for t in texts]
        self.texts, self.words = len(split), np.fromiter(map(len, split), np.int64, len(split))
        #: For each length: the text of every run, the number of its tuple, and the bucket of each tuple.
        self.of_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        text = np.repeat(np.arange(self.texts), self.words)
        coded = pa.array(list(chain.from_iterable(split)), pa.large_binary()).dictionary_encode()
        del split
        word, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        start, which, sums = np.arange(len(word)), word, np.fromiter(map(crc32, names), np.int64, len(names))
        after = [b" " + name for name in names]
        for n in range(1, longest + 1):
            if n > 1:
                inside = start + n - 1 < len(word)
                inside[inside] = text[start[inside]] == text[start[inside] + n - 1]
                start = start[inside]
                coded = pa.array(which[inside] * len(names) + word[start + n - 1]).dictionary_encode()
                first, last = np.divmod(coded.dictionary.to_numpy(), max(len(names), 1))
                which, sums = coded.indices.to_numpy().astype(np.int64), np.fromiter(map(crc32, map(after.__getitem__, last.tolist()), sums[first].tolist()), np.int64, len(first))
            self.of_length.append((text[start], which, sums % buckets))

    def totals(self, buckets: int = BUCKETS) -> np.ndarray:
        """Runs in each bucket: each tuple's places are counted, and the counts joined to its bucket."""
        total = np.zeros(buckets, np.int64)
        for _, which, bucket in self.of_length:
            np.add.at(total, bucket, np.bincount(which, minlength=len(bucket)))
        return total

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the number of its runs and the sum of their gains."""
        n, weight = np.zeros(self.texts, np.int64), np.zeros(self.texts, np.int64)
        for text, which, bucket in self.of_length:
            if len(text):
                begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                n[text[begins]] += np.diff(np.r_[begins, len(text)])
                weight[text[begins]] += np.add.reduceat(gains[bucket][which], begins)
        return n, weight


def _blocks(batch: pa.RecordBatch, name: str, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in blocks of about `size` bytes, with the row where each block begins."""
    begin, texts, held = 0, [], 0
    for i, text in enumerate(text_bytes(batch, name)):
        if texts and held + len(text) > size:
            yield begin, texts
            begin, texts, held = i, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield begin, texts


def bucket_totals(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, block: int = BLOCK) -> np.ndarray:
    """How many word runs of all texts fall into each bucket. A task adds up its own before anything is shuffled, and `buckets` sums come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _blocks(batch, "text", block):
                total += Runs(part, longest, buckets).totals(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for row in texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row.bucket] = row.n
    return found


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, both smoothed by one run a bucket."""
    s_all, t_all, smooth = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + smooth)) / ((s + 1) * (t_all + smooth)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """floor(1000 times) a draw from the standard Gumbel distribution, which seed and doc_id decide; a null doc_id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = 42,
    longest: int = LONGEST, buckets: int = BUCKETS, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of docs.

    Features are all runs of 1 to `longest` words of whole texts, in `buckets` buckets by their checksum. A document's weight is the sum of its features' gains; with noise by id, the
    `percent` % highest scores of the documents with `least_words` words are a draw without replacement in proportion to the weights' exponentials. rank numbers them from 1, ties to the
    smaller doc_id; other rows have a null rank.

    Texts are read twice, by block: once for the totals of buckets, of which there is a fixed number, and once for weights. Only (id, numbers) are sorted, over ranges of scores, and only the
    sizes of the ranges come to the driver. A null or empty text has no features and weight 0; a null id counts as empty and comes first among ties; repeated rows are counted and drawn one by
    one; an empty table gives no rows, and an empty target prefers what the corpus has seldom. Other columns of docs are not read.
    """
    gains = bucket_gains(bucket_totals(docs, text_col, longest, buckets, block), bucket_totals(target, target_col, longest, buckets, block))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in _blocks(batch, "text", block):
                runs = Runs(part, longest, buckets)
                n, weight = runs.weights(gains)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(part)), pa.array(runs.words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = durable(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    order = F.struct((F.col("n_words") < least_words).alias("late"), (-F.col("score")).alias("least"), "doc_id", "n_features", "weight")
    place = numbered(scored, order, "place")
    return place.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"), "n_words")


#: The rows of resample in SQL, over the tables `documents` and `benchmark`; checksums are taken by half bytes, from a table that SQL builds.
RESAMPLE_SQL = r"""
WITH crc_table AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(4)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(16) r(n))),
folded AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT row, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS f FROM folded, range(1, 4) r(n)),
target_runs AS (SELECT unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS f FROM wanted, range(1, 4) r(n)),
counted AS (SELECT row, f, count(*) AS c FROM runs GROUP BY ALL),
target_counted AS (SELECT f, count(*) AS c FROM target_runs GROUP BY ALL),
nibbles AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM counted UNION SELECT f FROM target_counted)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) + 1), lambda i: (strpos('0123456789ABCDEF', h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::BIGINT)),
  lambda a, x: xor(a >> 4, t[(xor(a, x) & 15) + 1])), 4294967295) % 10000 AS bucket FROM nibbles, crc_table),
s AS (SELECT bucket, sum(c)::BIGINT AS s FROM counted JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(c)::BIGINT AS t FROM target_counted JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT b.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM folded LEFT JOIN weighed USING (row)),
placed AS (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100 THEN place END AS rank, n_words FROM placed
"""
