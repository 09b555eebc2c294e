"""Ranked lexical search: each item's best documents, by a join whose thresholds are known before it begins."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, numbered, text_bytes
from ledgerloom.llm.resampling import FOLD

#: Items that are asked in one pass over the documents. What a task is sent and holds grows with the texts of so many items, not with the documents.
ITEMS = 4096
#: Pairs of a posting and an item, and cells of a document and an item, that a task holds at once.
PAIRS, CELLS = 1 << 19, 1 << 20
#: Found rows that wait until they are merged into the best.
WAITING = 1 << 16


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(FOLD).split()


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m, from its number of terms, the number of documents and the number of all their terms."""
    return 75 + (25 * n * documents) // max(total, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _firsts(group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.flatnonzero(np.arange(len(group)) - np.repeat(begins, np.diff(np.r_[begins, len(group)])) < k)


def _spread(counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts[i] entries from begins[i] on: the i of each, and its place."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[which]


def _postings(vocabulary: dict[bytes, int]):
    """Of each text: its number of terms, and the terms of the vocabulary that it holds, ascending, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            n, held, often = [], [], []
            for text in text_bytes(batch, "text"):
                words = terms(text)
                known = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                term, tf = np.unique(known[known >= 0], return_counts=True)
                n.append(len(words))
                held.append(term.tobytes())
                often.append(tf.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(often, pa.binary())], ["doc_id", "n", "terms", "often"])

    return run


def _entries(batch: pa.RecordBatch, documents: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and impact of each posting of a batch."""
    held, often = batch.column("terms").to_pylist(), batch.column("often").to_pylist()
    row = np.repeat(np.arange(len(held)), [len(h) // 4 for h in held])
    term, tf = np.frombuffer(b"".join(held), np.int32).astype(np.int64), np.frombuffer(b"".join(often), np.int32).astype(np.int64)
    return row, term, impact(tf, length_norm(batch.column("n").to_numpy(), documents, total)[row])


def _greatest(size: int, k: int, documents: int, total: int):
    """Of each term: in how many of a task's documents it is, and its k greatest impacts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, best = np.zeros(size, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            _, term, value = _entries(batch, documents, total)
            df += np.bincount(term, minlength=size)
            term, value = np.r_[best[0], term], np.r_[best[1], value]
            order = np.lexsort((-value, term))
            order = order[_firsts(term[order], k)]
            best = term[order], value[order]
        some = np.flatnonzero(df)
        ends = np.searchsorted(best[0], some, "right")
        values = [best[1][a:b] for a, b in zip(np.searchsorted(best[0], some), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(values, pa.list_(pa.int64()))], ["term", "df", "impacts"])

    return run


class Plan:
    """What a block of items asks of every document.

    The k-th greatest impact of any of its terms, times the term's weight, is a lower bound of an item's k-th score: that many documents reach it by this term alone. Terms are put in ascending order
    of the most that they can add. The longest beginning of this order whose sum stays below the bound can't lift a document into the k best on its own, so only the other, the asking terms,
    bring candidates.
    """

    def __init__(self, items: list[Counter], df: np.ndarray, greatest: np.ndarray, kth: np.ndarray, documents: int):
        w = np.array([weight(documents, int(d)) if d else 0 for d in df], np.int64)
        term, item, value, asks = [], [], [], []
        self.floor, self.rest = np.ones(len(items), np.int64), np.zeros(len(items), np.int64)
        for i, wanted in enumerate(items):
            ids = np.array(sorted(t for t in wanted if w[t]), np.int64)
            times = np.array([wanted[t] for t in ids.tolist()], np.int64)
            most = times * w[ids] * greatest[ids]
            self.floor[i] = max(1, int((times * w[ids] * kth[ids]).max(initial=0)))
            order = np.argsort(most, kind="stable")
            idle = int(np.searchsorted(np.cumsum(most[order]), self.floor[i]))
            self.rest[i] = most[order[:idle]].sum()
            term.append(ids[order])
            item.append(np.full(len(ids), i))
            value.append((times * w[ids])[order])
            asks.append(np.arange(len(ids)) >= idle)
        #: Of each item its terms, in order, with their weights times occurrences.
        self.term, self.value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, value))
        self.count = np.array([len(x) for x in term], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        # of each term the items that it asks for
        ask = np.flatnonzero(np.concatenate(asks)) if asks else np.zeros(0, np.int64)
        ask = ask[np.argsort(self.term[ask], kind="stable")]
        self.asked, self.asked_value = (np.concatenate(item) if item else np.zeros(0, np.int64))[ask], self.value[ask]
        self.asked_count = np.bincount(self.term[ask], minlength=len(df)).astype(np.int64)
        self.asked_begin = np.cumsum(self.asked_count) - self.asked_count


class Best:
    """The k best rows of each item so far, by descending score, then ascending id, null last."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.copy(), k
        self.rows, self.waiting, self.held = [np.zeros(0, np.int64)] * 4, [], 0  # items, scores, whether the id is null, ids

    def add(self, *found: np.ndarray) -> None:
        self.waiting.append(found)
        self.held += len(found[0])
        if self.held > WAITING:
            self.merge()

    def merge(self) -> None:
        item, score, null, ids = (np.concatenate(x) for x in zip(self.rows, *self.waiting, strict=True))
        order = np.lexsort((ids, null, -score, item))
        order = order[_firsts(item[order], self.k)]
        self.rows, self.waiting, self.held = [x[order] for x in (item, score, null, ids)], [], 0
        full = np.bincount(self.rows[0], minlength=len(self.floor)) >= self.k
        last = np.searchsorted(self.rows[0], np.flatnonzero(full), "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.rows[1][last])


def _search(plan: Plan, k: int, size: int, documents: int, total: int, pairs: int, cells: int):
    """The best rows of a task's documents for each item of the plan."""

    def chunks(row: np.ndarray, term: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
        asked = np.cumsum(np.bincount(row, weights=plan.asked_count[term], minlength=rows))
        at = 0
        while at < rows:
            before = asked[at - 1] if at else 0
            end = int(np.searchsorted(asked, before + pairs, "right"))
            end = max(at + 1, min(end, rows, at + max(1, cells // max(len(plan.count), 1))))
            yield at, end
            at = end

    def candidates(best: Best, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) where what asking terms give, and the most that the others can add, reach the item's floor."""
        entry, place = _spread(plan.asked_count[term], plan.asked_begin[term])
        items = len(plan.count)
        gives = np.bincount(row[entry] * items + plan.asked[place], weights=(value[entry] * plan.asked_value[place]).astype(np.float64), minlength=rows * items).reshape(rows, items)
        return np.nonzero((gives > 0) & ((gives + plan.rest) * (1 + 1e-12) >= best.floor))

    def exact(row: np.ndarray, item: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The whole score of each candidate, in whole numbers, over all terms of its item."""
        pair, place = _spread(plan.count[item], plan.begin[item])
        wanted = row[pair] * size + plan.term[place]
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        score = np.zeros(len(row), np.int64)
        np.add.at(score, pair, np.where(key[at] == wanted, value[at], 0) * plan.value[place])
        return score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(plan.floor, k)
        for batch in batches:
            row, term, value = _entries(batch, documents, total)
            ids = batch.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
            for begin, end in chunks(row, term, batch.num_rows):
                a, b = np.searchsorted(row, [begin, end])
                r, t, v = row[a:b] - begin, term[a:b], value[a:b]
                found, item = candidates(best, r, t, v, end - begin)
                if len(found):
                    score = exact(found, item, r * size + t, v)
                    good = score >= best.floor[item]
                    best.add(item[good], score[good], null[begin + found[good]], ids[begin + found[good]])
        best.merge()
        item, score, null, ids = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null.astype(bool)), pa.array(score)], ["item", "doc_id", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = ITEMS,
    pairs: int = PAIRS, cells: int = CELLS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items the k documents of the greatest score above 0.

    A document's score for an item is the sum, over the item's terms with repeats, of the term's weight (by the documents that hold it) times its impact (by its occurrences and the document's length);
    all but the weights' logarithm is in whole numbers. Ties go to the smaller doc_id, null last. Scores are exact, however candidates are found: documents' postings stay where they were
    read, a task takes the asking terms of all items to its documents, leaves out pairs whose bound is below the item's threshold, scores the rest whole and hands on k rows of each item. Its thresholds
    begin with those of the stored k-th impacts and rise with its own k-th scores.

    Items are asked in blocks of `block` rows, each with passes of its own; their terms, document frequencies and thresholds, which grow with the block alone, go through the driver to the tasks.
    Postings hold only terms that items of the block ask for, and are written to the shared folder. A text that is null or has no term takes no part, as item has no rows, and as document is not counted.
    Each row of items is an item, also if it repeats another; repeated documents each have their row. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = durable(numbered(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("wanted")), F.struct("item_id", "wanted"), "item"))
    kind = asked.schema["item_id"].dataType.simpleString()
    parts = [_block(texts, asked.where((F.col("item") >= at) & (F.col("item") < at + block)), at, k, pairs, cells) for at in range(0, asked.count(), block)]
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, asked: DataFrame, first: int, k: int, pairs: int, cells: int) -> DataFrame:
    """(item, doc_id, score): the best rows of each task for each item of a block."""
    rows = sorted(asked.collect(), key=lambda r: r.item)
    wanted = [Counter(terms((r.wanted or "").encode())) for r in rows]
    vocabulary: dict[bytes, int] = {}
    items = [Counter({vocabulary.setdefault(t, len(vocabulary)): n for t, n in w.items()}) for w in wanted]
    size = max(len(vocabulary), 1)

    postings = durable(texts.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms binary, often binary"))
    documents, total = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    stored = durable(postings.select("n", "terms", "often").mapInArrow(_greatest(size, k, documents, total), "term long, df long, impacts array<long>"))
    df, greatest, kth = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in stored.groupBy("term").agg(F.sum("df").alias("df"), F.max(F.element_at("impacts", 1)).alias("most")).collect():
        df[r.term], greatest[r.term] = r.df, r.most
    one = stored.select("term", F.explode("impacts").alias("impact"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    for r in one.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).collect():
        kth[r.term] = r.impact
    plan = Plan(items, df, greatest, kth, documents)
    found = postings.mapInArrow(_search(plan, k, size, documents, total, pairs, cells), "item long, doc_id long, score long")
    return found.withColumn("item", F.col("item") + first)


#: The rows of search in SQL, over the tables `documents` and `benchmark`.
SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark
), totals AS (
  SELECT count(*) FILTER (len(terms) > 0) AS documents, sum(len(terms))::BIGINT AS total FROM docs
), wanted AS (
  SELECT item, term, count(*) AS times FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY item, term
), postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM postings, totals GROUP BY term, documents
), norms AS (
  SELECT row, doc_id, 100 - 25 + (25 * len(terms) * documents) // total AS m FROM docs, totals WHERE len(terms) > 0
), scored AS (
  SELECT item, row, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (row) GROUP BY item, row
), ranked AS (
  SELECT item, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored JOIN docs USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 20
"""
