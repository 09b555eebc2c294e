"""Exact top-k by inner product: vectors by descending length, pruned by bounds on rotated partial sums."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable

#: Rows of a block of vectors.
BLOCK = 1024
#: Queries of a cell, which are held while the vectors pass by.
ASKED = 16384
#: Every cell of a grid holds ASKED queries and sees one of so many equal parts of the vectors; each part is a sample of all lengths.
PARTS = 16
#: Scores that are held at once.
HELD = 1 << 22
#: What rounding can take from a bound, as a share of the product of lengths.
SLACK = 1e-9


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x, norm): floor(scale * component) as long, and the vector's squared length. Vectors that are null, or hold null, NaN or infinity, go."""
    value = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = vectors.where(value.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(value, bad))
    x = F.transform(value, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = fit.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    return rows.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda a, c: a + (c * c).cast("double")))


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(values), dim), np.int64)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = np.diff(values.offsets.to_numpy())
    inner = values.flatten().to_numpy()
    if len(values) and (sizes == dim).all():
        return inner.reshape(-1, dim)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = inner[at : at + n]
        at += n
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all vectors, most telling first, from the dim x dim sum of their outer products."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("x"), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "value"])

    cells = rows.select("x").mapInArrow(products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    gram = np.zeros(dim * dim)
    for r in cells.collect():
        gram[r.cell] = r.value
    return np.linalg.svd(gram.reshape(dim, dim))[0]


class Search:
    """The k best of each query among the vectors seen so far, exact; vectors come in blocks of descending length.

    A query's floor is its k-th score so far. A block is left out for a query whose length times the block's greatest is below the floor. For all others rotated coordinates are
    added in steps of doubling width, and a vector goes as soon as the partial sum and the product of the remaining lengths are below the floor. What is left is
    scored in whole numbers.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.k, self.turn = ids, q, k, turn
        self.qr = q @ turn
        self.norm = np.linalg.norm(self.qr, axis=1)
        self.steps = [w for w in (8, 16, 32) if w < q.shape[1]]
        self.rest = {w: np.linalg.norm(self.qr[:, w:], axis=1) for w in self.steps}
        self.floor = np.full(len(ids), -np.inf)
        self.best = [np.zeros(0, np.int64)] * 3  # places of queries, ids and scores

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes in a block in descending order of length."""
        xr = x @ self.turn
        norm = np.linalg.norm(xr, axis=1)
        rest = {w: np.linalg.norm(xr[:, w:], axis=1) for w in self.steps}
        slack = SLACK * self.norm * (norm[0] if len(norm) else 0.0) + 1e-6
        able = np.flatnonzero(self.norm * (norm[0] if len(norm) else 0.0) >= self.floor - slack)
        exact = bool(len(norm)) and float(self.norm.max(initial=0.0)) * float(norm[0]) < 2.0**52
        width = max(1, HELD // max(1, len(ids)))
        for at in range(0, len(able), width):
            use = able[at : at + width]
            least = self.floor[use] - slack[use]
            found = self._dense(use, least, ids, x, xr, rest, exact)
            if found is None:
                continue
            rows, columns, scores = found
            own = self.ids[use[rows]] == ids[columns]
            self._merge(use[rows[~own]], ids[columns[~own]], scores[~own])

    def _dense(self, use: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, xr: np.ndarray, rest: dict, exact: bool):
        """Places of queries (of use) and vectors whose score may be the floor or more, with the score; None without any."""
        q, qr = self.q[use], self.qr[use]
        rows = columns = None
        partial, done = np.zeros((len(use), len(x))), 0
        for w in self.steps:
            if rows is None:
                partial += qr[:, done:w] @ xr[:, done:w].T
                ok = partial + np.outer(self.rest[w][use], rest[w]) >= least[:, None]
                many = int(ok.sum())
                if not many:
                    return None
                if many * 16 < ok.size:
                    rows, columns = np.nonzero(ok)
                    partial = partial[rows, columns]
            else:
                partial = partial + np.einsum("ij,ij->i", qr[rows, done:w], xr[columns, done:w])
                ok = partial + self.rest[w][use[rows]] * rest[w][columns] >= least[rows]
                rows, columns, partial = rows[ok], columns[ok], partial[ok]
            done = w
        if rows is not None:
            scores = np.einsum("ij,ij->i", self.whole(q)[rows], self.whole(x)[columns])
        else:
            full = (q @ x.T).astype(np.int64) if exact else self.whole(q) @ self.whole(x).T
            fresh = least == -np.inf
            if fresh.any() and full.shape[1] > self.k:
                own = np.flatnonzero(np.isin(ids, self.ids[use]))
                full[:, own] = np.where(self.ids[use][:, None] == ids[own], np.iinfo(np.int64).min, full[:, own])
                least = least.copy()
                least[fresh] = np.partition(full[fresh], -self.k, axis=1)[:, -self.k]
            rows, columns = np.nonzero(full >= least[:, None])
            scores = full[rows, columns]
        ok = scores >= least[rows]
        return rows[ok], columns[ok], scores[ok]

    @staticmethod
    def whole(x: np.ndarray) -> np.ndarray:
        return x.astype(np.int64)

    def _merge(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        places, ids, scores = (np.concatenate(pair) for pair in zip(self.best, (places, ids, scores), strict=True))
        order = np.lexsort((ids, -scores, places))
        places, ids, scores = places[order], ids[order], scores[order]
        first = np.searchsorted(places, places)
        rank = np.arange(len(places)) - first
        last = rank == self.k - 1
        self.floor[places[last]] = scores[last]
        self.best = [c[rank < self.k] for c in (places, ids, scores)]


def _blocks(dim: int, kind: np.dtype):
    """Packs rows (id, x, norm) of a partition, in their order, into blocks: ids and components as bytes, the greatest norm, and a number by which blocks are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        turn = count(TaskContext.get().partitionId())
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield packed(whole.slice(0, BLOCK), next(turn))
                rows -= BLOCK
                held = whole.slice(BLOCK).to_batches()
        if rows:
            yield packed(pa.Table.from_batches(held).combine_chunks(), next(turn))

    def packed(part: pa.Table, turn: int) -> pa.RecordBatch:
        x = np.ascontiguousarray(_matrix(part.column("x"), dim).astype(kind))
        columns = pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([part.column("norm").to_numpy().max()]), pa.array([turn])
        return pa.RecordBatch.from_arrays(list(columns), names=["ids", "x", "norm", "turn"])

    return run


def _cells(dim: int, kind: np.dtype, k: int, turn: np.ndarray):
    """Searches the cells of a partition, one after the other; of each the queries come first, then blocks of vectors by descending length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, search = None, [], None
        for batch in batches:
            for at, query, ids_, x_ in zip(*(batch.column(c).to_pylist() for c in ("cell", "query", "ids", "x")), strict=True):
                if at != cell:
                    if search:
                        yield from answers(search)
                    cell, asked, search = at, [], None
                ids, x = np.frombuffer(ids_, np.int64), np.frombuffer(x_, kind).reshape(-1, dim).astype(np.float64)
                if query:
                    asked.append((ids, x))
                    continue
                if search is None and asked:
                    search = Search(np.concatenate([i for i, _ in asked]), np.concatenate([v for _, v in asked]), turn, k)
                    asked = []
                if search:
                    order = np.argsort(-np.square(x).sum(axis=1), kind="stable")
                    search.see(ids[order], x[order])
        if search:
            yield from answers(search)

    def answers(search: Search) -> Iterator[pa.RecordBatch]:
        places, ids, scores = search.best
        for at in range(0, len(places), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[places[part]]), pa.array(ids[part]), pa.array(scores[part].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", asked: int = ASKED, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of the greatest inner product.

    Products are of floor(scale * component) in whole numbers. Ties go to the smaller id. Rows with a null id, and vectors that are null or hold a null or non-finite component, take no part;
    shorter vectors count as filled up with zeros. Equal vectors have equal scores, and only those of the k + 1 least ids can be answers to a query, k
    rows of each, so of a large group of them no more are kept. Rows that repeat an id are candidates each; as a query
    equal ones are one, unlike ones share one list of k, and neither is an answer to the other. A query alone in its table has no row.

    Vectors are sorted by descending length over the whole table and packed into blocks. Every cell of a grid holds up to `asked` queries and sees one of `parts` parts of the
    blocks, the longest first, so that its queries' bounds rise fast; it hands on k rows of each query. A cell holds its queries, one block and k answers of each query.
    """
    rows = durable(quantized(vectors, id_col, vector_col, scale))
    least, most = F.coalesce(F.array_min("x"), F.lit(0)), F.coalesce(F.array_max("x"), F.lit(0))
    dim, low, high, n = rows.agg(F.max(F.size("x")), F.min(least), F.max(most), F.count(F.when(F.col("id") % every == 0, 1))).first()
    dim = dim or 1
    kind = np.dtype(np.int16 if max(-(low or 0), high or 0) < 1 << 15 else np.int64)
    turn = rotation(rows, dim)
    # of equal vectors the k + 1 least ids, and k rows of each; each task keeps that many before they are shuffled
    repeat = F.row_number().over(Window.partitionBy("norm", "x", "id").orderBy("id"))
    place = F.dense_rank().over(Window.partitionBy("norm", "x").orderBy("id"))
    longest = rows.withColumn("repeat", repeat).where(F.col("repeat") <= k).drop("repeat").withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    bands = max(1, -(-n // asked))
    blocks = "ids binary, x binary, norm double, turn long"
    queries = rows.where(F.col("id") % every == 0).distinct().mapInArrow(_blocks(dim, kind), blocks)
    questions = queries.select(F.pmod("turn", F.lit(bands)).alias("band"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("query"), "ids", "x", "norm")
    ordered = longest.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id").mapInArrow(_blocks(dim, kind), blocks)
    seen = ordered.select(F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), F.pmod("turn", F.lit(parts)).alias("part"), F.lit(False).alias("query"), "ids", "x", "norm")
    cells = questions.unionByName(seen).withColumn("cell", (F.col("band") * parts + F.col("part")).cast("int"))
    cells = cells.repartitionById(bands * parts, "cell").sortWithinPartitions("cell", F.desc("query"), F.desc("norm"))
    found = cells.select("cell", "query", "ids", "x").mapInArrow(_cells(dim, kind, k, turn), "query_id long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The rows of top_k in SQL, over the table `embeddings`.
TOP_K_SQL = """
WITH fit AS (
  SELECT vec_id, [CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([c for c in embedding if c IS NULL OR isnan(c) OR isinf(c)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, x FROM fit WHERE vec_id % 20 = 0) q JOIN fit v ON q.vec_id <> v.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
