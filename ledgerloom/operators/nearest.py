"""The best entry of each question by cosine, exact and without rows for pairs: entries that hardly differ first, by the cells of a grid; the rest in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType

from ledgerloom.session import durable

#: Parts of the entries at least; entries of a part; questions that are held at once.
PARTS, PART, BAND = 16, 1 << 16, 1 << 14
#: Scores that are held at once.
HELD = 1 << 22
#: What rounding can change of a cosine.
SLACK = 1e-9
#: From this cosine on an entry is found through the grid.
SURE = 1 - 1e-9
#: The greatest distance of unit vectors of such a cosine.
REACH = float(np.sqrt(2 * (1 - SURE + 2 * SLACK)))
#: Axes of the grid, and the width of a cell times the square root of the dimension.
AXES, WIDTH = 8, 0.4
#: The cell of vectors that may be near to any: those with NaN or infinity, and those whose squares leave the range of doubles.
ODD = 0


def _matrix(values: pa.Array, size: int) -> np.ndarray:
    """Vectors of one size as rows."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), size)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products, added one after another, as scoring.cosine adds them."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero stays, and rows that are odd are NaN."""
    with np.errstate(all="ignore"):
        square = np.square(x).sum(axis=1)
        unit = x / np.sqrt(square)[:, None]
        unit[~((square > 1e-200) & (square < 1e200))] = np.nan
    unit[~x.any(axis=1)] = 0.0
    return unit


def _cells(reach: float):
    """The cells of the grid that hold a vector, or anything within reach of it; of an odd one ODD."""

    def run(vectors: pd.Series) -> pd.Series:
        found: list[list[int]] = [[ODD]] * len(vectors)
        sizes = vectors.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            random = np.random.default_rng(int(size))
            axes = random.standard_normal((size, AXES))
            axes /= np.linalg.norm(axes, axis=0)
            weight = random.integers(1, 1 << 62, AXES) * 2 + 1
            unit = _unit(np.vstack(vectors.iloc[at].to_numpy()).astype(np.float64))
            even = np.flatnonzero(~np.isnan(unit).any(axis=1))
            place, near = unit[even] @ axes * (np.sqrt(size) / WIDTH), reach * np.sqrt(size) / WIDTH
            low, high = np.floor(place - near).astype(np.int64), np.floor(place + near).astype(np.int64)
            with np.errstate(over="ignore"):
                first = (low * weight).sum(axis=1)
                for i, key, more in zip(at[even], first, high > low, strict=True):
                    cells = [key]
                    for w in weight[more]:
                        cells += [c + w for c in cells]
                    found[i] = [int(c) for c in cells]
        return pd.Series(found)

    return F.pandas_udf(run, "array<long>")


class Asked:
    """Questions of one group, with the best entry of each among those seen so far; entries come in the order of their ids."""

    def __init__(self, rows: list[pa.RecordBatch], size: int):
        asked = pa.Table.from_batches(rows).combine_chunks()
        self.ids, self.size = asked.column("question_id").to_pylist(), size
        self.x = _matrix(asked.column("embedding").combine_chunks(), size)
        self.unit, self.length = _unit(self.x), np.sqrt(_dot(self.x, self.x))
        self.least = asked.column("least").to_numpy()
        self.may = [frozenset(d) for d in asked.column("documents").to_pylist()]
        self.score, self.entry = np.full(len(self.ids), np.nan), [None] * len(self.ids)
        self.worth = np.full(len(self.ids), -np.inf)  # the score, but NaN is above all

    def see(self, rows: pa.RecordBatch) -> None:
        y = _matrix(rows.column("embedding"), self.size)
        unit, length = _unit(y), np.sqrt(_dot(y, y))
        made_of = None
        width = max(1, HELD // len(y))
        for at in range(0, len(self.ids), width):
            least = np.maximum(self.least, self.worth)[at : at + width] - SLACK
            likeness = self.unit[at : at + width] @ unit.T
            places, entries = np.nonzero(~(likeness < least[:, None]))
            if not len(places):
                continue
            made_of = made_of or [frozenset(d) for d in rows.column("documents").to_pylist()]
            values = likeness[places, entries]
            values[np.isnan(values)] = np.inf
            order = np.lexsort((-values, places))
            starts = np.searchsorted(places, np.unique(places))
            for run in np.split(order, starts[1:]):
                self._take(at + places[run[0]], entries[run], values[run], y, length, made_of, rows)

    def _take(self, q: int, entries: np.ndarray, values: np.ndarray, y: np.ndarray, length: np.ndarray, made_of: list, rows: pa.RecordBatch) -> None:
        """Scores those of the entries, the likest first, that may be the best of what the asker may read."""
        may, fit, best = self.may[q], [], -np.inf
        for e, value in zip(entries.tolist(), values.tolist(), strict=True):
            if value < best - SLACK:
                break
            if made_of[e] <= may:
                fit.append(e)
                best = value if value < np.inf else best
        if not fit:
            return
        fit = np.sort(fit)
        with np.errstate(all="ignore"):
            lengths = self.length[q] * length[fit]
            score = np.where((lengths > 0) | np.isnan(lengths), _dot(y[fit], self.x[q : q + 1]) / lengths, 0.0)
        worth = np.where(np.isnan(score), np.inf, score)
        i = int(np.argmax(worth))
        if worth[i] >= self.least[q] and worth[i] > self.worth[q]:
            self.worth[q], self.score[q], self.entry[q] = worth[i], score[i], rows.column("entry_id")[int(fit[i])].as_py()


def _best(types: list[pa.DataType]):
    """Goes through groups, one after the other; of each the questions come first, then the entries by their ids."""

    def answers(asked: Asked) -> pa.RecordBatch:
        hit = np.flatnonzero(asked.worth > -np.inf)
        columns = [asked.ids[i] for i in hit], [asked.entry[i] for i in hit], asked.score[hit]
        return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=False) for c, t in zip(columns, types, strict=True)], names=["question_id", "entry_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, asked = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("part").to_pylist(), batch.column("near").to_pylist(), strict=True))
            entry = batch.column("entry").to_numpy(zero_copy_only=False)
            changes = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1] or entry[i] != entry[i - 1]]
            for start, stop in zip(changes, [*changes[1:], len(keys)], strict=True):
                if entry[start] and keys[start] != group:
                    continue
                rows = batch.slice(start, stop - start)
                if entry[start]:
                    asked = asked or Asked(held, len(rows.column("embedding")[0]))
                    asked.see(rows)
                    continue
                if keys[start] != group:
                    if asked:
                        yield answers(asked)
                    group, held, asked = keys[start], [], None
                held.append(rows)
        if asked:
            yield answers(asked)

    return run


def _met(asked: DataFrame, entries: DataFrame, parts: int | None) -> DataFrame:
    """(question_id, entry_id, score) of the best entries of each part. Both sides have `part` and `near`, in which they must be equal; parts, if given, are dealt by their number, else by both."""
    question, entry = asked.schema["question_id"].dataType, entries.schema["entry_id"].dataType
    common = ["part", "near", "embedding", "documents"]
    left = asked.select(*common, "question_id", "least", F.lit(None).cast(entry).alias("entry_id"), F.lit(False).alias("entry"))
    right = entries.select(*common, F.lit(None).cast(question).alias("question_id"), F.lit(None).cast("double").alias("least"), "entry_id", F.lit(True).alias("entry"))
    rows = left.unionByName(right)
    rows = rows.repartition("part", "near") if parts is None else rows.repartitionById(parts, "part")
    rows = rows.sortWithinPartitions("part", "near", "entry", F.asc_nulls_last("entry_id"))
    types = [to_arrow_type(question), to_arrow_type(entry), pa.float64()]
    schema = f"question_id {question.simpleString()}, entry_id {entry.simpleString()}, score double"
    return rows.select("part", "near", "entry", "question_id", "entry_id", "embedding", "documents", "least").mapInArrow(_best(types), schema)


def _even(vectors: DataFrame, documents: str) -> DataFrame:
    """Vectors that have a cosine, with the documents as texts: no null, and at least one component."""
    kind = vectors.schema["embedding"].dataType
    x = F.col("embedding") if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col("embedding").cast("array<double>")
    fit = vectors.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull()) & F.col(documents).isNotNull())
    return fit.withColumn("embedding", x).withColumn("documents", F.col(documents).cast("array<string>"))


def nearest(questions: DataFrame, entries: DataFrame, by: list[str], least: Column) -> DataFrame:
    """(question_id, entry_id, score): of each question the entries among which is the best one that equals it in the columns `by`, whose cosine is `least`, above 0, or more, and whose source_ids are all in the question's `allowed`.

    questions: question_id, *by, embedding, allowed. entries: entry_id, *by, embedding, source_ids. Scores are those of scoring.cosine to the last bit, and of equal ones the smaller entry_id is best, null last.
    NaN is a score above all others, as it is to Spark.

    Of entries that differ in their ids alone only the least can be best, so the others go. Where a question has an entry of a cosine of at least SURE, all better ones are as near, and thus in a cell
    of a grid over random axes that the question reaches (at most 2^AXES cells, hardly ever more than one or two). What the grid doesn't answer meets all entries of its group: a band of
    questions passes a part of the entries as products of matrices, so that neither side is ever whole in a task and no pair is a row.
    """
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    near = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in by), F.size("embedding").alias("size")))
    asked = _even(questions.where(known), "allowed").withColumn("least", least).withColumn("near", near).select("question_id", "embedding", "documents", "least", "near")
    asked = durable(asked.withColumn("cells", _cells(REACH)(F.col("embedding"))))
    held = _even(entries.where(known), "source_ids").withColumn("near", near)
    held = durable(held.groupBy("near", "embedding", "documents").agg(F.min("entry_id").alias("entry_id")))

    cell = lambda c: F.concat_ws(" ", c.cast("string"), "near")
    part = F.pmod(F.xxhash64("entry_id"), F.lit(PARTS)).cast("int")
    probes = asked.withColumn("cell", F.explode(F.array_distinct(F.array_append("cells", F.lit(ODD).cast("long")))))
    probes = probes.where(~F.array_contains("cells", F.lit(ODD).cast("long"))).withColumn("least", F.greatest("least", F.lit(SURE)))
    probes = probes.withColumn("near", cell(F.col("cell"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = held.withColumn("near", cell(F.element_at(_cells(0.0)(F.col("embedding")), 1))).withColumn("part", part)
    first = durable(_met(probes, placed, None))

    odd = F.array_contains("cells", F.lit(ODD).cast("long"))
    left = durable(asked.where(odd).unionByName(asked.where(~odd).join(first.select("question_id").distinct(), "question_id", "left_anti")))
    bands = -(-left.count() // BAND)
    if not bands:
        return first
    parts = max(PARTS, -(-held.count() // PART))
    band = F.pmod(F.xxhash64("question_id", "embedding"), F.lit(bands))
    part = F.pmod(F.xxhash64("entry_id"), F.lit(parts))
    dealt = lambda b, p: (b * parts + p).cast("int")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", dealt(band, F.col("part")))
    rest = held.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("part", dealt(F.col("band"), part))
    return first.unionByName(_met(left, rest, bands * parts))
