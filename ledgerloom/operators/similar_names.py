"""Names that mean the same: a similarity join that compares only names which share a subsequence or a segment, and one representative for those that are alike."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import ALIKE
from ledgerloom.session import durable

#: Names are met by all that is left of them without their unmatched characters, if that is at most so many texts a name, else by their parts.
MOST_TEXTS = 500


def common(a: str, b: str) -> int:
    """Length of a longest common subsequence: each character of b moves the whole table of a, kept as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def slack(a: int, b: int, least: int) -> int:
    """The most characters that names of lengths a and b may leave unmatched; insertions and deletions differ by b - a, so its parity is theirs."""
    most = (100 - least) * (a + b) // 100
    return most - (most - b + a) % 2


def segments(length: int, parts: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of so many nearly equal parts."""
    for i in range(parts):
        yield length * i // parts, length * (i + 1) // parts


def matched(a: int, b: int, least: int) -> int | None:
    """How many characters names of lengths a and b have in common at least, if they are met by subsequences of this length; else None."""
    most = slack(a, b, least)
    size = (a + b - most) // 2
    return size if most >= 0 and max(comb(a, size), comb(b, size)) <= MOST_TEXTS else None


def subsequences(name: str, sizes: Collection[int]) -> set[str]:
    return {"".join(x) for size in sizes for x in combinations(name, size)}


def kept_segments(name: str, least: int, lengths: Collection[int] | None = None) -> list[str]:
    """Keys of a name as the shorter, or equally long, one of a pair: for each length b of the other, of those that there are, the subsequences of which one at least is the other's too, or the parts of which
    one at least stands whole in it.

    Each unmatched character spoils one part at most, so one more parts than these are enough.
    """
    a, keys, sizes = len(name), set(), set()
    for b in range(a, a * (200 - least) // least + 1):
        if slack(a, b, least) < 0 or lengths is not None and b not in lengths:
            continue
        if (size := matched(a, b, least)) is not None:
            sizes.add(size)
        else:
            keys.update(f"{a} {b} {i} {name[s:e]}" for i, (s, e) in enumerate(segments(a, slack(a, b, least) + 1)))
    return [*keys, *subsequences(name, sizes)]


def sought_segments(name: str, least: int, lengths: Collection[int] | None = None) -> list[str]:
    """Keys of a name as the longer one: for each length a of the other, the subsequences, or the texts that stand where a whole part of it can stand here. A part moves left by as many characters as are unmatched in the
    shorter name, and right by as many as are unmatched in this one."""
    b, keys, sizes = len(name), set(), set()
    for a in range(-(-b * least // (200 - least)), b + 1):
        most = slack(a, b, least)
        if most < 0 or lengths is not None and a not in lengths:
            continue
        if (size := matched(a, b, least)) is not None:
            sizes.add(size)
        else:
            left, right = (most - b + a) // 2, (most + b - a) // 2
            for i, (s, e) in enumerate(segments(a, most + 1)):
                keys.update(f"{a} {b} {i} {name[at : at + e - s]}" for at in range(max(0, s - left), min(b - (e - s), s + right) + 1))
    return [*keys, *subsequences(name, sizes)]


def lengths_of(names: DataFrame, name: str) -> frozenset[int]:
    """The different lengths of names, of which there are few."""
    return frozenset(r[0] for r in names.select(F.length(name)).distinct().collect())


def similar_names(names: DataFrame, name: str = "name", within: tuple[str, ...] = (), least: int = ALIKE) -> DataFrame:
    """(within.., first, second, ratio): every pair of different names of a group whose ratio, 200 times their longest common subsequence over both lengths, is at least `least`; first is the shorter, then smaller one.

    Names meet by key alone, so names without a common subsequence of the length that likeness needs, or, where a name has too many of those, a common segment, are never compared; each pair is compared once,
    in the tasks that its group and names are dealt over. Keys are shuffled with a name's number in place of the name. Equal names are one. Null names take no part, an empty one has no partner; a null group is a group.
    A name has keys in number of about the square of its length, and up to MOST_TEXTS for each length, which suits names, not texts.
    """
    if not 67 <= least <= 100:
        raise ValueError("least is 67 to 100: below, parts of a name are shorter than a character")
    one = durable(names.where(F.col(name).isNotNull() & (F.col(name) != "")).select(*within, F.col(name).alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()))
    lengths = lengths_of(one, "name")
    kept = F.pandas_udf(lambda s: s.map(lambda x: kept_segments(x, least, lengths)), "array<string>")
    sought = F.pandas_udf(lambda s: s.map(lambda x: sought_segments(x, least, lengths)), "array<string>")
    groups = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in within] + [F.col(g).isNull() for g in within]
    key = F.xxhash64(*groups, "key").alias("key")
    index = one.select(*within, F.col("id").alias("first_id"), F.explode(kept("name")).alias("key")).select("first_id", key)
    probe = one.select(*within, F.col("id").alias("second_id"), F.explode(sought("name")).alias("key")).select("second_id", key)
    # neither side may be broadcast: keys are far more than Spark's estimate, which is that of the names
    met = index.hint("merge").join(probe.hint("merge"), "key").where("first_id <> second_id").select("first_id", "second_id").distinct()
    first = one.select(*within, F.col("id").alias("first_id"), F.col("name").alias("first"))
    second = one.select(*(F.col(g).alias(f"_{g}") for g in within), F.col("id").alias("second_id"), F.col("name").alias("second"))
    ordered = (F.length("first") < F.length("second")) | (F.length("first") == F.length("second")) & (F.col("first") < F.col("second"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in within), F.lit(True))
    met = met.join(first, "first_id").join(second, "second_id").where(ordered & same)

    @F.pandas_udf("long")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    both = F.length("first") + F.length("second")
    scored = met.withColumn("lcs", lcs("first", "second"))
    return scored.where(200 * F.col("lcs") >= least * both).select(*within, "first", "second", (F.lit(200.0) * F.col("lcs") / both).alias("ratio"))


def representatives(names: DataFrame, order: str, name: str = "name", within: tuple[str, ...] = (), least: int = ALIKE) -> DataFrame:
    """(within.., name, representative) of every different name: names are gone through in order, the first of them and each that is unlike all representatives so far are representatives, and each other one
    belongs to the first representative that it is like.

    A name's order is the least of its rows', then the name itself. Which names are representatives is settled in rounds: a name with no open name before it among those it is like is one, and the names
    that are like it are not. Only pairs of open names pass on from round to round, written to the shared folder; there are as many rounds as the longest chain of names each of which waits for the one before.
    """
    one = names.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(*within, F.col(name).alias("name")).agg(F.min(order).alias("order"))
    one = durable(one.select(*within, "name", F.struct(*within, "name").alias("id"), F.struct("order", "name").alias("place")))
    pairs = similar_names(one, "name", within, least).select(*(F.struct(*within, F.col(n).alias("name")).alias(n) for n in ("first", "second")))
    for n in ("first", "second"):
        pairs = pairs.join(one.select(F.col("id").alias(n), F.col("place").alias(f"{n}_place")), n)
    early = F.col("first_place") < F.col("second_place")
    either = lambda a, b: F.when(early, F.col(a)).otherwise(F.col(b))
    edges = durable(pairs.select(either("first", "second").alias("a"), either("first_place", "second_place").alias("a_place"), either("second", "first").alias("b")))  # a comes before b
    left, gone = edges, []
    while not left.isEmpty():
        heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")), "a", "left_anti")
        gone.append(durable(left.join(heads, "a", "left_semi").select("b").distinct()))
        left = durable(left.join(gone[-1], "b", "left_anti").join(gone[-1].withColumnRenamed("b", "a"), "a", "left_anti"))
    if not gone:
        return one.select(*within, "name", F.col("name").alias("representative"))
    heads = edges.join(reduce(DataFrame.union, gone).withColumnRenamed("b", "a"), "a", "left_anti")
    by = heads.groupBy(F.col("b").alias("id")).agg(F.min("a_place").alias("by"))
    return one.join(by, "id", "left").select(*within, "name", F.coalesce("by.name", "name").alias("representative"))
