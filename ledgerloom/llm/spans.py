"""Spans of pattern matches in texts, in DataFrame functions: where each match lies, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose lengths are added up at once.
STEP = 128
#: Code points before a match that are kept as its context.
CONTEXT = 40

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,context:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _before(steps: Column, i: Column) -> Column:
    """Sum of the first i steps, by whole runs of STEP and the rest; steps is a struct of the runs' sums and of the steps."""
    whole = F.floor(i / STEP).cast("int")
    add = lambda a, x: a + x
    return F.aggregate(F.slice(steps["runs"], F.lit(1), whole), F.lit(0), add) + F.aggregate(F.slice(steps["one"], whole * STEP + 1, i % STEP), F.lit(0), add)


def found(text: Column, kind: str, rank: int, pattern: str, possible: Column | None = None, group: int = 0) -> Column:
    """The leftmost non-overlapping matches of a pattern as an array of SPAN; value is the group's text.

    The text is split at the matches, and a match starts behind the texts between and the matches before it. possible is a cheaper test that no text with
    a match fails.
    """
    count = lambda arrays: F.size(arrays["whole"])
    arrays = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("between"),
    )

    def placed(a: Column) -> Column:
        one = F.transform(a["whole"], lambda w, i: F.length(w) + F.length(F.get(a["between"], i)))
        runs = lambda s: F.transform(F.sequence(F.lit(0), F.floor((count(a) - 1) / STEP).cast("int")), lambda r: F.aggregate(F.slice(s, r * STEP + 1, F.lit(STEP)), F.lit(0), lambda x, y: x + y))
        return let(one, lambda s: let(F.struct(runs(s).alias("runs"), s.alias("one")), lambda steps: F.transform(a["whole"], lambda w, i: span(a, steps, w, i))))

    def span(a: Column, steps: Column, whole: Column, i: Column) -> Column:
        between = F.get(a["between"], i)
        start = _before(steps, i) + F.length(between)
        return let(start, lambda at: F.struct(
            at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(whole)).alias("end"), F.lit(kind).alias("kind"), F.get(a["value"], i).alias("value"),
            F.substring(between, -CONTEXT, CONTEXT).alias("context"),
        ))

    test = text.rlike(pattern) if possible is None else possible & text.rlike(pattern)
    return F.when(test, let(arrays, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def written(spans: Column) -> Column:
    """kind:start:end of the spans by start, then rank, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
