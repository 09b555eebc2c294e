"""Changes of files as they settle: a file counts once it has been left alone for a while, and then as created, modified or deleted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGED = "path string, modified timestamp, digest string, change string, version long"
STATE = "version long, there boolean, times array<long>, digests array<string>, gone array<boolean>"


def wanted(events: DataFrame, ending: str = ".md") -> DataFrame:
    """Events of files with a name's ending, each state of a file once: the same path and time mean the same file."""
    return events.where(F.col("path").endswith(ending) & F.col("modified").isNotNull())


def settled(events: DataFrame, quiet: int) -> DataFrame:
    """(path, modified, digest, change, version) of a table of (path, modified, digest, deleted).

    Events of a path that follow one another within `quiet` seconds are one change, of which the last counts. It is `created` at first and after a deletion, else `modified`; `deleted` if the file is gone at its end, unless it wasn't
    there. Versions count a path's changes from 1. Runs of events are folded in the tasks that read them before paths are put in order.
    """
    last = F.struct("modified", F.coalesce("deleted", F.lit(False)).alias("deleted"), "digest")
    runs = events.groupBy("path", F.session_window("modified", f"{quiet} seconds")).agg(F.max(last).alias("last")).select("path", "last.*")
    by = Window.partitionBy("path").orderBy("modified")
    before = F.coalesce(F.lag(~F.col("deleted")).over(by), F.lit(False))  # of two deletions that follow one another the second is of nothing
    change = F.when(~F.col("deleted"), F.when(before, "modified").otherwise("created")).when(before, "deleted")
    told = runs.withColumn("change", change).where("change IS NOT NULL")
    return told.select("path", "modified", "digest", "change", F.row_number().over(by).cast("long").alias("version"))


def settled_stream(events: DataFrame, quiet: int, late: str) -> DataFrame:
    """The same of a stream, whose events may come as late as `late`: a change is told once no event can belong to it any more.

    A path's state is its last version, whether the file is there, and those events that may still change; of a run that goes on, only the latest event that can't be preceded is kept.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, there, times, digests, gone = state.get if state.exists else (0, False, [], [], [])
        waiting = set(zip(times, gone, digests, strict=True))
        for f in frames:
            at = f["modified"].astype("datetime64[us]").astype("int64") if len(f) else []
            waiting.update(zip((int(x) for x in at), (bool(x) for x in f["deleted"].fillna(False)), (d if isinstance(d, str) else None for d in f["digest"]), strict=True))
        past = state.getCurrentWatermarkMs() * 1000
        rows, run = [], []
        ordered = sorted(waiting, key=lambda e: (e[0], e[1], e[2] is not None, e[2] or ""))
        width = quiet * 1_000_000
        for i, event in enumerate(ordered):
            run.append(event)
            following = ordered[i + 1][0] if i + 1 < len(ordered) else None
            if following is not None and following <= event[0] + width or past <= event[0] + width:
                if following is not None and following <= event[0] + width:
                    continue
                break
            at, is_gone, digest = event
            run = []
            if not is_gone or there:
                version += 1
                rows.append((key[0], pd.Timestamp(at, unit="us"), digest, "deleted" if is_gone else "modified" if there else "created", version))
            there = not is_gone
        done = len(ordered) - len(run) - (len(ordered) - i - 1 if ordered and run else 0)
        kept = ordered[done:] if run else []
        settled_at = [e for e in kept if e[0] < past]
        kept = settled_at[-1:] + [e for e in kept if e[0] >= past]
        state.update((version, there, [e[0] for e in kept], [e[2] for e in kept], [e[1] for e in kept]))
        if kept:
            state.setTimeoutTimestamp(max((kept[-1][0] + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["path", "modified", "digest", "change", "version"])

    rows = events.withWatermark("modified", late).groupBy("path")
    return rows.applyInPandasWithState(step, CHANGED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
