"""Plans of several questions that build on one another: checked, put in order, and their partial answers joined to one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    """A part of a question: over which kinds of records it goes, what it needs from others, and how much it matters."""

    name: str
    question: str
    schema_types: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    priority: int = 0


@dataclass(frozen=True)
class Plan:
    """Steps of tasks; those of one step don't need one another."""

    steps: tuple[tuple[Task, ...], ...]
    strategy: str = field(default="parallel")


def planned(tasks: Sequence[Task]) -> Plan:
    """The plan of tasks: each as early as what it needs allows, those of a step by descending priority, then as given. The strategy is parallel if there is one step, sequential if every step has one task, and else mixed.

    Raises ValueError for names that repeat, needs that are no task, and tasks that need one another in a circle.
    """
    by_name = {t.name: t for t in tasks}
    if len(by_name) < len(tasks):
        raise ValueError("two tasks have one name")
    missing = sorted({n for t in tasks for n in t.needs} - set(by_name))
    if missing:
        raise ValueError(f"no task is named {', '.join(missing)}")
    waits = {t.name: set(t.needs) for t in tasks}
    steps = []
    while waits:
        ready = [t for t in tasks if t.name in waits and not waits[t.name]]
        if not ready:
            raise ValueError(f"tasks need one another in a circle: {', '.join(sorted(waits))}")
        steps.append(tuple(sorted(ready, key=lambda t: -t.priority)))
        for t in ready:
            del waits[t.name]
        for rest in waits.values():
            rest -= {t.name for t in ready}
    strategy = "parallel" if len(steps) < 2 else "sequential" if all(len(s) == 1 for s in steps) else "mixed"
    return Plan(tuple(steps), strategy)


def combined(tasks: Sequence[Task], fields: Mapping[str, frozenset[str]]) -> list[Task]:
    """Tasks with one question and the same needs, whose kinds of records have a field in common, as one task over all those kinds, under the first one's name; needs of the others point to it."""
    kept: list[Task] = []
    renamed: dict[str, str] = {}
    shared: dict[str, frozenset[str]] = {}
    for t in tasks:
        own = frozenset.intersection(*(fields.get(s, frozenset()) for s in t.schema_types)) if t.schema_types else frozenset()
        same = next((k for k in kept if (k.question, frozenset(k.needs)) == (t.question, frozenset(t.needs)) and shared[k.name] & own), None)
        if same is None:
            kept.append(t)
            shared[t.name] = own
        else:
            at = kept.index(same)
            kept[at] = Task(same.name, same.question, tuple(dict.fromkeys((*same.schema_types, *t.schema_types))), same.needs, max(same.priority, t.priority))
            shared[same.name] &= own
            renamed[t.name] = same.name
    return [Task(t.name, t.question, t.schema_types, tuple(dict.fromkeys(renamed.get(n, n) for n in t.needs)), t.priority) for t in kept]


def partial(amount: Column) -> list[Column]:
    """What a task hands on, so that its answer can be joined with others': the number of amounts, their exact sum, the least and the greatest."""
    exact = amount.cast("decimal(28,6)")
    return [F.count(amount).alias("n"), F.sum(exact).alias("total"), F.min(amount).alias("least"), F.max(amount).alias("most")]


def fused(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., count, sum, average, least, most) over all partial answers of a group: averages are those of all amounts, not of averages. Without amounts the count is 0 and the rest null."""
    n, total = F.sum("n"), F.sum("total")
    told = [
        F.coalesce(n, F.lit(0)).cast("long").alias("count"), total.cast("double").alias("sum"), F.when(n > 0, total.cast("double") / n).alias("average"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    ]
    return partials.groupBy(*by).agg(*told) if by else partials.agg(*told)


def executed(plan: Plan, answer: Callable[[Task, Mapping[str, DataFrame]], DataFrame]) -> dict[str, DataFrame]:
    """The answer of each task, in the order of the plan; a task is given the answers that it needs. Nothing is run here: answers are plans."""
    answers: dict[str, DataFrame] = {}
    for step in plan.steps:
        answers |= {t.name: answer(t, {n: answers[n] for n in t.needs}) for t in step}
    return answers
