"""Questions in words: what they ask for, found by keywords, and the structured question that they become."""

from __future__ import annotations

import re
from datetime import date

from ledgerloom.functions.dates import named_range
from ledgerloom.operators.analytics import Spec

# Words that name a grouping, an aggregate, an intent, or a message that no cache answers.
GROUP_WORDS = {
    "year": ("by year", "per year", "yearly", "annual"), "quarter": ("by quarter", "per quarter", "quarterly"), "month": ("by month", "per month", "monthly"),
    "category": ("by category", "per category"), "entity": ("by vendor", "per vendor", "by customer", "per customer", "by company", "by entity"),
    "product": ("by product", "per product"), "region": ("by region", "per region"), "status": ("by status", "per status"),
}
AGGREGATES = (("avg", ("average", "avg", "mean")), ("count", ("how many", "count", "number of")), ("max", ("max", "highest", "largest", "most expensive")), ("min", ("min", "lowest", "smallest", "cheapest")), ("sum", ("sum", "total")))
ANALYTICS_WORDS = ("total", "sum", "average", "how many", "count", "by month", "per", "highest", "lowest", "compare", "trend", "breakdown")
SEARCH_WORDS = ("find", "search", "show me", "which document", "what does", "explain", "where is", "look for")
GREETINGS = ("hello", "hi", "hey", "thanks", "thank you", "good morning", "good afternoon", "who are you", "what can you do", "help")
GLOBAL_WORDS = ("relationship", "between", "connected", "related to", "compare", "overall", "themes", "trend")
LOCAL_WORDS = ("who is", "what is", "define", "details of", "tell me about", "describe")
MIN_WORDS, MAX_WORDS = r"\b(?:min|minimum|lowest|smallest|least|cheapest)\b", r"\b(?:max|maximum|highest|largest|most|greatest)\b"
DISSATISFIED = (
    ("incorrect", ("wrong", "incorrect", "not right", "mistake")), ("unclear", ("unclear", "don't understand", "confusing")),
    ("refresh", ("refresh", "again", "update the")), ("verification", ("are you sure", "double check", "verify")),
)
DEPENDENT = r"\b(?:it|that|those|these|they|them|this one|the same|previous|above)\b"


def groupings(question: str) -> tuple[str, ...]:
    """Names of the groupings in the order in which the question mentions them."""
    q = question.lower()
    found = [(min(q.find(w) for w in words if w in q), name) for name, words in GROUP_WORDS.items() if any(w in q for w in words)]
    return tuple(name for _, name in sorted(found))


def aggregate(question: str) -> str:
    """The aggregate that a question asks for: avg before count, max, min and sum, which is also the one without any word."""
    q = question.lower()
    return next((name for name, words in AGGREGATES if any(w in q for w in words)), "sum")


def bounds(question: str) -> tuple[float | None, float | None]:
    """Least and greatest amount of `over $100` and `under $500`; both are inclusive."""
    q = question.lower().replace(",", "")
    number = lambda words: (m := re.search(rf"\b(?:{words})\s+\$?\s*(\d+(?:\.\d+)?)", q)) and float(m[1])
    return number("over|above|more than|greater than|at least"), number("under|below|less than|at most")


def spec_of(question: str, today: date = date(2026, 1, 1), amount: str = "total_amount") -> Spec:
    """The structured question of a phrase."""
    span = named_range(question, today)
    least, most = bounds(question)
    return Spec(
        start=span[0] if span else None, end=span[1] if span else None, group_by=groupings(question),
        least={amount: least} if least is not None else {}, most={amount: most} if most is not None else {},
    )


def intent(question: str) -> tuple[str, float]:
    """analytics, search, hybrid or general, and how sure that is: 0.6 and 0.1 for each word found, 0.85 at most."""
    q = question.lower()
    count = lambda words: sum(w in q for w in words)
    numbers, searches = count(ANALYTICS_WORDS), count(SEARCH_WORDS)
    if is_greeting(question) or not numbers + searches:
        return "general", 0.6
    name = "hybrid" if numbers and searches else "analytics" if numbers else "search"
    return name, min(0.85, 0.6 + 0.1 * max(numbers, searches))


def is_greeting(message: str) -> bool:
    m = message.lower().strip(" !.?")
    return m in GREETINGS or any(m.startswith(f"{g} ") and len(m.split()) <= 4 for g in GREETINGS)


def retrieval_mode(question: str) -> str:
    """global for questions about relations, local for those about one thing, else hybrid."""
    q = question.lower()
    return "global" if any(w in q for w in GLOBAL_WORDS) else "local" if any(w in q for w in LOCAL_WORDS) else "hybrid"


def asks_extremes(question: str) -> bool:
    """Whether a question asks for the least and for the greatest."""
    q = question.lower()
    return bool(re.search(MIN_WORDS, q) and re.search(MAX_WORDS, q))


def report_kind(question: str) -> str:
    q = question.lower()
    if any(w in q for w in ("detail", "list", "each", "line item", "every")):
        return "detail"
    return "count" if any(w in q for w in ("how many", "count")) else "summary"


def dissatisfaction(message: str) -> str | None:
    """The kind of discontent with the last answer; only `incorrect` takes it out of the cache."""
    m = message.lower()
    return next((kind for kind, words in DISSATISFIED if any(w in m for w in words)), None)


def cacheable(message: str) -> bool:
    """A message that stands by itself, is no greeting and no complaint."""
    return not (dissatisfaction(message) or is_greeting(message) or re.search(DEPENDENT, message.lower()))


def sub_questions(question: str) -> list[str]:
    """Parts of a question that `and`, `also` or a question mark divides; the parts of one list of aggregates stay together."""
    parts = [p.strip() for p in re.split(r"\?|;|\band also\b|\bthen\b|\balso\b", question) if p.strip()]
    return parts or [question]


def fused(questions: list[str]) -> tuple[str, ...]:
    """The aggregates of several questions over the same rows, for one pass: each once, in the order of mention."""
    return tuple(dict.fromkeys(aggregate(q) for q in questions))
