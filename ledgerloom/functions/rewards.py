"""What an answer is worth, judged by its words alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that show uncertainty, completeness, hedging and confidence, words of a question that don't count, charges that are no products, ways to state a count, words that contradict each other, and what each part gives.
UNCERTAIN = ("i don't know", "not sure", "unclear", "cannot determine", "insufficient information", "no information", "unable to answer")
COMPLETE = ("based on", "according to", "specifically", "in particular", "for example", "such as")
HEDGING, CONFIDENT = ("maybe", "perhaps", "possibly", "might", "could be"), ("is", "are", "includes", "provides", "demonstrates")
STOP = ("what", "is", "the", "a", "an", "how", "why", "when", "where", "who", "which", "are", "do", "does")
PRODUCT_QUESTIONS, COUNT_QUESTIONS = ("product", "electronic", "item", "bought", "purchased"), ("how many", "count", "number of", "total")
CHARGES = (
    "shipping", "delivery", "freight", "postage", "handling", "tax", "vat", "gst", "duty", "customs", "fee", "charge", "surcharge", "service charge", "discount", "rebate", "refund", "insurance",
    "warranty fee", "frais", "livraison", "expédition",
)
COUNTS = (r"total\s+(?:of\s+)?(\d+)", r"(\d+)\s+(?:electronic\s+)?(?:product|item)s?", r"purchased\s+(\d+)", r"bought\s+(\d+)")
CONTRADICTIONS = (("all", "some"), ("always", "sometimes"), ("never", "occasionally"), ("complete", "incomplete"), ("total", "partial"))
LENGTHS = ((20, 0.0), (50, 0.08), (501, 0.2), (1001, 0.16))
LONGER = 0.12


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _number(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words))


def length_score(answer: Column) -> Column:
    n = F.length(F.trim(answer))
    score = F.when(n < LENGTHS[0][0], LENGTHS[0][1])
    for below, value in LENGTHS[1:]:
        score = score.when(n < below, value)
    return score.otherwise(LONGER)


def completeness_score(answer: Column) -> Column:
    return F.when(_any(answer, UNCERTAIN), 0.0).otherwise(F.least(F.lit(0.2), 0.08 * _number(answer, COMPLETE)))


def confidence_score(answer: Column) -> Column:
    hedging, confident = _number(answer, HEDGING), _number(answer, CONFIDENT)
    return F.when(hedging > confident, 0.08).when(confident > 0, 0.2).otherwise(0.12)


def relevance_score(answer: Column, question: Column) -> Column:
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0)))
    asked = F.array_except(words(question), F.array(*map(F.lit, STOP)))
    return F.when(F.size(asked) == 0, 0.12).otherwise(F.least(F.lit(0.2), 0.4 * F.size(F.array_intersect(asked, words(answer))) / F.size(asked)))


def consistency_score(answer: Column, question: Column, written: Column) -> Column:
    """0.2 less what contradicts: charges in a list of products, a stated count that isn't the list's, words against each other. written is the answer in its own letter case."""
    listed = F.regexp_extract_all(written, F.lit(r"(?m)^\s*\d+[.)]\s+(.+)$"), F.lit(1))
    charges = F.size(F.filter(listed, lambda x: _any(F.lower(x), CHARGES)))
    charged = F.when(_any(question, PRODUCT_QUESTIONS), F.least(F.lit(0.1), 0.05 * charges)).otherwise(0.0)
    items = F.greatest(F.regexp_count(written, F.lit(r"(?m)^\s*\d+[.)]\s+")), F.regexp_count(written, F.lit(r"(?m)^\s*[-*•]\s+")))
    stated = F.coalesce(*(F.regexp_extract(answer, p, 1).try_cast("long") for p in COUNTS))
    counted = F.when(_any(question, COUNT_QUESTIONS) & (items > 0) & (stated != items), 0.15).otherwise(0.0)
    against = F.when(reduce(lambda a, b: a | b, (answer.contains(x) & answer.contains(y) for x, y in CONTRADICTIONS)), 0.05).otherwise(0.0)
    return F.greatest(0.2 - charged - counted - against, F.lit(0.0))


def answer_reward(answer: Column, question: Column) -> Column:
    """From 0 to 1, a fifth each for an answer's length, completeness, confidence, relevance to the question, and consistency; 0 for a missing or blank answer. A missing question asks for nothing."""
    low, asked = F.lower(answer), F.lower(F.coalesce(question, F.lit("")))
    total = length_score(answer) + completeness_score(low) + confidence_score(low) + relevance_score(low, asked) + consistency_score(low, asked, answer)
    return F.when(F.coalesce(F.length(F.trim(answer)), F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), total))
