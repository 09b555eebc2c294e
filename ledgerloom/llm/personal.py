"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a span classifier decides; in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.spans import SPAN, counted, found, let, written

#: No match starts inside a run of characters that it could have started with, so that failures cost one look at each run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Candidates that only the classifier can add, by kind.
MORE = {
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}\b",
    "name": r"\b(?:[Mm]y name is|[Nn]ame:|Mrs?\.|Ms\.|Dr\.|Herr|Frau|Mme|Señora?)\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?",
}
ANY_MORE = r"[0-9]{3}[-.][0-9]{2,4}[-.]?[0-9]{0,4}|\b[A-Z]{2}[0-9]{2}|name|Name:|Mrs?\.|Ms\.|Dr\.|Herr|Frau|Mme|Señor"

GIVEN_NAMES = (
    "anna", "antonio", "carlos", "carmen", "claire", "daniel", "david", "elena", "emma", "hans", "heinrich", "james", "jane", "jean",
    "john", "jose", "juan", "klaus", "laura", "linda", "louis", "luis", "maria", "marie", "mary", "michael", "paul", "peter",
    "pierre", "robert", "sarah", "sofia", "sophie", "thomas", "ursula", "wolfgang",
)
CUES = r"(?i)(?:e-?mail|mailto|contact|write|reach|phone|call|tel|mobile|fax|card|visa|account|iban|ssn|social|name|address|\bip\b|host|login|from)[^\n]{0,20}$"
COUNTER_CUES = r"(?i)(?:version|release|order|invoice|isbn|total|figure|table|page|chapter|section|sample|dummy)[^\n]{0,12}$"


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds."""
    small = lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255")))
    parts_fit = lambda s: F.forall(F.split(s["value"], r"\."), small)
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    card_fits = lambda s: let(digits(s), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    phone_fits = lambda s: F.length(digits(s)).between(9, 15)
    return F.concat(
        found(text, "email", 0, EMAIL, text.contains("@")),
        F.filter(found(text, "ip", 1, IP), parts_fit),
        F.filter(found(text, "card", 2, CARD), card_fits),
        F.filter(found(text, "phone", 3, PHONE, text.contains("+")), phone_fits),
    )


def more_spans(text: Column) -> Column:
    """Candidates of the other kinds."""
    spans = F.concat(*(found(text, kind, len(BASE) + i, p) for i, (kind, p) in enumerate(MORE.items())))
    return F.when(text.rlike(ANY_MORE), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def votes(span: Column) -> list[Column]:
    """What each labeler says of a span: 1 for personal, -1 against, 0 for nothing.

    In order: its shape, its words in a gazetteer, a cue before it, a counter-cue before it, and whether its digits vary.
    """
    kind, value, context = span["kind"], span["value"], span["context"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    wrong_id = (kind == "national_id") & value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    strong = kind.isin("email", "card", "phone") | ((kind == "ip") & ~value.rlike(r"^(?:0|127|255)\.")) | ((kind == "national_id") & ~wrong_id) | ((kind == "account") & value.rlike(r"[0-9]{6}"))
    names = "|".join(GIVEN_NAMES)
    return [
        vote(strong, wrong_id | ((kind == "ip") & value.rlike(r"^(?:0|127|255)\."))),
        vote(F.lower(value).rlike(rf"\b(?:{names})\b"), F.lower(value).rlike(r"example\.(?:org|invalid)$|noreply|no-reply|localhost")),
        vote(context.rlike(CUES), F.lit(False)),
        vote(F.lit(False), context.rlike(COUNTER_CUES)),
        F.when(F.length(digits) == 0, 0).when(F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) >= 2, 1).otherwise(-1),
    ]


LABELERS = 5


@dataclass
class Reliabilities:
    """P(vote | personal or not) of each labeler, the share of personal spans of each kind, and what they say of each pattern."""

    likelihood: list[dict[tuple[int, int], float]]
    prior: dict[str, float]
    posterior: dict[tuple, float]


def estimate(patterns: dict[tuple, int], rounds: int = 50) -> Reliabilities:
    """Expectation-maximisation over counted patterns (kind, vote, vote, ...): votes are independent given whether a span is personal.

    It starts from majority votes, and the counts of each vote have one added, so that the meaning of the two classes stays.
    """
    posterior = {p: 1 / (1 + math.exp(-1.5 * sum(p[1:]))) for p in patterns}
    likelihood: list[dict[tuple[int, int], float]] = []
    prior: dict[str, float] = {}
    for _ in range(rounds):
        likelihood = []
        for j in range(LABELERS):
            seen = {(v, c): 1.0 + (2.0 if v == (1 if c else -1) else 0.0) for v in (-1, 0, 1) for c in (0, 1)}
            for p, n in patterns.items():
                seen[p[1 + j], 1] += n * posterior[p]
                seen[p[1 + j], 0] += n * (1 - posterior[p])
            sums = [sum(seen[v, c] for v in (-1, 0, 1)) for c in (0, 1)]
            likelihood.append({(v, c): x / sums[c] for (v, c), x in seen.items()})
        kinds = {p[0] for p in patterns}
        prior = {k: (1 + sum(n * posterior[p] for p, n in patterns.items() if p[0] == k)) / (2 + sum(n for p, n in patterns.items() if p[0] == k)) for k in kinds}
        for p in patterns:
            odds = math.log(prior[p[0]] / (1 - prior[p[0]])) + sum(math.log(likelihood[j][v, 1] / likelihood[j][v, 0]) for j, v in enumerate(p[1:]))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return Reliabilities(likelihood, prior, posterior)


def features(kind: str, votes: Iterable[int]) -> list[str]:
    return ["all", f"kind {kind}", *(f"vote {j} {v}" for j, v in enumerate(votes) if v)]


def train(patterns: dict[tuple, int], truth: dict[tuple, float], steps: int = 400, rate: float = 1.0, decay: float = 0.002) -> dict[str, float]:
    """Weights of a logistic classifier over the kind and the votes, fitted to the estimated truth of the counted patterns; a pattern weighs the root of its count."""
    weights: dict[str, float] = {}
    rows = [(features(p[0], p[1:]), math.sqrt(n), truth[p]) for p, n in patterns.items()]
    total = sum(n for _, n, _ in rows) or 1.0
    for _ in range(steps):
        slope: dict[str, float] = {}
        for names, n, y in rows:
            p = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in names)))
            for f in names:
                slope[f] = slope.get(f, 0.0) + n * (p - y) / total
        weights = {f: weights.get(f, 0.0) - rate * (g + decay * weights.get(f, 0.0)) for f, g in slope.items()}
    return weights


def _odds(span: Column, weights: dict[str, float]) -> Column:
    total = F.lit(weights.get("all", 0.0))
    for kind in (*BASE, *MORE):
        if f"kind {kind}" in weights:
            total = total + F.when(span["kind"] == kind, weights[f"kind {kind}"]).otherwise(0.0)
    for j, vote in enumerate(votes(span)):
        total = total + F.when(vote == 1, weights.get(f"vote {j} 1", 0.0)).when(vote == -1, weights.get(f"vote {j} -1", 0.0)).otherwise(0.0)
    return total


def learn(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The classifier's weights, from the votes on all candidates of all texts. Only counts by pattern of votes come to the driver: kinds times 3 ** LABELERS at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = docs.select(F.explode(F.concat(base_spans(text), more_spans(text))).alias("span"))
    counts = spans.select(F.col("span.kind").alias("kind"), *(v.alias(f"v{j}") for j, v in enumerate(votes(F.col("span"))))).groupBy("kind", *(f"v{j}" for j in range(LABELERS))).count()
    patterns = {tuple(r)[:-1]: r["count"] for r in counts.collect()}
    return train(patterns, estimate(patterns).posterior) if patterns else {}


def all_spans(text: Column, weights: dict[str, float]) -> Column:
    """Base spans, and the other candidates that the classifier takes."""
    return F.concat(base_spans(text), F.filter(more_spans(text), lambda s: _odds(s, weights) > 0)) if weights else base_spans(text)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Base spans stay whatever the classifier says; it adds spans of other kinds. It is trained on the votes of this table unless weights are given. A null text counts as
    empty. Rows are mapped one by one: repeated rows repeat, and other columns don't matter. Without any candidate there is nothing to learn or to find.
    """
    weights = learn(docs, text_col) if weights is None else weights
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = let(text, lambda t: let(base_spans(t), lambda base: F.struct(base.alias("base"), (F.concat(base, F.filter(more_spans(t), lambda s: _odds(s, weights) > 0)) if weights else base).alias("all"))))
    return docs.select(F.col(id_col).alias("doc_id"), spans.alias("found")).select(
        "doc_id", *(counted(F.col("found.base"), kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(written(F.col("found.base")), 256).alias("base_sha256"), written(F.col("found.all")).alias("spans"),
    )


def redacted(text: Column, weights: dict[str, float]) -> Column:
    """The text with each span, or each run of overlapping ones, replaced by its kind in angle brackets; a null stays null."""

    def put(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(fresh, F.array_append(a["parts"], F.concat(F.substring(a["text"], a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")))).otherwise(a["parts"]).alias("parts"),
            a["text"].alias("text"),
        )

    def filled(pair: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"), pair["text"].alias("text"))
        finish = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(a["text"], a["at"] + 1, F.length(a["text"])))
        return F.when(F.size(pair["spans"]) == 0, pair["text"]).otherwise(F.aggregate(F.array_sort(pair["spans"]), begin, put, finish))

    return F.when(text.isNotNull(), let(F.struct(text.alias("text"), all_spans(text, weights).alias("spans")), filled))
