"""Scores of answers, texts and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def token_f1(answer: Column, truth: Column) -> Column:
    """F1 of the distinct common words over the numbers of words of both; 0 without any."""
    a = F.filter(F.split(normal_answer(answer), " "), lambda w: w != "")
    b = F.filter(F.split(normal_answer(truth), " "), lambda w: w != "")
    same = F.size(F.array_intersect(a, b))
    precision, recall = same / F.size(a), same / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (same == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def tagged(text: Column, tag: str) -> Column:
    """What stands between the first pair of a tag, trimmed; null without one."""
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)))


def _times(text: Column, part: str) -> Column:
    return F.regexp_count(text, F.lit(part))


def format_reward(text: Column) -> Column:
    """0.3 for a thought, 0.4 for a query or an answer, 0.3 for sound nesting: pairs closed, one of each at most, the thought first."""
    both = lambda tag: text.contains(f"<{tag}>") & text.contains(f"</{tag}>")
    tags = ("think", "query", "answer")
    closed = [_times(text, f"<{t}>") == _times(text, f"</{t}>") for t in tags]
    single = [_times(text, f"<{t}>") <= 1 for t in tags]
    at = {t: F.locate(f"<{t}>", text) for t in tags}
    first = [(at["think"] == 0) | (at[t] == 0) | (at["think"] <= at[t]) for t in tags[1:]]
    sound = closed[0]
    for test in (*closed[1:], *single, *first):
        sound = sound & test
    points = F.when(both("think"), 3).otherwise(0) + F.when(both("query") | both("answer"), 4).otherwise(0) + F.when(sound, 3).otherwise(0)
    return points / 10


def combined_reward(form: Column, answer: Column) -> Column:
    """-1 plus the form's reward, plus the answer's where the form's is full."""
    return F.when(form >= 1.0, -1.0 + form + answer).otherwise(-1.0 + form)


def turns_reward(text: Column) -> Column:
    """0.5 for each assistant turn of a transcript that is a thought and a query, and for a last one that is a thought and an answer."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"), F.lit(1))

    def fits(block: Column, tag: str) -> Column:
        once = block.rlike(rf"(?s)^<think>.*?</think>\n<{tag}>.*?</{tag}>$")
        for part in ("<think>", "</think>", f"<{tag}>", f"</{tag}>"):
            once = once & (_times(block, part) == 1)
        return once

    before = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.coalesce(0.5 * F.size(F.filter(before, lambda b: fits(b, "query"))) + F.when(fits(F.try_element_at(blocks, F.lit(-1)), "answer"), 0.5).otherwise(0.0), F.lit(0.0))


def tokens(text: Column, least: int = 0) -> Column:
    """A text's length in tokens, estimated as a quarter of its characters."""
    return F.greatest(F.lit(least), F.floor(F.length(text) / 4).cast("int"))


def first_words(text: Column, limit: int) -> Column:
    """As many words as fit into so many tokens, at three quarters of a word each; shorter texts stay as they are."""
    words = F.split(text, r"\s+")
    n = int(limit * 0.75)
    return F.when(F.size(words) <= n, text).otherwise(F.array_join(F.slice(words, 1, n), " "))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is empty, has no length, or they differ in size."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot(a, b) / lengths).otherwise(0.0)


def digits_share(text: Column) -> Column:
    """Share of digits, points and commas among a text's characters but white space."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(solid > 0, F.regexp_count(text, F.lit(r"[\d.,]")) / solid).otherwise(0.0)


def table_share(text: Column) -> Column:
    """Share of lines that look like rows of a table: two bars, or two commas."""
    lines = F.split(text, "\n")
    marks = lambda line, mark: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))
    return F.size(F.filter(lines, lambda x: (marks(x, "|") >= 2) | (marks(x, ",") >= 2))) / F.size(lines)


def is_tabular(text: Column) -> Column:
    """Why a text counts as tabular: markdown_table, high_numeric_density, line_items, transaction_list, short_repetitive_lines or csv_like; null if it doesn't."""
    lines = F.split(F.trim(text), "\n")
    bars = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2))
    rules = F.size(F.filter(lines, lambda x: x.rlike(r"^[\s|:\-]+$")))
    full = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    mean = F.aggregate(full, F.lit(0), lambda s, x: s + F.length(x)) / F.size(full)
    commas = F.transform(F.filter(F.slice(lines, 1, 10), lambda x: F.trim(x) != ""), lambda x: F.regexp_count(x, F.lit(",")).cast("double"))
    middle = F.aggregate(commas, F.lit(0.0), lambda s, x: s + x) / F.size(commas)
    spread = F.aggregate(commas, F.lit(0.0), lambda s, x: s + (x - middle) * (x - middle)) / F.size(commas)
    # each line of amounts has such a number of its own; looked for first, since the patterns of lines try every place of a text
    priced = F.regexp_count(text, F.lit(r"\d[.,]\d{2}")) >= 3
    return F.when((F.length(text) < 50) | (F.size(lines) < 3), None).otherwise(
        F.when((bars >= 3) & (rules >= 1), "markdown_table")
        .when(digits_share(text) > 0.4, "high_numeric_density")
        .when(priced & (F.regexp_count(text, F.lit(r".{5,50}\s+\d+\s*[xX×]?\s*[$€£¥]?\d+[.,]\d{2}")) >= 3), "line_items")
        .when(priced & (F.regexp_count(text, F.lit(r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}.{10,50}[$€£¥]?\d+[.,]\d{2}")) >= 3), "transaction_list")
        .when((F.size(full) >= 8) & (mean < 40), "short_repetitive_lines")
        .when((F.size(lines) >= 5) & (F.array_min(commas) >= 2) & (spread < 2), "csv_like")
    )


def importance(text: Column, key: Column, section: Column, first: Column, bonus: Column) -> Column:
    """0.5, and 0.3 for a key section, 0.2 for a section, 0.1 for the first chunk, and a bonus; 1 at most."""
    yes = lambda c, n: F.when(c, n).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + yes(key, 0.3) + yes(section, 0.2) + yes(first, 0.1) + bonus)
