"""Names of entities, documents and fields: normal forms, keys and likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of company names, in the order in which they are taken off, known names with what they stand for, and the ratio from which names are alike.
COMPANY_SUFFIXES = (
    r"\s+inc\.?$", r"\s+incorporated$", r"\s+corp\.?$", r"\s+corporation$", r"\s+llc\.?$", r"\s+ltd\.?$", r"\s+limited$", r"\s+co\.?$", r"\s+company$", r"\s+plc\.?$", r"\s+gmbh$",
    r"\s+ag$", r"\s+sa$", r"\s+srl$", r"\s+pty\.?\s*ltd\.?$", r"\s+pte\.?\s*ltd\.?$",
)
ALIASES = {
    "amazon.com": "Amazon", "amazon.ca": "Amazon", "amazon.co.uk": "Amazon", "amzn": "Amazon", "amazon web services": "AWS", "aws": "AWS",
    "google llc": "Google", "google inc": "Google", "google cloud": "Google Cloud", "gcp": "Google Cloud",
    "microsoft corporation": "Microsoft", "microsoft corp": "Microsoft", "msft": "Microsoft", "azure": "Microsoft Azure",
    "apple inc": "Apple", "apple computer": "Apple",
    "github inc": "GitHub", "github": "GitHub", "slack technologies": "Slack", "zoom video communications": "Zoom", "dropbox inc": "Dropbox", "atlassian": "Atlassian", "jira": "Atlassian", "confluence": "Atlassian",
    "stripe inc": "Stripe", "paypal inc": "PayPal", "paypal": "PayPal", "square inc": "Square",
    "fedex": "FedEx", "federal express": "FedEx", "ups": "UPS", "united parcel service": "UPS", "usps": "USPS", "dhl": "DHL",
}
ALIKE = 85


def entity_name(name: Column, organization: bool = True) -> Column:
    """A name in lower case with single spaces, without company suffixes and closing punctuation; a known name, with or without its suffix, as what it stands for. Null gives the empty name."""
    pairs = F.create_map(*(F.lit(x) for known, name in ALIASES.items() for x in (known, name.lower())))
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    bare = base
    for suffix in COMPANY_SUFFIXES if organization else ():
        bare = F.regexp_replace(bare, suffix, "")
    bare = F.regexp_replace(bare, r"[,.\-'\"]+$", "")
    return F.trim(F.coalesce(F.try_element_at(pairs, base), F.try_element_at(pairs, bare), bare))


def indel_ratio(a: Column, b: Column) -> Column:
    """100 times the share of characters of two texts that a longest common subsequence keeps.

    Found from the texts' characters in order, a row of the table of subsequence lengths at a time.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    width = F.length(b)
    begin = F.transform(F.sequence(F.lit(0), width), lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(chars(b), start, lambda acc, y: F.array_append(acc, F.when(x == y, F.get(before, F.size(acc) - 1) + 1).otherwise(F.greatest(F.get(before, F.size(acc)), F.element_at(acc, -1)))))

    kept = F.element_at(F.aggregate(chars(a), begin, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * kept / total)


def alike(a: Column, b: Column, least: int = ALIKE) -> Column:
    """Whether two names mean the same: equal in normal form, one within the other, or of a ratio of at least `least`. Empty names are like none."""
    pair = F.array(F.struct(entity_name(a).alias("x"), entity_name(b).alias("y")))  # so that normal forms are made once
    near = lambda p: (p["x"] == p["y"]) | p["x"].contains(p["y"]) | p["y"].contains(p["x"]) | (indel_ratio(p["x"], p["y"]) >= least)
    return F.coalesce((a != "") & (b != "") & F.exists(pair, near), F.lit(False))


def slug(name: Column) -> Column:
    """Lower case, underscores for spaces, nothing but letters, digits and underscores, at most 100 characters; `user` if nothing is left."""
    bare = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")
    return F.left(F.when(F.coalesce(bare, F.lit("")) == "", "user").otherwise(bare), F.lit(100))


def folder_name(name: Column, stamp: Column) -> Column:
    """A name for a folder: lower case, single underscores for all else, with a stamp behind it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.left(bare, F.lit(80)), F.lit("_"), stamp)


def title(key: Column) -> Column:
    """`unit_price` as `Unit Price`."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def alias(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def entity_key(workspace: Column, kind: Column, name: Column) -> Column:
    """Key of an entity in a workspace."""
    return F.md5(F.concat_ws(":", workspace, kind, F.lower(F.trim(name))))


def document_entity_key(workspace: Column, document: Column, kind: Column, name: Column) -> Column:
    """Key of an entity within one document of a workspace."""
    return F.md5(F.concat_ws(":", workspace, document, F.lower(kind), F.trim(F.lower(name))))


def edge_key(workspace: Column, a: Column, b: Column) -> Column:
    """Key of an edge without direction."""
    return F.md5(F.concat_ws(":", workspace, F.least(a, b), F.greatest(a, b)))


def question_key(question: Column) -> Column:
    """SHA-256 of a question in normal form."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(question)), r"\s+", " "), 256)
