"""Secret scans by corpus-wide ownership: how many repositories and owners hold each candidate, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable
from ledgerloom.llm.spans import SPAN, counted, found, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are shorter than these can't be matches that count; the patterns leave them out from the start, which changes no other match.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"

#: Patterns of the spans that the method may add, by kind.
MORE = {
    "code_host": r"\bgh[opsur]_[A-Za-z0-9]{36,}",
    "chat": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "web_token": r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}",
    "bearer": r"(?i)\bbearer\x20+[A-Za-z0-9._~+/-]{20,}",
    "private_key": r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----",
    "url_login": r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{1,128}@",
}
#: A text with a match of MORE has a match of this.
ANY_MORE = r"gh[opsur]_|xox[abprs]-|\beyJ|(?i:bearer\x20)|-----BEGIN|://[^\s:/@]{1,64}:"
KINDS = ("assign", "access", "hex")
#: A candidate in the hands of more owners than this is an example that was copied, not a credential that one of them uses.
OWNERS = 1
#: So is one in more documents than this, even if they all have one owner.
REPOSITORIES = 10


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds."""
    assign = F.filter(found(text, "assign", 0, ASSIGN, group=2), lambda s: F.length(s["value"]) >= 6)
    return F.concat(assign, found(text, "access", 1, ACCESS, text.contains("AKIA")), found(text, "hex", 2, HEX))


def more_spans(text: Column) -> Column:
    """Candidates of the other kinds."""
    some = text.rlike(ANY_MORE)
    return F.when(some, F.concat(*(found(text, kind, 3 + i, p) for i, (kind, p) in enumerate(MORE.items())))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _narrow(spans: Column) -> Column:
    """Spans with the hash of their value in place of value and context."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash"),
    ))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, n_repositories) of every row.

    Hashes of all candidate values are counted over the corpus by distinct documents, which stand for repositories, and by distinct owners. A span beyond the base is added if at most `owners`
    owners and `repositories` repositories hold its value. n_owned and n_copied count all candidates of a document whose value so few or more hold; n_repositories is the greatest number of
    repositories that hold one of its values, 0 without any. A document with several owners is a repository of each.

    A null text counts as empty; a null owner is one owner. Repeated rows each get their spans, and count as one repository if their ids are equal. Values don't leave the scan, only hashes. Counts of a value are summed in each
    task before they are shuffled, and adaptive skew handling deals the rows of a very common value over several tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), text.alias("text"))
    read = durable(rows.select("row", "doc_id", "owner", _narrow(base_spans(F.col("text"))).alias("base"), _narrow(more_spans(F.col("text"))).alias("more")))
    candidates = read.where(F.size("base") + F.size("more") > 0).select("row", "doc_id", "owner", F.explode(F.concat("base", "more")).alias("span"))
    candidates = candidates.withColumn("hash", F.col("span.hash"))
    held = candidates.select("hash", "owner", "doc_id").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    owned = (F.col("owners") <= owners) & (F.col("repositories") <= repositories)
    added = F.collect_list(F.when(owned & (F.col("span.rank") >= len(KINDS)), F.col("span"))).alias("added")
    judged = candidates.join(held, "hash").groupBy("row").agg(added, F.sum(owned.cast("long")).alias("n_owned"), F.sum((~owned).cast("long")).alias("n_copied"), F.max("repositories").alias("n_repositories"))
    out = read.join(judged, "row", "left")
    return out.select(
        "doc_id", *(counted(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", F.coalesce("added", F.slice("more", 1, 0)))).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_repositories", F.lit(0)).alias("n_repositories"),
    )
