"""Structured analytics over extracted records: filters, grouping keys, metrics, hierarchies, extremes and profiles.

Rows are records or line items with text dates and an `amount`. Everything here returns a lazy plan. Amounts are summed as
decimals, so that a total doesn't depend on the order in which rows meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import dates
from ledgerloom.functions.numbers import parse_number

# Names of fields, in the order in which they are tried.
AMOUNT_FIELDS = ("total_amount", "total", "amount", "grand_total")
ENTITY_FIELDS = ("vendor_name", "merchant_name", "customer_name", "company_name")
ENTITY_FILTER_FIELDS = ("vendor_name", "customer_name", "merchant_name", "company_name", "payee", "payer")
UNKNOWN, ALL = "Unknown", "All"
TIME_KEYS = {"month": dates.month_key, "quarter": dates.quarter_key, "year": dates.year_key}
TYPED_KEYS = {
    "month": lambda d: F.date_format(d, "yyyy-MM"), "quarter": lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")), "year": lambda d: F.year(d).cast("string"),
}
MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Spec:
    """A structured question: which rows, grouped how, and which metrics of their amounts."""

    schema_types: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    entities: tuple[str, ...] = ()
    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    equal: dict[str, str] = field(default_factory=dict)
    group_by: tuple[str, ...] = ()


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))


def in_time(fields: Sequence[Column], start: str | None, end: str | None) -> Column:
    """Whether some date field is at or after the start, and some, maybe another one, at or before the end; texts are compared as they are."""
    test = F.lit(True)
    if start is not None:
        test = test & _any([f >= start for f in fields])
    if end is not None:
        test = test & _any([f <= end for f in fields])
    return test


def names_one_of(fields: Sequence[Column], names: Sequence[str]) -> Column:
    """Whether some field holds some name, in any case; `%` and `_` in a name are wildcards."""
    return _any([F.lower(f).like(f"%{n.lower()}%") for f in fields for n in names]) if names else F.lit(True)


def first_text(fields: Sequence[Column]) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in fields))


def first_amount(fields: Sequence[Column]) -> Column:
    """The number in the first field that is not null; a field that holds none ends the search with null."""
    return parse_number(F.coalesce(*fields))


def filtered(rows: DataFrame, spec: Spec, date_fields: Sequence[str] = ("date",), entity_fields: Sequence[str] = ("entity",), type_field: str = "schema_type") -> DataFrame:
    """The rows that a question is about. Ranges are inclusive; a value that is no number is in none."""
    test = in_time([F.col(c) for c in date_fields], spec.start, spec.end) & names_one_of([F.col(c) for c in entity_fields], spec.entities)
    if spec.schema_types:
        test = test & F.col(type_field).isin(*spec.schema_types)
    number = lambda c: F.col(c).try_cast("double")
    for c, x in spec.least.items():
        test = test & (number(c) >= x)
    for c, x in spec.most.items():
        test = test & (number(c) <= x)
    for c, x in spec.equal.items():
        test = test & (F.col(c).cast("string") == str(x))
    return rows.where(test)


def group_key(rows: DataFrame, name: str, date_field: str = "date") -> Column:
    """The key of a grouping: of the date for month, quarter and year, else the column itself; Unknown where it is missing, All where there is no such column. A column that holds dates or times, not texts, isn't read."""
    if name in TIME_KEYS:
        typed = isinstance(rows.schema[date_field].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        key = TYPED_KEYS[name](F.col(date_field)) if typed else TIME_KEYS[name](F.col(date_field).cast("string"))
        return F.coalesce(key, F.lit(UNKNOWN))
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(UNKNOWN)) if name in rows.columns else F.lit(ALL)


def metrics(amount: str = "amount") -> list[Column]:
    """count of rows, and total, average, least and most of the amounts that are not null; 0 without any."""
    a = F.col(amount).cast(MONEY)
    zero = F.lit(0.0)
    total = F.sum(a).cast("double")
    return [
        F.count("*").alias("count"), F.coalesce(total, zero).alias("total_amount"),
        F.when(F.count(a) > 0, total / F.count(a)).otherwise(zero).alias("average"),
        F.coalesce(F.min(a).cast("double"), zero).alias("least"), F.coalesce(F.max(a).cast("double"), zero).alias("most"),
    ]


def summary(rows: DataFrame, amount: str = "amount") -> DataFrame:
    """One row of metrics, also over no rows."""
    return rows.agg(*metrics(amount))


def grouped(rows: DataFrame, name: str, amount: str = "amount", date_field: str = "date") -> DataFrame:
    """(group_key, metrics) of each group. A group is pre-aggregated in every task, so a hot key is no heavy one."""
    return rows.groupBy(group_key(rows, name, date_field).alias("group_key")).agg(*metrics(amount))


def hierarchy(rows: DataFrame, names: Sequence[str], amount: str = "amount", date_field: str = "date") -> DataFrame:
    """Metrics of every group of up to three nested levels, of each prefix of the levels, and of all rows, in one pass.

    depth is the number of levels that a row belongs to; the keys of the others are null. For two levels the totals of the second alone are there too, with
    depth 1 and a null first key.
    """
    keys = [f"level_{i + 1}" for i in range(len(names))]
    keyed = rows.select(*(group_key(rows, n, date_field).alias(k) for k, n in zip(keys, names, strict=True)), F.col(amount).alias("amount"))
    sets = [keys[:n] for n in range(len(keys), -1, -1)] + ([keys[1:]] if len(keys) == 2 else [])
    depth = F.lit(len(keys)) - F.bit_count(F.grouping_id(*keys)).cast("int")
    return keyed.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(depth.alias("depth"), *metrics())


def average_per(rows: DataFrame, key: str, by: Sequence[str] = (), amount: str = "amount") -> DataFrame:
    """The mean, over the values of a key, of the sum of each: `average per receipt`, not per line."""
    sums = rows.groupBy(*by, key).agg(F.sum(F.col(amount).cast(MONEY)).alias("total"))
    return sums.groupBy(*by).agg(F.count("*").alias("count"), (F.sum("total").cast("double") / F.count("total")).alias("average"))


def once_per(rows: DataFrame, key: str, header: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a header's field, each header counted once however many lines it has, next to totals of the lines."""
    documents = rows.groupBy(*by, key).agg(F.max(F.col(header).cast(MONEY)).alias("header"), F.sum(F.col(amount).cast(MONEY)).alias("lines"), F.count("*").alias("n"))
    return documents.groupBy(*by).agg(
        F.count("*").alias("documents"), F.sum("n").alias("items"), F.sum("header").cast("double").alias("header_total"), F.sum("lines").cast("double").alias("line_total"),
    )


def counted(rows: DataFrame, key: str, level: str) -> DataFrame:
    """Number of documents, or of line items."""
    return rows.agg((F.count_distinct(key) if level == "document" else F.count("*")).alias("count"))


def extremes(rows: DataFrame, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """All rows with the least, and all with the greatest amount of their group, under record_type MIN and MAX. The bounds are joined back, so ties stay and no group is sorted."""
    bounds = rows.groupBy(*by).agg(F.min(amount).alias("least"), F.max(amount).alias("most"))
    ends = bounds.select(*by, F.explode(F.array(F.struct(F.lit("MIN").alias("record_type"), F.col("least").alias(amount)), F.struct(F.lit("MAX").alias("record_type"), F.col("most").alias(amount)))).alias("end"))
    ends = ends.select(*by, "end.record_type", F.col(f"end.{amount}").alias(amount))
    return rows.join(ends, [*by, amount])


def numeric_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, count, total, least, most, mean) of numeric columns, in one scan."""
    one = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("count"), F.sum(F.col(c).cast(MONEY)).cast("double").alias("total"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"),
            (F.sum(F.col(c).cast(MONEY)).cast("double") / F.count(c)).alias("mean"),
        )
        for c in columns
    ]
    return rows.agg(F.array(*one).alias("found")).select(F.inline("found"))


def frequent_values(rows: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(value, n): the k most frequent values, ties by value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def status_counts(rows: DataFrame, by: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """A column n_<value> of each status, zero where there is none; statuses that are not listed count in `total` alone."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))


def repeated(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Groups of more than one row: their number, first and last."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last")).where("n > 1")


def table_lines(rows: DataFrame, columns: Sequence[str]) -> Column:
    """A row as a line of a markdown table; bars and line breaks inside a cell are escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))


def report(items: DataFrame, document: Sequence[str], item: Sequence[str], amount: str, order: str) -> DataFrame:
    """(document columns, body, items, subtotal): a line for each item of a document, in order, and their sum.

    A report nests the lines of one document, which one row holds; documents are never nested in each other.
    """
    line = F.struct(F.col(order).alias("at"), table_lines(items, item).alias("line"))
    nested = items.groupBy(*document).agg(F.sort_array(F.collect_list(line)).alias("lines"), F.count("*").alias("items"), F.sum(F.col(amount).cast(MONEY)).cast("double").alias("subtotal"))
    return nested.select(*document, F.array_join(F.col("lines.line"), "\n").alias("body"), "items", "subtotal")


def quality(outputs: DataFrame) -> DataFrame:
    """Mean score of task outputs: 1, times 0.9 for each issue, 0.8 for partial and 0.5 for empty results, 0 for failed ones."""
    score = F.pow(F.lit(0.9), F.col("issues")) * F.when(F.col("status") == "failed", 0.0).when(F.col("status") == "partial", 0.8).otherwise(1.0) * F.when(F.col("rows") == 0, 0.5).otherwise(1.0)
    return outputs.agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("quality"), F.count("*").alias("tasks"), F.count_if(F.col("status") == "failed").alias("failed"))


def newest_first(rows: DataFrame, date_field: str, number: str) -> DataFrame:
    """By date from the newest, missing dates first, then by line number."""
    return rows.orderBy(F.desc_nulls_first(date_field), F.asc(number))


def ranked_once(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; Spark keeps one row for each key and task before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where("place = 1").drop("place")
