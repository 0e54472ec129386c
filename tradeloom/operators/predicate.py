"""Structured conditions, tags and scopes compiled to Column predicates."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The physical columns a condition may name, and the property names that stand for them.
PHYSICAL = ("amount", "status", "type", "created_at", "updated_at", "mode", "is_masked")
TO_AMOUNT = ("price", "sale_price", "discount", "supply_price", "order", "goods", "amount_total", "total_amount", "shipping_fee")
TO_CREATED = ("started_at", "order_date", "registration_date", "release_date", "manufacture_date", "shipping_date", "payment_date")
TO_UPDATED = ("expired_at", "delivery_date")
SKIPPED_OPERATORS = ("top", "bottom", "contains", "not_contains")

COMPARE = {
    "gte": lambda c, v: c >= v,
    "gt": lambda c, v: c > v,
    "lte": lambda c, v: c <= v,
    "lt": lambda c, v: c < v,
    "eq": lambda c, v: c == v,
}


def physical_column(name: str) -> str | None:
    if name in TO_AMOUNT:
        return "amount"
    if name in TO_CREATED or name.endswith("_date") and name not in TO_UPDATED:
        return "created_at"
    if name in TO_UPDATED:
        return "updated_at"
    return name if name in PHYSICAL else None


def number_in(value) -> float | None:
    """The digits and dots of a value as a number, without sign or exponent, as texts like "1,500 won" are meant; None if there are none."""
    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return float(value)
    digits = re.sub(r"[^0-9.]", "", str(value or ""))
    try:
        return float(digits)
    except ValueError:
        return None


def condition(context: dict, columns: dict[str, str] | None = None) -> Column:
    """A Column for {type, status, condition: {property: {operator, value}}}.

    Property names are mapped to physical columns, then through `columns` to those of the table; properties without
    a column, operators that filter nothing and values without a number are left out. All that is left is ANDed.
    """
    columns = columns or {}
    terms = []
    for key in ("type", "status"):
        if context.get(key) not in (None, "") and (not columns or key in columns):
            terms.append(F.col(columns.get(key, key)) == F.lit(context[key]))
    for name, rule in (context.get("condition") or {}).items():
        column = physical_column(name)
        op = str(rule.get("operator", "eq"))
        value = number_in(rule.get("value"))
        if column is None or op in SKIPPED_OPERATORS or value is None or columns and column not in columns:
            continue
        compare = next((COMPARE[p] for p in ("gte", "gt", "lte", "lt") if op.startswith(p)), COMPARE["eq"])
        terms.append(compare(F.col(columns.get(column, column)), F.lit(value)))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def parse_condition(column: str, rule: dict) -> Column:
    """An eq/gte/lte rule on one column; a YYYY-MM-DD value becomes epoch milliseconds, and `date` means created_at."""
    target = F.col("created_at" if column == "date" else column)

    def value(v):
        if isinstance(v, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}.*", v):
            return F.unix_millis(F.to_timestamp(F.lit(v)))
        return F.lit(v)

    terms = [COMPARE[op](target, value(rule[op])) for op in ("eq", "gte", "lte") if rule.get(op) is not None]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def tag_filter(tags: str, scope_of=lambda host: F.lit(host)) -> Column:
    """`host:x type:y mode:z` as a predicate: host by its scope key, type in lower case, mode ignored."""
    terms = []
    for tag in tags.split():
        kind, _, value = tag.partition(":")
        if kind == "host" and value:
            terms.append(F.col("cc") == scope_of(value))
        elif kind == "type" and value:
            terms.append(F.col("type") == F.lit(value.lower()))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def scope_filter(cc=None, bcc=None, ref=None, types=()) -> Column:
    """The narrowest scope given (ref, then bcc, then cc) and a white-list of types."""
    out = F.col("type").isin(*types) if types else F.lit(True)
    for name, value in (("ref", ref), ("bcc", bcc), ("cc", cc)):
        if value:
            return out & (F.col(name) == F.lit(value))
    return out


def all_words(words: str, columns: list[str]) -> Column:
    """Every word occurs, in whatever case, in one of the columns; % and _ are plain letters."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    each = [reduce(lambda a, b: a | b, [c.contains(w.lower()) for c in low]) for w in words.split()]
    return reduce(lambda a, b: a & b, each, F.lit(True))


def newer_than(df: DataFrame, column: str, seen) -> DataFrame:
    return df.filter(F.col(column) > F.lit(seen))


def tenant(df: DataFrame, team: str) -> DataFrame:
    """Only a team's own rows; the edge puts this in front of every query."""
    return df.filter(F.col("to") == F.lit(team))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Sort, then slice; the order has to be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def limit_first(df: DataFrame, first: list[Column], limit: int, then: list[Column]) -> DataFrame:
    """Take `limit` rows by one order, then sort them by another: the queue's order of business."""
    return df.orderBy(*first).limit(limit).orderBy(*then)


def discrete_percentile(df: DataFrame, column: str, p: float, most: int = 100_000):
    """The least value whose share of rows at or below it is p or more, exactly; None without values.

    Approximate percentiles narrow a range around it, in which rows are counted, until `most` different values are left;
    only their counts come to the driver. No task sees more than a digest of its rows.
    """
    rows = df.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    rank = max(1, math.ceil(round(p * n, 9)))
    before = 0  # rows below `low`
    while True:
        inside = rows.filter(F.col("x").between(low, high))
        here, different = inside.agg(F.count("*"), F.approx_count_distinct("x", 0.05)).first()
        if low == high or different <= most:
            break
        at = (rank - before) / here
        bounds = [max(0.0, at - 0.01), min(1.0, at + 0.01)]
        a, b = inside.agg(F.percentile_approx("x", bounds, 10_000)).first()[0]
        below, upto = rows.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x") <= b)).first()
        if not below < rank <= upto or (a, b) == (low, high):  # the digest was off, or no narrower than the range
            break
        low, high, before = a, b, below
    counts = inside.groupBy("x").agg(F.count("*").alias("n")).orderBy("x")
    total = before
    for x, k in counts.toLocalIterator():
        total += k
        if total >= rank:
            return x
    return high


def share(df: DataFrame, column: str, percent: float = 20.0, top: bool = True) -> DataFrame:
    """The rows at or beyond the exact discrete percentile: the dearest or the cheapest `percent` of them."""
    bound = discrete_percentile(df, column, 1 - percent / 100 if top else percent / 100)
    if bound is None:
        return df.limit(0)
    return df.filter(F.col(column) >= F.lit(bound) if top else F.col(column) <= F.lit(bound))
