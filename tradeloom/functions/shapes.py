"""Shapes of links, identifiers, values and tags, zones of languages, and summaries of documents, as Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import SOUTHERN_LANGUAGES, ZONES

# Tags that a value may carry in front, tags that hold labels, and tags that hold no value.
MARKUP_TAGS = (
    "html", "head", "body", "div", "span", "p", "a", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "form", "input", "select", "option",
    "textarea", "button", "label", "img", "section", "colgroup", "col",
)
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "legend", "caption")
LABEL_TAGS = ("th", "label", "dt", *HEADING_TAGS)
EMPTY_TAGS = ("tr", "table", "thead", "tbody", "tfoot", "colgroup", "col", "form", "button")
# Parts of the names of fields that hold several values.
MULTI_VALUE = ("options", "tags", "goods", "additional_goods", "additional_image", "region_restrictions", "address")
# Names of the trade documents.
DOCUMENT_NAMES = {
    "CI": "Commercial Invoice",
    "PI": "Proforma Invoice",
    "PL": "Packing List",
    "BL": "Bill of Lading",
    "AWB": "Air Waybill",
    "CO": "Certificate of Origin",
    "LC": "Letter of Credit",
    "tracking": "Shipping Label / Tracking Info",
}

def _named(values: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), default)


# links


def host_end(link: Column) -> Column:
    """How many characters of a link are scheme and host; 0 for a relative one."""
    return F.length(F.regexp_extract(link, r"^(?:[^:/?#]*:)?//[^/?#]*", 0))


def resolved(href: Column, base: Column) -> Column:
    """A link against the page it stands on; dots in its path are followed, an empty one is the page itself."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path = F.regexp_extract(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    own, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    full = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))

    def follow(kept, part):
        return F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(part.isin("", "."), kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), follow)
    open_end = full.rlike(r"(^|/)\.{0,2}$") & (F.size(parts) > 0)
    made = F.concat(origin, F.lit("/"), F.array_join(parts, "/"), F.when(open_end, F.lit("/")).otherwise(F.lit("")), rest)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(made)
    )


def host_matches(host: Column, patterns: list[str]) -> Column:
    """Whether a host is one of the patterns, in which * stands for anything, or below one."""
    low = F.lower(host)

    def one(pattern):
        clean = pattern.lower()
        root = clean.replace("*.", "")
        return low.rlike("^" + re.escape(clean).replace(r"\*", ".*") + "$") | (low == root) | low.endswith("." + root)

    return (low != "") & reduce(lambda a, b: a | b, [one(p) for p in patterns], F.lit(False))


# identifiers and values


def words_of(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def in_url_pool(value: Column, pool: Column) -> Column:
    """Whether a run of four letters and digits or more, one a digit, of the value stands in the pool of links."""
    low = F.lower(pool)
    return F.exists(words_of(value), lambda w: (F.length(w) >= 4) & w.rlike("[0-9]") & low.contains(F.lower(w)))


def _tag_in_front(value: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(value), r"^\s*([^\[ (|]*)[^|]*\|", 1))


def is_markup(value: Column) -> Column:
    """A value that is empty, a bare tag, or has a tag in front."""
    low = F.lower(F.trim(value))
    return (low == "") | low.isin(*MARKUP_TAGS) | _tag_in_front(value).isin(*MARKUP_TAGS)


def without_markup(value: Column) -> Column:
    """A value without the tag in front."""
    return F.when(_tag_in_front(value).isin(*MARKUP_TAGS), F.trim(F.regexp_replace(F.trim(value), r"^[^|]*\|", ""))).otherwise(F.trim(value))


def is_multi_value(field: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(field).contains(k) for k in MULTI_VALUE])


def is_id_link(field: Column) -> Column:
    keys = F.transform(F.split(F.lower(field), ","), lambda k: F.trim(k))
    return F.array_contains(keys, "id") & F.array_contains(keys, "link")


def is_label_tag(tag: Column) -> Column:
    return tag.isin(*LABEL_TAGS)


def holds_no_value(tag: Column) -> Column:
    return tag.isin(*LABEL_TAGS, *EMPTY_TAGS)


def id_shape(token: Column) -> Column:
    return F.struct(F.length(token).alias("size"), token.rlike("^[0-9]+$").alias("digits"))


def learned_shapes(tokens: DataFrame, by: list[str], token: str) -> DataFrame:
    """What the known identifiers of a group look like: least and greatest length, any of digits only, any of others."""
    digits = F.col(token).rlike("^[0-9]+$")
    return tokens.groupBy(*by).agg(F.min(F.length(token)).alias("least"), F.max(F.length(token)).alias("most"), F.bool_or(digits).alias("any_digits"), F.bool_or(~digits).alias("any_mixed"))


def shape_allowed(token: Column) -> Column:
    """Whether a token looks like the learned ones (the columns of learned_shapes): two characters off at most, and of a kind that was seen. Anything goes where none was."""
    digits = token.rlike("^[0-9]+$")
    kind = F.when(digits, F.col("any_digits")).otherwise(F.col("any_mixed"))
    n = F.length(token)
    return F.col("least").isNull() | (kind & n.between(F.greatest(F.col("least") - 2, F.lit(0)), F.col("most") + 2))


def labelled_tokens(lines: DataFrame, key: str, line: str, most: int = 48) -> DataFrame:
    """(key, label, token, place): runs of 2 to 32 letters and digits, one a digit, behind the label of a `label | value` line.

    A label that is empty or a tag counts as that of an identifier. Repeated ones of a label are one, `most` of an item stay.
    """
    from pyspark.sql import Window

    label = F.trim(F.regexp_extract(line, r"^([^|]*)\|", 1))
    tag = F.lower(F.regexp_extract(label, r"^([^\[ (]*)", 1))
    named = F.when((label == "") | tag.isin(*MARKUP_TAGS), F.lit("identifier code number")).otherwise(label)
    value = F.regexp_extract(line, r"^[^|]*\|(.*)$", 1)
    rows = lines.filter(F.col(line).contains("|")).select(key, "pos", named.alias("label"), F.posexplode(words_of(value)).alias("at", "token"))
    fit = rows.filter(F.length("token").between(2, 32) & F.col("token").rlike("[0-9]"))
    first = fit.groupBy(key, "label", "token").agg(F.min(F.struct("pos", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select(key, "label", "token", "place")


def first_identifier(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, token): the first run of eight letters and digits or more, one a digit, behind a bar in the item's lines."""
    value = F.regexp_extract(line, r"^[^|]*\|(.*)$", 1)
    rows = lines.filter(F.col(line).contains("|")).select(key, "pos", F.posexplode(words_of(value)).alias("at", "token"))
    fit = rows.filter((F.length("token") >= 8) & F.col("token").rlike("[0-9]"))
    return fit.groupBy(key).agg(F.min_by("token", F.struct("pos", "at")).alias("token"))


def query_words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The words of a question without stop words; a part-of-speech model can take its place."""
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: (w != "") & (~w.isin(*stop) if stop else F.lit(True)))


def sealed(text: Column, key: Column) -> Column:
    """Encrypted (AES-GCM, a random nonce) and as base64; opened() undoes it."""
    return F.base64(F.aes_encrypt(text, key))


def opened(text: Column, key: Column) -> Column:
    """The text, or null if it was not sealed with this key."""
    return F.try_aes_decrypt(F.unbase64(text), key).cast("string")


def random_key() -> Column:
    """A new uuid for each row, where a record has no key of its own."""
    return F.call_function("uuid")


# zones and dates


def utc_offset(lang: Column) -> Column:
    """Minutes from UTC of a language; that of ko where it is unknown."""
    return _named(ZONES, F.lower(lang), F.lit(540))


def is_southern(lang: Column) -> Column:
    """Whether the seasons of a language are the southern ones."""
    return F.lower(lang).isin(*SOUTHERN_LANGUAGES)


def midnight_before(stamp: Column, days: Column) -> Column:
    """UTC midnight some days before, in epoch milliseconds."""
    return F.unix_millis(F.date_trunc("day", stamp).cast("timestamp")) - days.cast("long") * 86_400_000


def filled_dates(started: Column, manufactured: Column, expired: Column, expiration: Column) -> tuple[Column, Column]:
    """started_at and expired_at, from the dates of manufacture and expiration where they are empty."""
    pick = lambda own, other: F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit("")))
    return pick(started, manufactured), pick(expired, expiration)


# documents


def summary(kind: Column, number: Column, issued: Column, supplier: Column, buyer: Column, amount: Column, currency: Column, loading: Column, discharge: Column, mode: Column, items: Column) -> Column:
    """A trade document as sentences; what is missing, empty or N/A is left out, and five items at most are named."""
    there = lambda c: F.when((c != "") & (c != "N/A"), c)
    s, b = there(supplier), there(buyer)
    parties = (
        F.when(s.isNotNull() & b.isNotNull(), F.concat(F.lit("Transaction involved "), s, F.lit(" as the supplier/shipper and "), b, F.lit(" as the buyer/consignee.")))
        .when(s.isNotNull(), F.concat(F.lit("Supplier/Shipper is "), s, F.lit(".")))
        .when(b.isNotNull(), F.concat(F.lit("Buyer/Consignee is "), b, F.lit(".")))
    )
    named = F.slice(F.filter(items, lambda d: F.length(d) > 3), 1, 5)
    parts = [
        F.concat(F.lit("This is a "), _named(DOCUMENT_NAMES, kind, kind), F.lit(" document.")),
        F.concat(F.lit("Document number is "), there(number), F.lit(".")),
        F.concat(F.lit("Issued on "), there(issued), F.lit(".")),
        parties,
        F.when(~amount.isin("0", "0.0"), F.concat(F.lit("Total amount is "), amount, F.lit(" "), F.coalesce(currency, F.lit("USD")), F.lit("."))),
        F.concat(F.lit("Shipped from "), there(loading), F.lit(" to "), there(discharge), F.lit(".")),
        F.concat(F.lit("Transport mode is "), mode, F.lit(".")),
        F.when(F.size(named) > 0, F.concat(F.lit("Contains items: "), F.array_join(named, ", "), F.lit("."))),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def without_equal(rows: Column, key: str, value) -> Column:
    """An array of records without nulls and without those whose key has the value."""
    return F.filter(rows, lambda r: r.isNotNull() & ~F.coalesce(r[key] == F.lit(value), F.lit(False)))


def known_ranges(properties: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Properties with the bounds that the metrics have for them; those without any bound are dropped."""
    found = properties.join(ranges, [*by, "property"])
    return found.filter((F.col("min_value") != 0) | (F.col("max_value") != 0))
