"""Scalar functions as Column builders: identity, URLs, text, values, dates and payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STATUS

# Second-level suffixes after which a registrable domain has three labels.
TWO_PART_SUFFIXES = ("co.kr", "or.kr", "go.kr", "ne.kr", "co.jp", "or.jp", "ne.jp", "co.uk", "org.uk", "com.cn", "com.au")
# Letters that are read as digits.
HOMOGLYPHS = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2"}
# Languages by the minutes from UTC of where they are mostly spoken (the default is 540), and those whose seasons are the southern ones.
ZONE_LANGUAGES = {
    60: ("sq", "ca", "hr", "cs", "da", "nl", "fr", "de", "hu", "it", "no", "pl", "sr", "sk", "sl", "es", "sv"),
    120: ("bg", "et", "fi", "el", "he", "lv", "lt", "ro", "uk"),
    180: ("ar", "tr", "ru", "sw"),
    210: ("fa",),
    240: ("az", "ka"),
    300: ("kk", "ur", "uz"),
    330: ("hi", "mr", "te"),
    360: ("bn",),
    420: ("id", "km", "th", "vi"),
    480: ("zh", "ms", "tl"),
    540: ("ja", "ko"),
    -180: ("pt",),
    0: ("is", "en"),
}
SOUTHERN_LANGUAGES = ("sw", "pt")
ZONES = {lang: minutes for minutes, langs in ZONE_LANGUAGES.items() for lang in langs}
CURRENCIES = {"ko": "KRW", "ja": "JPY", "zh": "CNY", "en": "USD", "de": "EUR", "fr": "EUR", "es": "EUR"}


# identity


def hash_id(text: Column) -> Column:
    """An id of 0x and 40 hex digits; of the same shape as an account address, from SHA-256."""
    return F.concat(F.lit("0x"), F.substring(F.sha2(text, 256), 1, 40))


def clean_no(text: Column) -> Column:
    return F.regexp_replace(text, "[-_.,]", "")


def entity_index(kind: Column, team: Column, no: Column) -> Column:
    return F.crc32(F.concat(hash_id(F.concat(kind, team, clean_no(no)))).cast("binary"))


def entity_id(team: Column, index: Column) -> Column:
    return hash_id(F.concat(team, index.cast("string")))


def digits_for_letters(text: Column) -> Column:
    return F.translate(text, "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def digest(text: Column) -> Column:
    """The same for texts that differ in punctuation, symbols, spaces, case or look-alike digits only."""
    return hash_id(F.lower(F.regexp_replace(digits_for_letters(text), r"[\p{P}\p{S}\p{Z}]", "")))


def scope_keys(team: Column, kind: Column, cc: Column, link: Column, detail: Column | None = None) -> tuple[Column, Column]:
    """The keys of a section and of a link; the section of detail pages has its site in upper case."""
    site = cc if detail is None else F.when(detail, F.upper(cc)).otherwise(cc)
    return hash_id(F.concat(kind, site)), hash_id(F.concat(team, cc, link))


# URLs


def url_parts(href: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; a relative reference has an empty host, a fragment is left out."""
    plain = F.regexp_replace(href, "#.*$", "")
    host = F.regexp_extract(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1)
    rest = F.regexp_replace(plain, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    return F.lower(host), F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)


def base_domain(host: Column) -> Column:
    labels = F.split(F.lower(host), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(last(2).isin(*TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def link_key(href: Column) -> Column:
    _, path, query = url_parts(href)
    return F.lower(F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query)))


def same_host(a: Column, b: Column) -> Column:
    return url_parts(a)[0] == url_parts(b)[0]


def dead_href(href: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    return (low == "") | low.startswith("#") | low.startswith("javascript:") | low.startswith("mailto:") | low.startswith("tel:")


def humanise(token: Column) -> Column:
    spaced = F.regexp_replace(token, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Za-z])([0-9])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([0-9])([A-Za-z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")))


def url_identifiers(href: Column) -> Column:
    """array<struct<value, hint, prior>>: query values 1.0, the last path segment .92, other segments .80, host labels .05."""
    host, path, query = url_parts(href)
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    make = lambda v, h, p: F.struct(v.alias("value"), h.alias("hint"), F.lit(p).alias("prior"))
    queries = F.transform(pairs, lambda p: make(F.regexp_extract(p, "=(.*)$", 1), humanise(F.regexp_extract(p, "^([^=]*)", 1)), 1.0))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(segments)
    last = F.transform(F.slice(segments, F.greatest(n, F.lit(1)), F.lit(1)), lambda s: make(s, F.lit("path"), 0.92))
    first = F.transform(F.slice(segments, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda s: make(s, F.lit("path"), 0.8))
    hosts = F.transform(F.filter(F.split(host, r"\."), lambda s: s != ""), lambda s: make(s, F.lit("host"), 0.05))
    return F.concat(queries, last, first, hosts)


def url_pattern(href: Column, ident: Column) -> tuple[Column, Column]:
    """What stands before and after the last place of an identifier behind the host; null if it is nowhere."""
    host, _, _ = url_parts(href)
    tail = F.when(host == "", href).otherwise(F.substring(href, F.locate("//", href) + 2 + F.length(host), F.length(href)))
    at = F.call_function("instr", F.reverse(tail), F.reverse(ident))
    start = F.length(href) - (at - 1) - F.length(ident)
    found = (at > 0) & (ident != "")
    return F.when(found, F.substring(href, F.lit(1), start)), F.when(found, F.substring(href, start + F.length(ident) + 1, F.length(href)))


def from_pattern(head: Column, tail: Column, ident: Column) -> Column:
    """The link of another identifier by a learned pattern; null without one."""
    return F.when((ident != "") & head.isNotNull(), F.concat(head, ident, F.coalesce(tail, F.lit(""))))


# text and values


def split_phrases(text: Column, cap: int = 48) -> Column:
    parts = F.transform(F.split(text, r"[,\n/|]"), lambda p: F.trim(p))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: p != "")), 1, cap)


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", ""))


def phrase_weight(phrase: Column) -> Column:
    digits = _count(phrase, "0-9") / F.length(phrase)
    return F.when(digits >= 0.25, 0.8).when(digits > 0, 0.95).otherwise(1.0)


def is_value_example(phrase: Column) -> Column:
    n = F.length(F.trim(phrase))
    return (n == 0) | (n > 24) | (_count(phrase, "0-9") * 4 >= n)


_DATE = r"(?<![0-9])([0-9]{2,4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?![0-9])"


def has_date(text: Column) -> Column:
    return text.rlike(_DATE)


def date_literal(text: Column) -> Column:
    return F.regexp_extract(text, _DATE, 0)


def longest_code(text: Column) -> Column:
    """Letters and digits of the longest run that has a digit; 0 without one."""
    runs = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda t: t.rlike("[0-9]"))
    return F.coalesce(F.array_max(F.transform(runs, lambda t: F.length(t))), F.lit(0))


def is_numeric(text: Column) -> Column:
    return text.rlike("[0-9]") & (_count(text, "A-Za-z") <= 1) & ~has_date(text)


def field_format(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.rlike("date|_at$"), "Date")
        .when(n.rlike("tracking"), "TrackingCode")
        .when(n.isin("id", "no", "code", "index") | n.rlike("_(id|no|code)$"), "Identifier")
        .when(n.rlike("link|url|href"), "Link")
        .when(n.rlike("price|amount|fee|quantity|discount|width|height|length|weight|count"), "Numeric")
        .when(n.rlike("phone|mobile|tel"), "Phone")
        .when(n.rlike("address"), "Address")
        .when(n.rlike("status|condition|carrier|method|currency"), "Enum")
        .otherwise("Text")
    )


def matches_format(fmt: Column, value: Column) -> Column:
    v = F.trim(value)
    return (
        F.when(v == "", F.lit(False))
        .when(fmt == "Date", has_date(v))
        .when(fmt == "TrackingCode", longest_code(v) >= 8)
        .when(fmt == "Identifier", (longest_code(v) >= 1) & ~has_date(v))
        .when(fmt == "Numeric", is_numeric(v))
        .when(fmt == "Link", v.rlike("^(https?:)?/"))
        .when(fmt == "Phone", _count(v, "0-9").between(7, 15) & ~has_date(v))
        .otherwise(F.lit(True))
    )


def is_placeholder(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return low.isin("", "null", "none", "undefined", "string", "n/a", "-") | low.rlike("^y{2,4}[-/.]?m{2}[-/.]?d{2}$")


def sanitize(text: Column) -> Column:
    """Printable ASCII and Hangul only; what else there is becomes one space."""
    return F.trim(F.regexp_replace(text, r"[^\x20-\x7E가-힣ㄱ-ㆎ]+", " "))


def strip_thousands(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def language_block(text: Column) -> Column:
    return (
        F.when(text.rlike(r"[가-힣]"), "ko")
        .when(text.rlike(r"[぀-ヿ]"), "ja")
        .when(text.rlike(r"[一-鿿]"), "zh")
        .when(text.rlike(r"[Ѐ-ӿ]"), "ru")
        .when(text.rlike(r"[؀-ۿ]"), "ar")
        .when(text.rlike(r"[ऀ-ॿ]"), "hi")
        .when(text.rlike(r"[฀-๿]"), "th")
        .when(text.rlike(r"[A-Za-z]"), "latin")
        .otherwise("unknown")
    )


def language(text: Column, detect) -> Column:
    """The language of a text by its script; where that is Latin, detect(text column) says which."""
    block = language_block(text)
    return F.when(block == "latin", F.coalesce(detect(text), F.lit("en"))).when(block == "unknown", F.lit("en")).otherwise(block)


def tracking_numbers(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^[0-9-]+$") & (F.length(F.regexp_replace(w, "[^0-9]", "")) >= 6))


def currency(value: Column, lang: Column) -> Column:
    given = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    chosen = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv]), lang), F.lit("USD"))
    return F.when(given == "", chosen).otherwise(given)


def condition_code(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("used"), 1).when(low.contains("lease"), 2).when(low.contains("rental"), 3).when(low.contains("refurbish"), 4).otherwise(0)


def type_hint(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.rlike("price|amount|fee|quantity|count|discount|width|height|weight"), "Number")
        .when(n.rlike("^is_|^has_|_included$"), "Boolean")
        .when(n.rlike("s$") & ~n.rlike("ss$|status$|address$"), "Array")
        .otherwise("String")
    )


def status_code(word: Column) -> Column:
    low = F.lower(F.trim(word))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), low), F.lit(0))


def status_word(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (v, k)]), code)


def relative_age(then_ms: Column, now_ms: Column) -> Column:
    seconds = F.floor((now_ms - then_ms) / 1000)
    out = F.lit("just now")
    for size, name in ((60, "minute"), (3600, "hour"), (86400, "day"), (2592000, "month"), (31536000, "year")):
        n = seconds / size
        out = F.when(n > 1, F.concat(F.floor(n).cast("string"), F.lit(f" {name}s ago"))).otherwise(out)
    return out


# dates


def normalise_date(text: Column) -> Column:
    """An ISO string from epoch digits, ISO text, or the first numbers found; month and day are clamped, not checked."""
    t = F.trim(text)
    clamp = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")

    def made(n):
        at = lambda i, d: F.coalesce(F.get(n, F.lit(i)), F.lit(d))
        swapped = F.get(n, F.lit(2)) > 31
        year0 = F.when(swapped, at(2, 0)).otherwise(at(0, 0))
        month = F.when(swapped, at(0, 1)).otherwise(at(1, 1))
        day = F.when(swapped, at(1, 1)).otherwise(at(2, 1))
        year = F.when(year0 < 50, year0 + 2000).when(year0 < 100, year0 + 1900).otherwise(year0)
        day_part = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(clamp(month, 1, 12)), two(clamp(day, 1, 31)))
        time_part = F.concat_ws(":", two(clamp(at(3, 0), 0, 23)), two(clamp(at(4, 0), 0, 59)), two(clamp(at(5, 0), 0, 59)))
        return F.when(F.size(n) >= 3, F.concat(day_part, F.lit("T"), time_part))

    # a one-element transform holds the numbers once
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)"), 1), lambda x: F.substring(x, 1, 9).cast("int"))
    read = F.transform(F.array(numbers), made)[0]
    iso = lambda seconds: F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return (
        F.when(t.rlike("^[0-9]{10}$"), iso(t.cast("long")))
        .when(t.rlike("^[0-9]{13}$"), iso(F.floor(t.cast("long") / 1000)))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}T"), t)
        .otherwise(read)
    )


def time_range(intent: Column, now: Column, offset_minutes: int = 540) -> tuple[Column, Column]:
    """[start, end] in epoch milliseconds of a relative time, in a zone of fixed offset; `now` is a timestamp."""
    local = now + F.expr(f"INTERVAL {offset_minutes} MINUTES")
    day, month, year = (F.date_trunc(u, local) for u in ("day", "month", "year"))
    start = (
        F.when(intent == "today", day)
        .when(intent == "yesterday", day - F.expr("INTERVAL 1 DAY"))
        .when(intent == "this_month", month)
        .when(intent == "last_month", F.date_trunc("month", month - F.expr("INTERVAL 1 DAY")))
        .when(intent == "this_year", year)
        .when(intent == "last_year", F.date_trunc("year", year - F.expr("INTERVAL 1 DAY")))
        .when(intent == "recently", local - F.expr("INTERVAL 7 DAYS"))
    )
    end = F.when(intent == "yesterday", day).when(intent == "last_month", month).when(intent == "last_year", year).otherwise(local)
    shift = offset_minutes * 60_000
    millis = lambda c: F.unix_millis(c.cast("timestamp")) - shift
    whole = intent.isin("yesterday", "last_month", "last_year")
    return millis(start), F.when(whole, millis(end) - 1).otherwise(millis(end))


def season_months(season: Column, southern: Column) -> Column:
    """The first month of a season; the hemispheres are half a year apart."""
    north = F.when(season == "spring", 3).when(season == "summer", 6).when(season == "autumn", 9).when(season == "winter", 12)
    return F.when(southern, F.pmod(north + 5, F.lit(12)) + 1).otherwise(north)


def season_range(season: Column, year: Column, southern: Column) -> tuple[Column, Column]:
    """First and last date of a season that begins in `year`."""
    first = F.make_date(year, season_months(season, southern), F.lit(1))
    return first, F.date_sub(F.add_months(first, 3), 1)


# payloads


def empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "") | (F.coalesce(c.cast("string").try_cast("double"), F.lit(1.0)) == 0)


def merge_value(a: Column, b: Column) -> Column:
    """b, unless it is null, empty or zero: then a."""
    return F.when(empty(b), a).otherwise(b)


def first_present(payload: Column, keys: list[str]) -> Column:
    """The first key that the JSON has, as a number; 0 if that is none. Later keys don't count, whatever the first one holds."""
    parsed = F.from_json(payload, "map<string,string>")
    out = F.lit(0.0)
    for key in reversed(keys):
        value = F.element_at(parsed, F.lit(key))
        out = F.when(F.map_contains_key(parsed, key), F.coalesce(value.try_cast("double"), F.lit(0.0))).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def letter_grams(text: Column, size: int = 3) -> Column:
    """All runs of `size` letters in lower case, the whole text if it is shorter. One pass of a pattern gives them: substring()
    would count from the start of the text for every gram, and lambdas over an array of letters are not compiled."""
    low = F.lower(text)
    return F.when(low.isNull() | (F.char_length(low) < size), F.array(low)).otherwise(F.regexp_extract_all(low, F.lit(rf"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def sentence(pairs: list[tuple[str, Column]]) -> Column:
    """`key is value.` for each value that is there, in the order given."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k} is "), v.cast("string"), F.lit("."))) for k, v in pairs]))), " ")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
