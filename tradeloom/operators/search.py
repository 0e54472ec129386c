"""Search over records: free predicates, full text by grams, vectors with metadata, entry points, and signed metrics of sites."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import predicate, records, vectors

# The properties whose ranges are kept, words that ask for the least first, and limits of the entry points.
LEAST_FIRST = ("light", "few", "little")
FLAGS = ("used", "lease", "rental", "refurbish")
SORTED = ("substantial", "find", "orderBy")
DOCUMENTS, AI_SEARCH, RESEARCH, EDGE_ROWS, EDGE_VECTORS = 50, 5, 3, 300, 100


def where(rows: DataFrame, text: str, fallback: Column | None = None) -> DataFrame:
    """Rows by a predicate written in SQL; with a fallback, that one where the text can't be read or names unknown columns."""
    try:
        kept = rows.filter(F.expr(text))
        kept.schema  # noqa: B018  resolves the columns
        return kept
    except (AnalysisException, ParseException):
        if fallback is None:
            raise
        return rows.filter(fallback)


def tracking_like(number: str, column: str = "data") -> Column:
    """Records whose payload holds a tracking number, whatever stands between its parts."""
    clean = "".join(c for c in number if c.isalnum())
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "[-_ .,]", "").contains(clean)


def edge_condition(context: dict, columns: list[str]) -> Column:
    """A context of the server's search as a predicate: type, status (a code) or the flag of a condition word, and ranges.

    condition: {column: {eq, gte, lte}}; bounds of columns that the table does not have are left out, and so are keys that
    only name an order. A status that is a word of condition asks for records with that flag above 0.
    """
    terms = []
    if context.get("type"):
        terms.append(F.col("type") == F.lit(context["type"]))
    status = context.get("status")
    if status in FLAGS:
        terms.append(F.col(status) > 0)
    elif status not in (None, ""):
        terms.append(F.col("status") == F.lit(status))
    for name, rule in (context.get("condition") or {}).items():
        target = "created_at" if name == "date" else name
        if name not in SORTED and not name.endswith(("_min", "_max")) and target in columns and isinstance(rule, dict):
            terms.append(predicate.parse_condition(name, rule))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def edge_order(context: dict, columns: list[str], key: str = "id") -> list[Column]:
    """By the property asked for, else by age; the least first where the question asks for little."""
    column = context.get("substantial") if context.get("substantial") in columns else "created_at"
    up = context.get("find") in LEAST_FIRST
    return [F.asc(column) if up else F.desc(column), F.asc(key)]


def edge_rows(rows: DataFrame, context: dict, team: str, limit: int = EDGE_ROWS) -> DataFrame:
    """The server's answer to a context: a team's own rows, filtered, sorted, `limit` at most."""
    kept = predicate.tenant(rows, team).filter(edge_condition(context, rows.columns))
    return predicate.page(kept, edge_order(context, rows.columns), limit)


def by_vector(rows: DataFrame, vector: list[float], team: str, context: dict, k: int = EDGE_VECTORS, column: str = "vector") -> DataFrame:
    """The k nearest rows of a team whose metadata equal what the context asks for: type, and conditions of equality."""
    equal = {c: r["eq"] for c, r in (context.get("condition") or {}).items() if isinstance(r, dict) and r.get("eq") is not None and c in rows.columns}
    terms = [F.col("to") == F.lit(team), *([F.col("type") == F.lit(context["type"])] if context.get("type") else []), *[F.col(c) == F.lit(v) for c, v in equal.items()]]
    return vectors.nearest(rows, column, vector, k, "id", reduce(lambda a, b: a & b, terms))


def upsert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A vector table (id, values, metadata) after new rows; the new row of an id wins, of several the greatest metadata."""
    return records.store.upsert(stored, new, "id", [F.desc("metadata"), F.desc(F.to_json(F.struct("values")))])


# ---- full text


def gram_index(docs: DataFrame, key: str, texts: list[str], sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(gram, id) of the letter n-grams of several texts, in lower case; the table that text() reads."""
    grams = F.array_distinct(F.flatten(F.array(*[scalars.letter_grams(F.coalesce(F.col(t), F.lit("")), n) for t in texts for n in sizes])))
    return docs.select(F.explode(grams).alias("gram"), F.col(key).alias("id")).filter(F.col("gram") != "")


def text(index: DataFrame, docs: DataFrame, key: str, texts: list[str], question: str, size: int = 3) -> DataFrame:
    """The documents that hold any word of the question, as a phrase, in whatever case; n_words is how many.

    The index names the documents with all grams of a word, and only their texts are read.
    """
    words = sorted({w.lower() for w in question.split()})
    if not words:
        return docs.withColumn("n_words", F.lit(0)).limit(0)
    grams = {w: sorted({w[i : i + size] for i in range(max(1, len(w) - size + 1))}) for w in words}
    wanted = index.sparkSession.createDataFrame([(w, g, len(gs)) for w, gs in grams.items() for g in gs], "word string, gram string, need int")
    hits = index.join(F.broadcast(wanted), "gram").groupBy("id", "word", "need").agg(F.count_distinct("gram").alias("n")).filter("n = need")
    found = hits.groupBy("id").agg(F.collect_set("word").alias("_words"))
    both = docs.join(found, docs[key] == found["id"]).drop(found["id"]) if key == "id" else docs.join(found, docs[key] == found["id"]).drop("id")
    hay = F.lower(F.concat_ws("\n", *texts))
    # without a lambda: Spark moves a condition that has one to a side of the join where the texts are not
    held = reduce(lambda a, b: a + b, [(F.array_contains("_words", w) & hay.contains(w)).cast("int") for w in words])
    return both.withColumn("n_words", held).filter("n_words > 0").drop("_words")


# ---- entry points


def search_documents(rows: DataFrame, where_: Column, limit: int = DOCUMENTS, offset: int = 0) -> DataFrame:
    """The listing of records: filtered, newest first."""
    return predicate.page(rows.filter(where_), [F.desc("created_at"), F.asc("id")], limit, offset)


def ai_search(contexts: list[dict], rows: DataFrame, words: str, vector: list[float], each: int = AI_SEARCH, column: str = "vector") -> DataFrame:
    """A question taken apart into contexts: the best `each` of every context by the three tracks, an id once, with its first context."""
    parts = []
    for n, context in enumerate(contexts):
        got = vectors.hybrid_search(rows, "id", ["text"], words, rows, "id", column, vector, predicate.condition(context, {c: c for c in rows.columns}), each)
        parts.append(got.withColumn("context", F.lit(n)))
    all_ = reduce(lambda a, b: a.unionByName(b), parts)
    return records.store.latest(all_, ["id"], [F.asc("context"), F.desc("score")])


def research(contexts: list[dict], rows: DataFrame, words: str, vector: list[float], column: str = "vector") -> DataFrame:
    """As ai_search, with few records of each context, for a longer answer."""
    return ai_search(contexts, rows, words, vector, RESEARCH, column)


# ---- metrics of sites on the server


def signed_counts(counts: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Draft and record counts after signed changes, which may go below zero here."""
    both = counts.select(*keys, "draft", "n").unionByName(deltas.select(*keys, "draft", "n"))
    return both.groupBy(*keys).agg(F.sum("draft").alias("draft"), F.sum("n").alias("n"))


def widened(bounds: DataFrame, rows: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """Bounds (keys, property, min_value, max_value) after new rows: a value at or beyond a bound replaces it; zero is a value here."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("x")) for p in properties]))
    new = rows.select(*keys, pairs.alias("p")).select(*keys, "p.property", F.col("p.x").alias("min_value"), F.col("p.x").alias("max_value"))
    both = bounds.select(*keys, "property", "min_value", "max_value").unionByName(new)
    return both.groupBy(*keys, "property").agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def distinct_urls(rows: DataFrame, column: str) -> DataFrame:
    """(host, urls): how many different links there are of each host, by their normalised keys."""
    host, _, _ = scalars.url_parts(F.col(column))
    return rows.groupBy(host.alias("host")).agg(F.count_distinct(scalars.link_key(F.col(column))).alias("urls"))


def shown_count(rows: DataFrame, where_: Column) -> DataFrame:
    """How many results a listing has."""
    return rows.filter(where_).agg(F.count("*").alias("n"))


def capped(rows: DataFrame, by: list[str], order: list[Column], caps: dict[str, int], column: str) -> DataFrame:
    """The first rows of each group up to the cap of its kind (a value of `column`); a kind without a cap keeps all."""
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(column))
    place = F.row_number().over(Window.partitionBy(*by, column).orderBy(*order))
    return rows.withColumn("place", place).filter(cap.isNull() | (F.col("place") <= cap))
