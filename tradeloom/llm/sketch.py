"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

K = 128
SHINGLE = 5
LEAST = -(2**63)
PREFIX = 24  # characters of a text that tell rows of one id apart where ranges are cut
SAMPLES = 8  # rows sampled for each range
RANGE_BYTES = 16_000_000
MOST_RANGES = 1 << 16  # so that the cuts, some 60 bytes each, stay a small part of the plan


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The k least hashes of a text's different word shingles, ascending; all of them if there are fewer.

    Words are split at ASCII white space and kept as they are. A text of fewer words than a shingle has one shingle of
    them all, an empty or null text none.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h):
        n = F.size(h)
        whole = F.array(F.xxhash64(h))
        starts = F.sequence(F.lit(0), n - size)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, whole).otherwise(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)])))

    # a one-element transform holds the words' hashes once
    got = F.transform(F.array(hashes), shingles)[0]
    return F.slice(F.sort_array(F.array_distinct(got)), 1, k)


def text_of(sketched: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash, in order."""
    return F.array_join(F.transform(sketched, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets of shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def shared(a: Column, b: Column, k: int = K) -> Column:
    return F.size(F.array_intersect(F.array_intersect(merged(a, b, k), a), b))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles in all of both; exact where both sets have k shingles at most together. Two empty sets: 1."""
    n = F.size(merged(a, b, k))
    return F.when(n == 0, F.lit(1.0)).otherwise(shared(a, b, k) / n)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of different shingles; exact below k."""
    last = F.get(a, F.lit(k - 1)).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((last - F.lit(float(LEAST)) + 1) / 2.0**64))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too; an empty a: 1."""
    whole = distinct_shingles(merged(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), whole / distinct_shingles(a, k)))


def merge_sketches(sketches: DataFrame, key: str, column: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """The sketch of each group's union, from its members' sketches.

    A hash is kept per (key, salt) if it is among the k least there, by a salt of the hash itself, so a large group
    is spread over tasks and what meets in the last one is salts x k numbers at most. Null keys are a group.
    """
    hashes = sketches.select(F.col(key), F.explode(column).alias("h")).distinct().withColumn("_salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    rank = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("h"))
    few = hashes.withColumn("_r", rank).filter(F.col("_r") <= k)
    return few.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(column))


def boundaries(base: DataFrame, ranges: int, rows: int) -> list[tuple]:
    """Up to ranges - 1 ascending keys (doc_id, first PREFIX characters of the text) that cut the table into runs of about as many rows.

    They come from a sample of SAMPLES rows a range, and only even out the ranges: whatever they are, each row is in one
    range, by its order. Equal ids, null ones too, are cut by their texts' starts.
    """
    keys = base.select("doc_id", F.substring("text", 1, PREFIX).alias("start"))
    share = SAMPLES * ranges / max(1, rows)
    got = sorted(((r[0] is not None, r[0] or 0, r[1].encode()), r[0], r[1]) for r in (keys if share >= 1 else keys.sample(share, 7)).collect())
    cuts = [got[len(got) * i // ranges] for i in range(1, ranges)] if got else []
    return [(c[1], c[2]) for c, before in zip(cuts, [None, *cuts]) if before is None or c[0] != before[0]]


def range_of(cuts: list[tuple]) -> Column:
    """How many cuts are at or below the row's key, by halving; null ids come first."""
    if not cuts:
        return F.lit(0)
    listed = F.from_json(F.lit(json.dumps([{"doc_id": i, "start": t} for i, t in cuts])), "array<struct<doc_id:bigint,start:string>>")
    key = F.struct("doc_id", F.substring("text", 1, PREFIX).alias("start"))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def step(at, by):
        return F.when((at + by <= len(cuts)) & (F.get(listed, at + by - 1) <= key), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, made, doc_id="doc_id", text="text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, next_text, made and next_made: also of the next document by descending doc_id, of the first for the last one.

    made(text) is a column computed once for each document.
    Documents are dealt to ranges of (doc_id, text) of about `range_bytes` and each range is ordered for itself; only the first row
    of each range goes on to the range before it. Null texts are empty, null ids come last, equal ids are ordered by text.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, size = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cuts = boundaries(base, max(1, min(MOST_RANGES, size // range_bytes)), rows)
    dealt = base.withColumn("_in", range_of(cuts))
    order = Window.partitionBy("_in").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    own = dealt.withColumn("_next", F.lead("text").over(order)).withColumn("made", made(F.col("text"))).withColumn("_made", F.lead("made").over(order))
    # the first row of each range: its key from short columns, then the texts that have that key
    start = F.substring("text", 1, PREFIX)
    keys = dealt.groupBy("_in").agg(F.max(F.struct("doc_id", start.alias("start"))).alias("_key"))
    first = dealt.join(F.broadcast(keys.withColumnRenamed("_in", "_of")), (F.col("_in") == F.col("_of")) & F.struct("doc_id", start.alias("start")).eqNullSafe(F.col("_key")))
    tops = first.groupBy("_in").agg(F.max("text").alias("_top"))
    around = Window.orderBy(F.col("_in").desc())  # one row for each range, MOST_RANGES at most
    tops = tops.withColumn("_after", F.coalesce(F.lead("_top").over(around), F.first("_top").over(around))).select("_in", "_after").withColumn("_after_made", made(F.col("_after")))
    return own.join(tops, "_in").select("doc_id", "text", "made", F.coalesce("_next", "_after").alias("next_text"), F.coalesce("_made", "_after_made").alias("next_made"))


def fingerprint_edits(docs: DataFrame, doc_id="doc_id", text="text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Sketches of every text and of its edited form (its last half replaced by the start of the next document), and how alike they are.

    near_edited and near_next are resemblances by the sketches; contained is the share of the text's shingles that
    the edited text keeps, distinct_est the number of the text's different shingles. Equal texts have equal sketches.
    Null texts are empty; a sole document is its own next. Repeated rows keep a row each, an empty table gives none.
    """
    near = with_next(docs, lambda t: sketch(t, k, size), doc_id, text)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = near.select("doc_id", n.cast("long").alias("n_chars"), "made", "next_made", edited.alias("edited"))
    made = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("made").alias("s"),
        sketch(F.col("edited"), k, size).alias("e"),
        F.col("next_made").alias("x"),
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("s")).alias("fingerprint"),
        text_of(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("x"), k).alias("near_next"),
        containment(F.col("s"), F.col("e"), k).alias("contained"),
        distinct_shingles(F.col("s"), k).alias("distinct_est"),
    )


def op5_bottom_k(spark, sf_dir) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
