"""Vectors, score matrices, assignment and hybrid search."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import predicate


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def cosine_to(column: Column, vector: list[float]) -> Column:
    """Cosine with a fixed vector, whose own length is worked out once."""
    norm = math.sqrt(sum(x * x for x in vector))
    if not norm:
        return F.lit(0.0)
    own = F.sqrt(dot(column, column))
    return F.when(own == 0, 0.0).otherwise(dot(column, F.array(*[F.lit(float(x)) for x in vector])) / (own * F.lit(norm)))


def nearest(df: DataFrame, column: str, vector: list[float], k: int, key: str, where: Column | None = None) -> DataFrame:
    """The k rows of greatest cosine, filtered first; ties by key."""
    kept = df.filter(where) if where is not None else df
    return kept.withColumn("score", cosine_to(F.col(column), vector)).orderBy(F.desc("score"), key).limit(k)


def max_pool(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The greatest weighted score of a bank's phrases, 0 at least."""
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(score)).alias("pooled"))


def double_center(cells: DataFrame, doc: str, field: str, line: str, score: str) -> DataFrame:
    """Scores less the means of their field and line, plus the mean of all, within a document; -1 cells don't take part."""
    valid = F.when(F.col(score) != -1.0, F.col(score))
    mean = lambda *by: F.avg(valid).over(Window.partitionBy(*by))
    centred = F.col(score) - mean(doc, line) - mean(doc, field) + mean(doc)
    return cells.withColumn("centred", F.when(F.col(score) == -1.0, F.lit(-1.0)).otherwise(centred))


def rivals(cells: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """Each score with the greatest one of its rivals in the same line, and the margin; a lone one has rival 0."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    ranked = cells.withColumn("rank", F.row_number().over(w))
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(score).over(everything)
    second = F.coalesce(F.nth_value(score, 2).over(everything), F.lit(0.0))
    out = ranked.withColumn("rival", F.when(F.col("rank") == 1, second).otherwise(first))
    return out.withColumn("margin", F.col(score) - F.col("rival"))


def exclusive(matrix, absolute: float, margin: float, by_score: bool = False):
    """[(field, line, score)]: greedy one-to-one assignment of a field x line matrix, -1 being no cell.

    A rival is the greatest other field on the same line (0 at least, or only those above the threshold when
    by_score). Cells at the threshold and with the margin are taken by margin, then score, or the other way round;
    equal ones by field, then line.
    """
    found = []
    for f, row in enumerate(matrix):
        for n, own in enumerate(row):
            if own == -1.0 or own < absolute:
                continue
            others = [matrix[g][n] for g in range(len(matrix)) if g != f and matrix[g][n] != -1.0]
            rival = max([x for x in others if x >= absolute], default=absolute) if by_score else max([0.0, *others])
            lead = own - rival
            if lead >= margin:
                found.append(((own, lead) if by_score else (lead, own), f, n, own))
    found.sort(key=lambda x: (-x[0][0], -x[0][1], x[1], x[2]))
    fields, lines, out = set(), set(), []
    for _, f, n, own in found:
        if f not in fields and n not in lines:
            fields.add(f)
            lines.add(n)
            out.append((f, n, own))
    return out


def exclusive_by_document(cells: DataFrame, doc: str, field: str, line: str, score: str, absolute: float, margin: float, by_score=False) -> DataFrame:
    """exclusive() for the matrix of each document; a page's matrix is small by nature."""
    def run(pdf):
        fields, lines = sorted(pdf[field].unique()), sorted(pdf[line].unique())
        table = [[-1.0] * len(lines) for _ in fields]
        at = {f: i for i, f in enumerate(fields)}, {n: i for i, n in enumerate(lines)}
        for f, n, s in zip(pdf[field], pdf[line], pdf[score]):
            table[at[0][f]][at[1][n]] = s
        got = exclusive(table, absolute, margin, by_score)
        return pd.DataFrame({doc: [pdf[doc].iloc[0]] * len(got), field: [fields[f] for f, _, _ in got], line: [lines[n] for _, n, _ in got], score: [s for *_, s in got]})

    kinds = dict(cells.dtypes)
    return cells.groupBy(doc).applyInPandas(run, f"{doc} {kinds[doc]}, {field} {kinds[field]}, {line} {kinds[line]}, {score} double")


def softmax(df: DataFrame, by: list[str], score: str, temperature: float = 0.05) -> DataFrame:
    """Each score's share of its group's exponentials; two aggregations joined back, so that no task holds a whole group."""

    def joined(rows, part, name):
        keys = part.select(*[F.col(c).alias(f"_k{c}") for c in by], name)
        return rows.join(keys, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in by]).drop(*[f"_k{c}" for c in by])

    rows = joined(df, df.groupBy(*by).agg(F.max(score).alias("_most")), "_most").withColumn("_e", F.exp((F.col(score) - F.col("_most")) / temperature))
    rows = joined(rows, rows.groupBy(*by).agg(F.sum("_e").alias("_all")), "_all")
    return rows.withColumn("probability", F.col("_e") / F.col("_all")).drop("_e", "_most", "_all")


def decayed_top(df: DataFrame, by: list[str], score: str, key: str, k: int = 5) -> DataFrame:
    """The k greatest scores, each counting half of the one before."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    top = df.withColumn("_r", rank).filter(F.col("_r") <= k)
    return top.groupBy(*by).agg(F.sum(F.col(score) * F.pow(F.lit(0.5), F.col("_r") - 1)).alias("decayed"))


def top_mean(df: DataFrame, by: list[str], score: str, key: str, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    return df.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*by).agg(F.avg(score).alias("top_mean"))


def hybrid_search(docs: DataFrame, key: str, texts: list[str], words: str, vectors: DataFrame, vector_key: str, vector: str, query: list[float], where: Column, limit: int, offset: int = 0) -> DataFrame:
    """Three tracks, each of limit + offset rows by key or distance: filter +3, all words +2, nearest +1 less .001 a rank; summed."""
    n = limit + offset
    by_filter = docs.filter(where).orderBy(key).limit(n).select(F.col(key).alias("id"), F.lit(3.0).alias("score"))
    by_text = docs.filter(where & predicate.all_words(words, texts)).orderBy(key).limit(n).select(F.col(key).alias("id"), F.lit(2.0).alias("score"))
    near = vectors.join(docs.filter(where).select(F.col(key).alias("_id")), F.col(vector_key) == F.col("_id"), "left_semi")
    near = nearest(near, vector, query, n, vector_key).select(F.col(vector_key).alias("id"), F.col("score").alias("s"))
    ranked = near.withColumn("score", 1.0 - (F.row_number().over(Window.orderBy(F.desc("s"), "id")) - 1) * 0.001).select("id", "score")  # n rows
    tracks = reduce(lambda a, b: a.unionByName(b), [by_filter, by_text, ranked])
    summed = tracks.groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("tracks"))
    return predicate.page(summed, [F.desc("score"), F.asc("id")], limit, offset)


def self_similarity(df: DataFrame, by: str, order: str, vector: str, strides: range) -> DataFrame:
    """(by, stride, similarity): mean cosine of each vector and the one `stride` places on."""
    w = Window.partitionBy(by).orderBy(order)
    rows = df.select(by, vector, *[F.lead(vector, k).over(w).alias(f"_{k}") for k in strides])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("stride"), F.col(f"_{k}").alias("other")) for k in strides]))
    flat = rows.select(by, F.col(vector).alias("_v"), pairs.alias("p")).filter(F.col("p.other").isNotNull())
    return flat.groupBy(by, F.col("p.stride").alias("stride")).agg(F.avg(cosine(F.col("_v"), F.col("p.other"))).alias("similarity"))


def hashed_vector(text: Column, size: int = 64, gram: int = 3) -> Column:
    """A unit vector of hashed letter n-grams: the stand-in for an embedding model, the same everywhere."""
    grams = F.transform(scalars.letter_grams(text, gram), lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm))


def chunked_vector(embed, words: int = 512):
    """A function of a text column that gives its vector: embed(list of words) of every run of `words`, each at unit length, their mean at unit
    length again. The model is loaded once a worker by what `embed` holds; equal texts of a batch are embedded once. A text without words has zeros."""

    def unit(v):
        n = float(np.linalg.norm(v))
        return v / n if n else v

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}
        size = len(embed(["a"]))

        def of(text):
            if text not in known:
                parts = (text or "").split()
                chunks = [unit(np.asarray(embed(parts[i : i + words]), dtype=float)) for i in range(0, len(parts), words)]
                known[text] = unit(np.mean(chunks, axis=0)).tolist() if chunks else [0.0] * size
            return known[text]

        return texts.map(of, na_action=None)

    return run
