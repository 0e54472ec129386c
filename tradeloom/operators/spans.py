"""Word spans of a query: n-grams, overlaps, selection, chunks, and the merge of segment contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ngrams(df: DataFrame, key: str, text: str, least: int = 2, most: int = 8) -> DataFrame:
    """(key, start, size, span) of all runs of `least` to `most` words."""
    words = df.select(key, F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != "").alias("w"))
    starts = words.select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("start")).filter(F.size("w") > 0)
    sizes = F.explode(F.sequence(F.lit(least), F.lit(most))).alias("size")
    spans = starts.select(key, "w", "start", sizes).filter(F.col("start") + F.col("size") - 1 <= F.size("w"))
    return spans.select(key, (F.col("start") - 1).alias("start"), "size", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("span"))


def overlap_bonus(spans: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Spans with the greatest score of a span that begins in them and ends behind them, times `share`."""
    other = spans.groupBy(F.col(key).alias("_k"), F.col("start").alias("_s"), (F.col("start") + F.col("size")).alias("_e")).agg(F.max("score").alias("_x"))
    end = F.col("start") + F.col("size")
    inside = F.when(F.col("size") > 1, F.sequence(F.col("start") + 1, end - 1))
    at = spans.withColumn("_at", F.explode_outer(inside))
    crossing = (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_s")) & (F.col("_e") > end)
    return at.join(other, crossing, "left").groupBy(*spans.columns).agg((F.coalesce(F.max("_x"), F.lit(0.0)) * share).alias("bonus"))


def suppress(spans: list[dict]) -> list[dict]:
    """Greedy selection without overlaps: by priority, score, size, then start; the rest of a kept span's place is gone."""
    kept, taken = [], set()
    for s in sorted(spans, key=lambda s: (-s.get("priority", 0), -s["score"], -s["size"], s["start"])):
        place = set(range(s["start"], s["start"] + s["size"]))
        if not place & taken:
            kept.append(s)
            taken |= place
    return sorted(kept, key=lambda s: s["start"])


def absorb(spans: list[dict]) -> list[dict]:
    """suppress() with a memory: a span that loses its place leaves its category, and those it took itself, in `also` of the first winner it meets."""
    kept = []
    for s in sorted(spans, key=lambda s: (-s.get("priority", 0), -s["score"], -s["size"], s["start"])):
        winner = next((k for k in kept if s["start"] < k["start"] + k["size"] and s["start"] + s["size"] > k["start"]), None)
        if winner is None:
            kept.append({**s, "also": list(s.get("also", []))})
            continue
        for category in [*s.get("also", []), s["category"]]:
            if category != winner["category"] and category not in winner["also"]:
                winner["also"].append(category)
    return sorted(kept, key=lambda s: s["start"])


def bridge(kept: list[dict], words: int) -> list[dict]:
    """Words between two kept spans go to the one before; words ahead of the first to the first."""
    out = [dict(s) for s in kept]
    for i, s in enumerate(out):
        end = out[i + 1]["start"] if i + 1 < len(out) else words
        begin = 0 if i == 0 else s["start"]
        s["start"], s["size"] = begin, end - begin
    return out


def greedy_chunks(words: list[str], score, least: float = 0.2) -> list[tuple[str, float]]:
    """Chunks that grow word by word while their score rises; those above `least` are kept."""
    out, i = [], 0
    while i < len(words):
        j, best = i + 1, score(words[i])
        while j < len(words) and (s := score(" ".join([*words[i : j], words[j]]))) > best:
            best, j = s, j + 1
        if best > least:
            out.append((" ".join(words[i:j]), best))
        i = j
    return out


def suppress_by(df: DataFrame, key: str) -> DataFrame:
    """suppress() for the spans of each query, which are few."""
    import pandas as pd

    kinds = dict(df.dtypes)

    def run(pdf):
        rows = suppress([{**r, "start": int(r["start"]), "size": int(r["size"])} for r in pdf.to_dict("records")])
        return pd.DataFrame(rows, columns=list(pdf.columns))

    return df.groupBy(key).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in df.columns))


def bridged_by(kept: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """bridge() for each query's kept spans: (key, start, size). lengths: key, words. A query without spans has none."""
    order = Window.partitionBy(key).orderBy("start")
    rows = kept.join(lengths, key).withColumns({"_next": F.lead("start").over(order), "_first": F.row_number().over(order) == 1})
    begin = F.when(F.col("_first"), 0).otherwise(F.col("start"))
    return rows.select(key, begin.alias("start"), (F.coalesce("_next", "words") - begin).alias("size"))


def merge_contexts(contexts: list[dict]) -> dict:
    """The contexts of a question's segments as one: the best type, the first status, all conditions (the first of each property)."""
    out = {"type": None, "status": None, "condition": {}}
    for c in sorted(contexts, key=lambda c: -c.get("score", 0.0)):
        out["type"] = out["type"] or c.get("type")
    for c in contexts:
        out["status"] = out["status"] or c.get("status")
        for k, v in (c.get("condition") or {}).items():
            out["condition"].setdefault(k, v)
    return out
