"""Draft and record counts, ranges of properties, and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draft_counts(df: DataFrame, keys: list[str], is_draft: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(is_draft).alias("draft"), F.count_if(~is_draft).alias("n"))


def apply_deltas(counts: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Counts after signed changes, never below zero."""
    both = counts.select(*keys, "draft", "n").unionByName(deltas.select(*keys, "draft", "n"))
    summed = both.groupBy(*keys).agg(F.sum("draft").alias("draft"), F.sum("n").alias("n"))
    return summed.withColumns({c: F.greatest(F.lit(0), F.col(c)) for c in ("draft", "n")})


def ranges(df: DataFrame, keys: list[str], properties: list[str], zero_counts: tuple[str, ...] = ()) -> DataFrame:
    """(keys, property, min, max) of numbers that are not zero; 0 where there is none. zero_counts: where zero is a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("double").alias("x")) for p in properties]))
    rows = df.select(*keys, pairs.alias("p")).select(*keys, "p.*")
    kept = rows.withColumn("x", F.when((F.col("x") != 0) | F.col("property").isin(*zero_counts), F.col("x")) if zero_counts else F.nullif(F.col("x"), F.lit(0.0)))
    return kept.groupBy(*keys, "property").agg(F.coalesce(F.min("x"), F.lit(0.0)).alias("min_value"), F.coalesce(F.max("x"), F.lit(0.0)).alias("max_value"))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): trimmed lines that are not empty."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).filter(F.col("line") != "")


def line_frequency(lines: DataFrame, key: str) -> DataFrame:
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct(key).alias("items"), F.min("pos").alias("first_pos"))


def boilerplate(lines: DataFrame, key: str, group: str, share: float = 0.7) -> DataFrame:
    """Lines that stand in at least ceil(share x items) of a group's items."""
    found = lines.groupBy(group, "line").agg(F.count_distinct(key).alias("items"))
    sizes = lines.groupBy(group).agg(F.count_distinct(key).alias("all_items"))
    return found.join(sizes, group).filter(F.col("items") >= F.ceil(F.col("all_items") * share))


def gaps(lines: DataFrame, key: str) -> DataFrame:
    """For lines that occur again in an item: least and greatest distance between neighbours, and how many."""
    before = F.lag("pos").over(Window.partitionBy(key, "line").orderBy("pos"))
    rows = lines.withColumn("gap", F.col("pos") - before).filter(F.col("gap").isNotNull())
    return rows.groupBy(key, "line").agg(F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.count("*").alias("gaps"))


def group_all_logs(events: DataFrame, keys: list[str], order: str, value: Column, size: int = 300, ranges: int = 64) -> DataFrame:
    """All logs of each key in order, in parts of `size` from 0; n counts all rows of the key.

    A place in the order is the place within a range of order values plus the rows of the key in the ranges before,
    so no task sorts all rows of a hot key.
    """
    cuts = sorted(set(events.select(order).na.drop().approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    range_of = F.coalesce(sum((F.col(order) >= c).cast("int") for c in cuts) if cuts else F.lit(0), F.lit(-1))
    dealt = events.withColumn("_v", value).withColumn("_in", range_of).select(*keys, F.col(order).alias("_o"), "_v", "_in")
    ahead = Window.partitionBy(*keys).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_in").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    placed = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_in").orderBy("_o")))
    placed = placed.join(counts.select(*[F.col(k).alias(f"_k{k}") for k in (*keys, "_in")], "_before", "n"), [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in (*keys, "_in")])
    place = (F.col("_before") + F.col("_r") - 1).alias("_p")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"])
    return placed.select(*keys, "n", "_v", place).withColumn("part", F.floor(F.col("_p") / size)).groupBy(*keys, "part", "n").agg(listed.alias("logs"))
