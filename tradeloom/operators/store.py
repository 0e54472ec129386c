"""Reading and writing of record tables: paging, upserts, deletes, routing and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..schema import TABLE_OF_TYPE


def open_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table whose columns are exactly those of the schema; anything else is refused."""
    df = spark.read.parquet(path)
    if schema is not None and df.columns != schema.fieldNames():
        raise ValueError(f"columns of {path} are {df.columns}")
    return df


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by the order, which has to be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: list[Column], guard: str | None = None) -> DataFrame:
    """Latest new row per key in place of the stored one; a row whose guard column equals the stored one changes nothing."""
    fresh = latest(new, [key], order)
    if guard:
        same = stored.select(key, F.col(guard).alias("_guard"))
        fresh = fresh.join(same, key, "left").filter(~F.col(guard).eqNullSafe(F.col("_guard")) | F.col("_guard").isNull()).drop("_guard")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.unionByName(new.join(stored.select(key), key, "left_anti"))


def merge(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge by key: a new value wins unless it is null, empty or zero."""
    a, b = stored.alias("a"), new.alias("b")
    merged = [scalars.merge_value(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *merged)


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def exists(df: DataFrame, where: Column) -> bool:
    return not df.filter(where).limit(1).isEmpty()


def route(kind: Column) -> Column:
    """The table that rows of a type go to; `items` for any other."""
    pairs = [F.lit(x) for kv in TABLE_OF_TYPE.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(kind)), F.lit("items"))


def sync_delta(server: DataFrame, local: DataFrame, key: str, stamp: str) -> DataFrame:
    """Server rows that are unknown here, or strictly newer than what is here."""
    known = local.select(key, F.col(stamp).alias("_stamp"))
    return server.join(known, key, "left").filter(F.col("_stamp").isNull() | (F.col(stamp) > F.col("_stamp"))).drop("_stamp")


def union_first(key: str, *tables: DataFrame) -> DataFrame:
    """All rows, one for each key: of the first table that has it."""
    all_ = tables[0].withColumn("_at", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        all_ = all_.unionByName(t.withColumn("_at", F.lit(i)))
    return latest(all_, [key], [F.col("_at")]).drop("_at")


def key_table(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key_name, key_value, id) for equality look-ups on any of the columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key_name"), F.col(c).cast("string").alias("key_value")) for c in columns]))
    return df.select(F.col(key).alias("id"), pairs.alias("k")).select("k.*", "id").filter(F.col("key_value").isNotNull() & (F.col("key_value") != ""))


def gram_table(df: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(gram, id) of all letter n-grams in lower case: the inverted index of the text track."""
    return df.select(F.explode(F.array_distinct(scalars.letter_grams(F.col(text), size))).alias("gram"), F.col(key).alias("id"))
