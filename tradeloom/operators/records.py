"""Records and their JSON payloads: projection, aliases, ingestion, upserts, stored tables, views and look-ups."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payloads, scalars
from ..schema import ENTITY, MESSAGE, TABLE_OF_TYPE, TASK, TYPES_OF_MODE
from . import store

# The keys of a payload that are looked up by equality, and those that a listing leaves out.
INDEX_KEYS = ("no", "code", "tracking_number", "goods", "order", "tracking", "stock_keeping_unit", "barcode", "index")
HIDDEN_KEYS = ("type", "item", "node", "link", "origin", "detail")
SYSTEM_COLUMNS = ("from", "to", "cc", "bcc", "ref")
# Where a record's amount and its day come from, in order.
AMOUNT_KEYS = ("total_amount", "sale_price", "supply_price", "price", "shipping_fee", "discount")
DATE_KEYS = ("order_date", "registration_date", "release_date", "manufacture_date", "shipping_date", "started_at", "expired_at", "payment_date")
# Types that are messages, and the tables that types go to when a batch comes in.
MESSAGE_TYPES = ("talk", "prompt", "ai_search")
INGEST_TABLES = {
    "sales": "sales", "goods": "sales", "order": "sales", "tracking": "tracking", "receiving": "tracking", "shipping": "tracking", "event": "event", "coupon": "event",
    "member": "users", "team": "users", "user": "users", "talk": "talks", "prompt": "talks", "ai_search": "talks", "pages": "pages", "page": "pages",
}
SEARCH_TABLES = {**TABLE_OF_TYPE, "review": "event"}
KEY_MAP = "map<string,string>"


def parsed(payload: Column) -> Column:
    """A payload's keys, values as text; nested ones as JSON. An empty map where it is no JSON object."""
    return F.coalesce(F.from_json(payload, KEY_MAP), F.from_json(F.lit("{}"), KEY_MAP))


def with_aliases(data: Column) -> Column:
    """The keys of a payload with tracking from tracking_number and sale_price from price, where these are absent."""

    def fill(m, name, other):
        missing = F.map_contains_key(m, other) & ~F.map_contains_key(m, name)
        return F.when(missing, F.map_concat(m, F.create_map(F.lit(name), F.element_at(m, other)))).otherwise(m)

    return fill(fill(data, "tracking", "tracking_number"), "sale_price", "price")


def first_key(data: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether one of the keys is there, and the value of the first that is, whatever that holds."""
    has = reduce(lambda a, b: a | b, [F.map_contains_key(data, k) for k in keys])
    value = F.lit(None).cast("string")
    for k in reversed(keys):
        value = F.when(F.map_contains_key(data, k), F.element_at(data, F.lit(k))).otherwise(value)
    return has, value


def amount_of(data: Column) -> Column:
    return F.coalesce(first_key(data, AMOUNT_KEYS)[1].try_cast("double"), F.lit(0.0))


def created_of(data: Column, now_ms: Column) -> Column:
    """Epoch milliseconds of the first date key that is there: with a zone, or as UTC without one; of an unreadable one, now;
    where that key is missing or empty, the payload's created_at, else now."""
    _, text = first_key(data, DATE_KEYS)
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    plain = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
    stamp = F.unix_millis(F.when(zoned, text.try_cast("timestamp")).when(plain, F.concat(text, F.lit("Z")).try_cast("timestamp")))
    given = F.coalesce(F.element_at(data, F.lit("created_at")).try_cast("long"), now_ms)
    return F.when(F.coalesce(text, F.lit("")) == "", given).otherwise(F.coalesce(stamp, now_ms))


def decoded(payload: Column) -> Column:
    """A payload whose `data` is base64 of gzip, as what that holds; any other as it is."""
    inner = F.get_json_object(payload, "$.data")
    packed = (F.length(inner) > 50) & inner.startswith("H4sI")
    return F.when(packed, payloads.gunzipped(F.when(packed, F.unbase64(inner)))).otherwise(payload)


def hoisted(data: Column, nested: Column) -> Column:
    """The keys of a record with those of its nested `data` on top of them, and without `data` itself."""
    inner = parsed(nested)
    outer = F.map_filter(data, lambda k, _: (k != "data") & ~F.map_contains_key(inner, k))
    return F.map_concat(outer, inner)


def visible(data: Column) -> Column:
    """The keys of a payload that a listing shows."""
    return F.map_filter(data, lambda k, _: ~k.isin(*HIDDEN_KEYS))


def listed(rows: DataFrame, payload: str = "data") -> DataFrame:
    """Rows as a listing shows them: the payload's shown keys, and no system columns."""
    return rows.withColumn(payload, F.to_json(visible(parsed(F.col(payload))))).drop(*[c for c in SYSTEM_COLUMNS if c in rows.columns])


def documents(rows: DataFrame, schema: T.StructType = ENTITY) -> DataFrame:
    """Rows in the columns of the schema; absent and null ones are empty, zero or false, but vectors stay null."""
    empty = {"string": "", "int": 0, "bigint": 0, "double": 0.0, "boolean": False}
    kind = {f.name: f.dataType.simpleString() for f in schema}
    cols = [(F.col(f"`{c}`").cast(k) if c in rows.columns else F.lit(None).cast(k)) for c, k in kind.items()]
    return rows.select(*[(F.coalesce(x, F.lit(empty[k])) if k in empty else x).alias(c) for x, (c, k) in zip(cols, kind.items())])


def enriched(rows: DataFrame, payload: str = "data") -> DataFrame:
    """Rows with the payload's look-up keys as text, and status, amount, mode, masking, texts and stamps of the row, else of the payload, else empty."""
    data = parsed(F.col(payload))
    pick = lambda c, k: F.col(c) if c in rows.columns else F.lit(None).cast(k)
    of = lambda c, k, *also: F.coalesce(pick(c, k).cast(k), *[F.element_at(data, F.lit(x)).try_cast(k) for x in (c, *also)])
    out = {k: F.element_at(data, F.lit(k)) for k in INDEX_KEYS}
    out |= {"status": F.coalesce(of("status", "int"), F.lit(0)), "amount": F.coalesce(of("amount", "double", "total_amount"), F.lit(0.0)), "mode": F.coalesce(of("mode", "string"), F.lit("commerce"))}
    out |= {"is_masked": F.coalesce(of("is_masked", "boolean"), F.lit(False)), "text": F.coalesce(of("text", "string"), F.lit("")), "masked_text": F.coalesce(of("masked_text", "string"), F.lit(""))}
    out |= {c: F.coalesce(of(c, "bigint"), F.lit(0).cast("bigint")) for c in ("created_at", "updated_at")}
    return rows.withColumns(out)


def entity_rows(rows: DataFrame, payload: str, now_ms: int) -> DataFrame:
    """Rows of the entity schema from (id, type, from, to, cc, bcc, ref, digest, payload): decoded, with aliases, amount and dates."""
    data = parsed(F.col("_data"))
    own = parsed(F.col(payload))
    stamp = F.coalesce(F.element_at(own, F.lit("updated_at")).try_cast("long"), F.lit(now_ms).cast("long"))
    word = F.element_at(own, F.lit("status"))
    built = rows.withColumn("_data", decoded(F.col(payload))).withColumns(
        {
            "data": F.to_json(with_aliases(data)),
            "text": F.coalesce(F.element_at(data, F.lit("text")), F.lit("")),
            "masked_text": F.coalesce(F.element_at(data, F.lit("masked_text")), F.lit("")),
            "status": F.when(word.rlike("[A-Za-z]"), scalars.status_code(word)).otherwise(0),
            "amount": amount_of(own),
            "created_at": created_of(own, stamp),
            "updated_at": stamp,
            "mode": F.coalesce(F.element_at(own, F.lit("mode")), F.lit("commerce")),
            "is_masked": F.coalesce(F.element_at(own, F.lit("is_masked")).try_cast("boolean"), F.lit(False)),
        }
    )
    return documents(built)


def upsert_items(stored: DataFrame, new: DataFrame, payload: str, now_ms: int) -> DataFrame:
    """A table of entities after new payloads: the latest of an id replaces the stored row.

    Rows without an id are left out. A row whose digest is the stored one's, and which isn't newer, changes nothing.
    """
    rows = entity_rows(new.filter(F.coalesce("id", F.lit("")) != ""), payload, now_ms)
    return upserted(stored, rows)


def upserted(stored: DataFrame, rows: DataFrame) -> DataFrame:
    fresh = store.latest(rows, ["id"], [F.desc("updated_at"), F.desc("digest"), F.desc("data")])
    old = stored.select("id", F.col("digest").alias("_digest"), F.col("updated_at").alias("_at"))
    same = (F.col("_at") >= F.col("updated_at")) & (F.col("digest") != "") & (F.col("digest") == F.col("_digest"))
    fresh = fresh.join(old, "id", "left").filter(~F.coalesce(same, F.lit(False))).drop("_digest", "_at")
    return stored.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def ingested(batch: DataFrame, payload: str = "item") -> tuple[DataFrame, DataFrame]:
    """(entities, messages) of a batch of JSON items: types in lower case, `data` hoisted, a table for each.

    Both have id, type, target and data; items without an id are left out. An item of an unknown type is a page if its
    data has an origin, else one of `items`. A message's data is its text (or query), link and origin.
    """
    item = parsed(F.col(payload))
    kind = F.lower(F.coalesce(F.element_at(item, F.lit("type")), F.lit("")))
    rows = batch.select(F.element_at(item, F.lit("id")).alias("id"), kind.alias("type"), item.alias("_item"), F.element_at(item, F.lit("data")).alias("_nested")).filter(F.coalesce("id", F.lit("")) != "")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in INGEST_TABLES.items() for x in kv]), F.col("type"))
    inner = parsed(F.col("_nested"))
    target = F.coalesce(known, F.when(F.map_contains_key(inner, F.lit("origin")), "pages").otherwise("items"))
    rows = rows.withColumn("target", target)
    talk = F.col("type").isin(*MESSAGE_TYPES)
    typed = F.map_concat(F.map_filter("_item", lambda k, _: k != "type"), F.create_map(F.lit("type"), F.col("type")))
    entities = rows.filter(~talk).select("id", "type", "target", F.to_json(hoisted(typed, F.col("_nested"))).alias("data"))
    pick = lambda *names: F.coalesce(*[F.element_at("_item", F.lit(n)) for n in names], F.element_at(inner, F.lit(names[0])), F.lit(""))
    message = F.struct(pick("text", "query").alias("text"), pick("link").alias("link"), pick("origin").alias("origin"))
    role = F.when(F.col("type") == "talk", "user").otherwise("system_task")
    messages = rows.filter(talk).select("id", "type", "target", F.to_json(message).alias("data"), role.alias("role"), pick("text", "query").alias("text"))
    return entities, messages


def hit(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none: of several, the one updated last."""
    order = [F.desc(c) for c in ("updated_at",) if c in table.columns]
    return table.filter(F.col(key) == F.lit(value)).orderBy(*order, key).limit(1)


def add_rows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new rows behind; columns that they don't have are null."""
    return stored.unionByName(new, allowMissingColumns=True).select(*stored.columns)


def replace_status(messages: DataFrame, ids: DataFrame, status: int, now_ms: int) -> DataFrame:
    """Messages of these ids taken out and put in again with a new status and stamp."""
    moved = messages.join(ids.select("id").distinct(), "id", "left_semi").withColumns({"status": F.lit(status), "updated_at": F.lit(now_ms).cast("long")})
    return store.delete_ids(messages, ids).unionByName(moved.select(*messages.columns))


def target_of(kind: Column, way: str = "store") -> Column:
    """The table of a type as the store, the ingestion of batches or the search sees it; `items` for any other."""
    pairs = {"store": {**TABLE_OF_TYPE}, "ingest": INGEST_TABLES, "search": SEARCH_TABLES}[way]
    if way == "store":
        pairs.pop("review", None)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.lower(kind)), F.lit("items"))


def allowed_types(mode: Column, kind: Column) -> Column:
    """Whether a type is listed in a mode; a mode without a list lists all."""
    lists = [F.when(mode == m, kind.isin(*types)) for m, types in TYPES_OF_MODE.items()]
    return F.coalesce(*lists, F.lit(True))


# ---- stored tables

SCHEMAS = {**dict.fromkeys(("items", "sales", "tracking", "event", "users", "pages"), ENTITY), "tasks": TASK, "talks": MESSAGE}


class Store:
    """Tables of fixed schemas under one path, as Parquet; every write goes to a new version that one small file names."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None):
        self.spark, self.path, self.schemas = spark, path, schemas or SCHEMAS
        self._jvm = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read_text(self, name: str) -> str | None:
        if not self._files.exists(self._at(name)):
            return None
        source = self._files.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def _write_text(self, name: str, text: str) -> None:
        out = self._files.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def config(self) -> dict:
        return json.loads(self._read_text("config.json") or "{}")

    def save_config(self, values: dict) -> None:
        self._write_text("config.json", json.dumps(values, sort_keys=True))

    def get(self, key: str):
        """A value of the key-value store."""
        return self.config().get("kv", {}).get(key)

    def set(self, key: str, value) -> None:
        now = self.config()
        self.save_config({**now, "kv": {**now.get("kv", {}), key: value}})

    def _version(self, table: str) -> int | None:
        text = self._read_text(f"{table}.version")
        return int(text) if text else None

    def read(self, table: str) -> DataFrame:
        """The table; empty if it is new, unreadable, or of another schema than its own."""
        schema, version = self.schemas[table], self._version(table)
        if version is not None:
            try:
                df = self.spark.read.parquet(f"{self.path}/{table}/{version}")
                if [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]:
                    return df
            except Exception as e:  # noqa: BLE001  a folder that is no table
                if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e) and "CANNOT_READ_FILE" not in str(e):
                    raise
        return self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Several tables at once: all are written as new versions first, then named, so a reader never sees half a table."""
        made = {}
        for name, df in tables.items():
            want = self.schemas[name]
            if df.columns != want.fieldNames():
                raise ValueError(f"columns of {name} are {df.columns}")
            version = (self._version(name) or 0) + 1
            df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in want]).write.mode("overwrite").parquet(f"{self.path}/{name}/{version}")
            made[name] = version
        for name, version in made.items():
            self._write_text(f"{name}.version", str(version))

    def reset(self) -> None:
        """Back to a store without tables."""
        for name in self.schemas:
            self._files.delete(self._at(f"{name}.version"), False)
            self._files.delete(self._at(name), True)

    def snapshot(self, limits: dict[str, int] | None = None) -> dict[str, DataFrame]:
        """What an opening screen shows: waiting and running tasks, and the newest rows of pages, users and items."""
        limits = limits or {"pages": 1000, "users": 50, "items": 50}
        out = {"tasks": self.read("tasks").orderBy("created_at", "id")}
        return out | {t: self.read(t).orderBy(F.desc("created_at"), "id").limit(n) for t, n in limits.items()}


# ---- set operations and orders


def union_rows(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, repeated ones too, with the number of their table as `track`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("track", F.lit(i)) for i, t in enumerate(tables)])


def except_ids(rows: DataFrame, *shown: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in none of the tables."""
    return reduce(lambda df, ids: df.join(ids.select(key), key, "left_anti"), shown, rows)


def chat_order(messages: DataFrame) -> DataFrame:
    """Messages by age, a question before what stands at the same time; of repeated ids the last by updated_at stays."""
    last = store.latest(messages, ["id"], [F.desc("updated_at"), F.desc("text")])
    return last.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy("created_at", F.when(F.col("id").contains("_query"), 0).otherwise(1), "id")))


def newer_cards(shown: DataFrame, batch: DataFrame) -> DataFrame:
    """A list after a batch: a card is replaced only by one that is strictly newer, new ones come in, newest first."""
    newest = store.latest(batch, ["id"], [F.desc("updated_at"), F.desc("created_at")])
    both = shown.withColumn("_new", F.lit(0)).unionByName(newest.withColumn("_new", F.lit(1)))
    return store.latest(both, ["id"], [F.desc("updated_at"), F.asc("_new")]).drop("_new").orderBy(F.desc("created_at"), "id")


# ---- look-ups and views


def document_for(keys: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """keys with the id of their document: by id, else by the id in the payload, else by the index in it, else by a payload that holds the key as a word.

    rows: id and data. `way` names how it was found; of several the least id counts.
    """
    data = parsed(F.col("data"))
    ways = [
        rows.select(F.col("id").alias("_key"), F.lit(0).alias("_w"), "id"),
        rows.select(F.element_at(data, F.lit("id")).alias("_key"), F.lit(1).alias("_w"), "id"),
        rows.select(F.element_at(data, F.lit("index")).alias("_key"), F.lit(2).alias("_w"), "id"),
        rows.select(F.explode(F.array_distinct(F.split("data", r"[^\p{L}\p{N}]+"))).alias("_key"), F.lit(3).alias("_w"), "id"),
    ]
    wanted = keys.select(F.col(key).cast("string").alias("_key")).distinct()
    found = reduce(lambda a, b: a.unionByName(b), ways).filter(F.coalesce("_key", F.lit("")) != "").join(wanted, "_key", "left_semi")
    best = found.groupBy("_key").agg(F.min(F.struct("_w", "id")).alias("_best"))
    names = F.when(F.col("_best._w") == 0, "id").when(F.col("_best._w") == 1, "payload id").when(F.col("_best._w") == 2, "payload index").when(F.col("_best._w") == 3, "payload word")
    return keys.join(best, keys[key].cast("string") == F.col("_key"), "left").select(*keys.columns, F.col("_best.id").alias("document"), names.alias("way"))


def pages_view(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages and those items that are pages, each id once, titled by the first item of the same ref, else by itself.

    Both: id, type, ref, title, origin. An item counts as a page by its type or by an origin.
    """
    titles = items.filter(F.coalesce("ref", F.lit("")) != "").groupBy(F.col("ref").alias("_ref")).agg(F.min_by("title", "id").alias("_title"))
    all_ = store.union_first("id", pages, items.filter((F.lower("type") == "pages") | (F.coalesce("origin", F.lit("")) != "")))
    return all_.join(titles, F.col("ref") == F.col("_ref"), "left").withColumn("title", F.coalesce(F.nullif("_title", F.lit("")), "title")).drop("_ref", "_title")


def cached_page(links: DataFrame, key: str, link: str, pages: DataFrame) -> DataFrame:
    """links with the id of their cached page: by id, else by the longest path of a page that begins the link's.

    pages: id and path. Instead of comparing every link with every page, each link asks for its own path and the
    paths above it.
    """
    _, path, _ = scalars.url_parts(F.col(link))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    asked = links.select(key, F.explode(heads).alias("_path"))
    by_path = pages.groupBy(F.col("path").alias("_path")).agg(F.min("id").alias("_id"))
    found = asked.join(by_path, "_path").groupBy(key).agg(F.max_by("_id", F.length("_path")).alias("_by_path"))
    own = pages.select(F.col("id").cast("string").alias("_page"))
    out = links.join(found, key, "left").join(own, F.col(key).cast("string") == F.col("_page"), "left")
    return out.select(*links.columns, F.coalesce("_page", F.col("_by_path").cast("string")).alias("page"))


def replaced_invites(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members without the pending invites that a member who joined stands for, by address or mail.

    members: id, from, email, pending; joined: from, email."""
    known = joined.select(F.explode(F.array_distinct(F.array(F.lower("from"), F.lower("email")))).alias("_who")).filter("_who <> ''").distinct()
    pending = members.filter("pending")
    gone = pending.join(known, F.lower("from") == F.col("_who"), "left_semi").unionByName(pending.join(known, F.lower("email") == F.col("_who"), "left_semi")).select("id").distinct()
    return store.delete_ids(members, gone)


def answered(rows: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the answer a model gave for their key; answers to unknown keys are dropped, the last one of a key counts."""
    last = store.latest(answers, [key], [F.desc("at"), F.desc("answer")])
    return rows.join(last.select(key, "answer"), key)


def matched_rows(rows: DataFrame, matches: DataFrame, limit: int = 100) -> DataFrame:
    """The rows of a vector search's matches (id, score), best first."""
    return rows.join(matches, "id").orderBy(F.desc("score"), "id").limit(limit)


def exact_first(rows: DataFrame, number: Column, results: DataFrame) -> DataFrame:
    """Rows with exactly this tracking number before the other results, each id once."""
    hits = rows.filter(scalars.clean_no(F.col("tracking_number")) == scalars.clean_no(number)).select("id", F.lit(0).alias("place"))
    both = hits.unionByName(results.select("id", F.lit(1).alias("place")))
    return both.groupBy("id").agg(F.min("place").alias("place")).orderBy("place", "id")


def repair_counts(texts: DataFrame, text: str) -> DataFrame:
    """How many payloads were JSON as they came, could be repaired, or could not."""
    clean = F.try_parse_json(text).isNotNull()
    state = F.when(clean, "clean").when(payloads.repaired(text).isNotNull(), "repaired").otherwise("lost")
    return texts.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
