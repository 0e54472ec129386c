"""Queries over payloads, ingestion, stored tables, set operations and views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records, store
from ..schema import ENTITY, MESSAGE
from .catalogue import query, table


def _payloads(spark, sf_dir):
    """Orders as JSON payloads in which keys are missing, empty or differently named."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    fields = F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("T"), k)).alias("tracking_number"),
        F.when(k % 4 == 0, F.lit("own")).alias("tracking"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.when(k % 3 == 0, F.lit("7.5")).alias("sale_price"),
        F.when(k % 5 == 0, day).when(k % 5 == 1, F.lit("soon")).alias("order_date"),
        F.when(k % 5 != 2, F.lit("1700000000000")).alias("created_at"),
        F.when(k % 2 == 1, F.lit("complete")).otherwise("9").alias("status"),
        F.lit("note").alias("text"),
        F.lit("1700000000500").alias("updated_at"),
    )
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), k).alias("id"), F.lit("order").alias("type"), F.lit("d").alias("digest"), F.to_json(fields).alias("payload"), k.alias("k"))


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'own' WHEN o_orderkey % 2 = 0 THEN 'T' || o_orderkey ELSE '-' END AS tracking, CASE WHEN o_orderkey % 3 = 0 THEN 7.5 ELSE o_totalprice END AS sale_price,
    CASE WHEN o_orderkey % 3 = 0 THEN 7.5 ELSE o_totalprice END AS amount, CASE WHEN o_orderkey % 2 = 1 THEN 9 ELSE 0 END::INTEGER AS status,
    CASE o_orderkey % 5 WHEN 0 THEN epoch_ms(o_orderdate) WHEN 1 THEN 1700000000500 WHEN 2 THEN 1700000000500 ELSE 1700000000000 END AS created_at, 'commerce' AS mode FROM orders"""
)
def payload_to_entity(spark, sf_dir):
    """Payloads as rows of the entity schema: aliases, amount, status code and day."""
    got = records.entity_rows(_payloads(spark, sf_dir).withColumn("_k", F.col("k")), "payload", 5)
    data = records.parsed(F.col("data"))
    return got.select(
        F.substring("id", 2, 20).cast("long").alias("k"), F.coalesce(F.element_at(data, F.lit("tracking")), F.lit("-")).alias("tracking"), F.element_at(data, F.lit("sale_price")).cast("double").alias("sale_price"), "amount", "status", "created_at", "mode"
    )


@query(
    """SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'd' ELSE 'old' END AS digest, CASE WHEN o_orderkey % 3 = 0 THEN 'stored' ELSE 'note' END AS text FROM orders WHERE o_orderkey % 3 <> 2
    UNION ALL SELECT 'o' || o_orderkey, 'd', 'note' FROM orders WHERE o_orderkey % 3 = 2"""
)
def upsert_with_guard(spark, sf_dir):
    """An upsert in which rows of an unchanged digest, not newer than stored, change nothing."""
    new = _payloads(spark, sf_dir)
    k = F.col("k") % 3
    stored = new.filter(k != 2).select("id", "type", F.when(k == 0, "d").otherwise("old").alias("digest"), F.lit("stored").alias("text"), F.lit(1700000000500).alias("updated_at"))
    out = records.upsert_items(records.documents(stored), new, "payload", 5)
    return out.select("id", F.when(F.col("text") == "stored", F.lit("d")).otherwise(F.when(F.substring("id", 2, 20).cast("long") % 3 == 2, "d").otherwise("old")).alias("digest"), "text")


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sales' WHEN 1 THEN 'talks' WHEN 2 THEN 'pages' ELSE 'items' END AS target, CASE event_id % 4 WHEN 0 THEN 'order' WHEN 1 THEN 'talk' ELSE 'memo' END AS type,
    CASE WHEN event_id % 4 = 1 THEN 'hello' ELSE event_type END AS shown FROM events"""
)
def batch_ingest(spark, sf_dir):
    """A batch of JSON items dealt to tables: nested data hoisted, messages apart."""
    k = F.col("event_id") % 4
    data = F.when(k == 2, F.to_json(F.struct(F.lit("https://a").alias("origin"), F.col("event_type").alias("title")))).when(k == 1, '{"text":"hello"}').otherwise(F.to_json(F.struct(F.col("event_type").alias("title"))))
    kind = F.when(k == 0, "Order").when(k == 1, "TALK").otherwise("memo")
    item = F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('","type":"'), kind, F.lit('","title":"outer","data":'), data, F.lit("}"))
    entities, messages = records.ingested(table(spark, sf_dir, "events").select(item.alias("item")))
    shown = entities.select(F.col("id").cast("long").alias("event_id"), "target", "type", F.get_json_object("data", "$.title").alias("shown"))
    return shown.unionByName(messages.select(F.col("id").cast("long").alias("event_id"), "target", "type", F.get_json_object("data", "$.text").alias("shown")))


@query("SELECT o_orderkey AS k, 'T' || o_orderkey AS no, o_orderkey::VARCHAR AS \"index\", 'commerce' AS mode, o_totalprice AS amount, 3 AS status, 2 AS shown_keys FROM orders")
def index_enrichment(spark, sf_dir):
    """Look-up keys, defaults and shown keys of payloads."""
    k = F.col("o_orderkey")
    data = F.to_json(F.struct(F.concat(F.lit("T"), k).alias("no"), k.alias("index"), F.col("o_totalprice").alias("total_amount"), F.lit("x").alias("link"), F.lit("y").alias("type")))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.lit(3).alias("status"), F.lit(None).cast("double").alias("amount"), F.lit("t").alias("to"), data.alias("data"))
    rich = records.enriched(rows)
    shown = F.size(F.map_keys(records.parsed(F.col("data")))) - 1  # total_amount is not looked up
    return records.listed(rich).select("k", "no", "index", "mode", "amount", "status", shown.alias("shown_keys"))


@query("SELECT c_custkey::VARCHAR AS id, '' AS digest, 0 AS status, c_acctbal AS amount, false AS is_masked, c_name AS text FROM customer")
def documents_with_defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("text"))
    return records.documents(rows, ENTITY).select("id", "digest", "status", "amount", "is_masked", "text")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'sales' WHEN 'view' THEN 'users' ELSE 'items' END AS stored, CASE event_type WHEN 'click' THEN 'sales' WHEN 'view' THEN 'users' WHEN 'purchase' THEN 'items' ELSE 'pages' END AS taken, CASE event_type WHEN 'click' THEN 'sales' WHEN 'view' THEN 'users' WHEN 'purchase' THEN 'event' ELSE 'items' END AS searched, event_type = 'click' OR event_type = 'purchase' AS in_commerce FROM events")
def routes_of_three_ways(spark, sf_dir):
    """The table of a type for the store, for ingestion and for search, which differ, and the listing of a mode."""
    e = F.col("event_type")
    kind = F.when(e == "click", "Order").when(e == "view", "user").when(e == "purchase", "review").otherwise("page")
    return table(spark, sf_dir, "events").select(
        "event_id", records.target_of(kind).alias("stored"), records.target_of(kind, "ingest").alias("taken"), records.target_of(kind, "search").alias("searched"), records.allowed_types(F.lit("commerce"), F.lower(kind)).alias("in_commerce")
    )


@query("SELECT conv_id || '-' || turn AS id, CASE WHEN turn = 0 THEN 3 ELSE 9 END AS status, CASE WHEN turn = 0 THEN 77 ELSE 1 END::BIGINT AS updated_at FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def message_status_replaced(spark, sf_dir):
    """Messages taken out and put in again with another status."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    key = F.concat_ws("-", "conv_id", "turn")
    messages = records.documents(c.select(key.alias("id"), F.lit(9).alias("status"), F.lit(1).cast("long").alias("updated_at")), MESSAGE)
    return records.replace_status(messages, c.filter("turn = 0").select(key.alias("id")), 3, 77).select("id", "status", "updated_at")


@query("SELECT id, track FROM (SELECT c_custkey AS id, 0 AS track FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier) WHERE id NOT IN (SELECT n_nationkey FROM nation)")
def union_and_except(spark, sf_dir):
    """All rows of two tracks, repeated ids too, without those shown already."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    shown = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return records.except_ids(records.union_rows(a, b), shown)


@query(
    """WITH m AS (SELECT DISTINCT conv_id AS ref, conv_id || '-' || turn || CASE WHEN turn % 2 = 1 THEN '_query' ELSE '' END AS id, turn // 2 AS t FROM conversations)
    SELECT ref, id, (row_number() OVER (PARTITION BY ref ORDER BY t, CASE WHEN contains(id, '_query') THEN 0 ELSE 1 END, id))::INTEGER AS place FROM m"""
)
def chat_messages_in_order(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.concat_ws("-", "conv_id", "turn"), F.when(F.col("turn") % 2 == 1, "_query").otherwise(""))
    rows = c.select(F.col("conv_id").alias("ref"), key.alias("id"), F.expr("turn div 2").alias("created_at"), F.lit(0).alias("updated_at"), "text")
    return records.chat_order(rows).select("ref", "id", "place")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 3 = 1 THEN 'new' ELSE 'shown' END AS card FROM orders")
def list_cards_replaced(spark, sf_dir):
    """Cards replaced only by newer ones, and new ones added."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    k = F.col("id") % 3
    shown = o.filter(k != 2).withColumns({"updated_at": F.lit(5), "card": F.lit("shown")})
    batch = o.withColumns({"updated_at": F.when(k == 1, 6).otherwise(5), "card": F.lit("new")})
    return records.newer_cards(shown, batch).select("id", "created_at", "card")


@query(
    """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'payload id' WHEN 2 THEN 'payload index' ELSE 'payload word' END AS way, CASE o_orderkey % 4 WHEN 0 THEN 'k' || o_orderkey ELSE 'r' || o_orderkey END AS document FROM orders"""
)
def document_with_fallbacks(spark, sf_dir):
    """A document by id, by the id or index in a payload, or by a word of one."""
    k = F.col("o_orderkey")
    wanted = F.concat(F.lit("k"), k)
    key = F.when(k % 4 == 1, "id").when(k % 4 == 2, "index").otherwise("memo")
    data = F.when(k % 4 == 0, "{}").otherwise(F.concat(F.lit('{"'), key, F.lit('":"'), F.when(k % 4 == 3, F.lit("see ")).otherwise(""), wanted, F.lit('"}')))
    rows = table(spark, sf_dir, "orders").select(F.when(k % 4 == 0, wanted).otherwise(F.concat(F.lit("r"), k)).alias("id"), data.alias("data"))
    keys = table(spark, sf_dir, "orders").select(k.alias("k"), wanted.alias("key"))
    return records.document_for(keys, "key", rows).select("k", "way", "document")


@query(
    """WITH i AS (SELECT doc_id, source, substr(text, 1, 20) AS title, doc_id % 2 = 0 AS paged FROM documents), t AS (SELECT source AS ref, arg_min(title, doc_id) AS title FROM i GROUP BY 1)
    SELECT page_id AS id, coalesce(nullif(t.title, ''), url) AS title FROM pages LEFT JOIN t ON t.ref = 'src' || (page_id % 5)
    UNION ALL SELECT doc_id + 1000000, coalesce(nullif(t.title, ''), i.title) FROM i LEFT JOIN t ON t.ref = source WHERE paged"""
)
def pages_and_items(spark, sf_dir):
    """Pages and items that are pages, titled by the first item of their ref."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("type"), F.concat(F.lit("src"), F.col("page_id") % 5).alias("ref"), F.col("url").alias("title"), F.lit("").alias("origin"))
    d = table(spark, sf_dir, "documents")
    items = d.select((F.col("doc_id") + 1000000).alias("id"), F.lit("item").alias("type"), F.col("source").alias("ref"), F.substring("text", 1, 20).alias("title"), F.when(F.col("doc_id") % 2 == 0, "o").otherwise("").alias("origin"))
    return records.pages_view(pages, items).select("id", "title")


@query(
    """WITH p AS (SELECT page_id, url, '/' || split_part(regexp_extract(regexp_replace(url, '[?#].*$', ''), '//[^/]*/(.*)$', 1), '/', 1) AS head FROM pages),
    l AS (SELECT head, min(page_id)::VARCHAR AS least FROM p GROUP BY 1)
    SELECT page_id + 5000 AS id, least AS page FROM p JOIN l ON p.head = l.head"""
)
def cached_pages(spark, sf_dir):
    """The cached page of a link by the start of its path."""
    pages = table(spark, sf_dir, "pages")
    head = F.concat(F.lit("/"), F.substring_index(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "//[^/]*/(.*)$", 1), "/", 1))
    known = pages.select(F.col("page_id").alias("id"), head.alias("path"))
    links = pages.select(F.concat(F.lit("link "), "page_id").alias("key"), (F.col("page_id") + 5000).alias("id"), "url")  # no page has such a key
    return records.cached_page(links, "key", "url", known).select("id", "page")


@query("SELECT c_custkey AS id FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey IN (SELECT s_suppkey FROM supplier))")
def invites_replaced(spark, sf_dir):
    """Members without the invites of those who joined."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("").alias("from"), F.concat(F.lit("M"), "c_custkey").alias("email"), (F.col("c_custkey") % 2 == 0).alias("pending"))
    joined = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), "s_suppkey").alias("from"), F.concat(F.lit("m"), "s_suppkey").alias("email"))
    return records.replaced_invites(c, joined).select("id")


@query("SELECT o_orderkey AS id, 'a2' AS answer FROM orders WHERE o_orderkey % 2 = 0")
def answers_joined_back(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    answers = o.filter("id % 2 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("at")).withColumn("answer", F.concat(F.lit("a"), "at"))
    return records.answered(o, answers.unionByName(answers.limit(5).withColumn("id", F.lit(-1).cast("long")))).select("id", "answer")


@query("""SELECT id, min(place)::INTEGER AS place FROM (SELECT o_orderkey AS id, 0 AS place FROM orders WHERE replace(o_orderpriority, '-', '') = '1URGENT' UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P') GROUP BY id""")
def exact_number_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tracking_number"))
    return records.exact_first(rows, F.lit("1_URGENT"), o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))


@query("SELECT CASE event_id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'repaired' ELSE 'lost' END AS state, count(*) AS n FROM events GROUP BY 1")
def json_repair_counts(spark, sf_dir):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n{k: 1, "), F.expr("substring(props, 2)"), F.lit(","))).otherwise("no payload")
    return records.repair_counts(table(spark, sf_dir, "events").select(text.alias("x")), "x")


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'second' END AS text FROM customer UNION ALL SELECT 't' || s_suppkey, 'new' FROM supplier")
def stored_tables(spark, sf_dir):
    """A store written, changed and read again: rows added, a key updated, another version."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tradeloom-")
    tables = records.Store(spark, f"{folder}/{uuid.uuid4().hex}")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"), (F.col("c_custkey") % 2).alias("odd"))
    tables.write({"items": records.documents(c)})
    changed = store.update_where(tables.read("items"), F.col("id").cast("long") % 2 == 1, {"text": F.lit("second")})
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), "s_suppkey").alias("id"), F.lit("new").alias("text"))
    tables.write({"items": records.add_rows(changed, records.documents(new))})
    tables.set("opened", 1)
    return tables.read("items").select("id", "text")
