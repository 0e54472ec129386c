"""Queries over relay rules, look-up chains and reverse look-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relay
from .catalogue import HASH, query, table

# How the tables of orders stand for records: a line is an order record of a goods record, a part is a goods record.
LINES = """SELECT (l_orderkey * 10 + l_linenumber) AS id, (l_orderkey * 10 + l_linenumber) AS "index", l_partkey AS goods, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE 0 END AS tracking,
  CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice END AS sale_price, l_discount AS discount, l_quantity AS quantity, (l_orderkey % 3) AS updated_at FROM lineitem"""
PARTS = "SELECT p_partkey AS id, p_partkey AS \"index\", CASE WHEN p_size > 25 THEN 0.0 ELSE p_retailprice END AS sale_price, 0.0 AS discount, p_size::DOUBLE AS quantity, 1 AS updated_at FROM part"


def lines(spark, sf_dir):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    price = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_extendedprice"))
    tracking = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        key.alias("id"), key.alias("index"), F.col("l_partkey").alias("goods"), tracking.alias("tracking"), price.alias("sale_price"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") % 3).alias("updated_at")
    )


def parts(spark, sf_dir):
    price = F.when(F.col("p_size") > 25, 0.0).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("index"), price.alias("sale_price"), F.lit(0.0).alias("discount"), F.col("p_size").cast("double").alias("quantity"), F.lit(1).alias("updated_at"))


def rule(foreign, primary, having=None):
    return next(r for r in relay.RULES if (r.foreign, r.primary, r.having) == (foreign, primary, having))


@query(
    f"""SELECT l.id, CASE WHEN p.sale_price = 0 THEN l.sale_price ELSE p.sale_price END AS sale_price, CASE WHEN p.discount = 0 THEN l.discount ELSE p.discount END AS discount,
    CASE WHEN p.quantity = 0 THEN l.quantity ELSE p.quantity END AS quantity,
    CASE WHEN l.updated_at = 0 AND (CASE WHEN p.sale_price = 0 THEN l.sale_price ELSE p.sale_price END <> l.sale_price OR CASE WHEN p.quantity = 0 THEN l.quantity ELSE p.quantity END <> l.quantity) THEN 77 ELSE l.updated_at END::BIGINT AS updated_at
    FROM ({LINES}) l JOIN ({PARTS}) p ON l.goods = p.id WHERE p.id <> 0"""
)
def rule_order_from_goods(spark, sf_dir):
    """Goods give their sales columns to the order records of their index."""
    got = relay.apply_rule(rule("order", "goods"), parts(spark, sf_dir), lines(spark, sf_dir), 77)
    return got.select("id", "sale_price", "discount", "quantity", F.col("updated_at").cast("long").alias("updated_at"))


@query(
    f"""WITH l AS ({LINES}), s AS (SELECT s_suppkey AS id, s_suppkey AS "index", s_acctbal AS sale_price, 1 AS updated_at FROM supplier)
    SELECT l.id, CASE WHEN s.sale_price = 0 THEN l.sale_price ELSE s.sale_price END AS sale_price FROM l JOIN s ON l.tracking = s.id WHERE l.tracking <> 0"""
)
def rule_goods_to_order(spark, sf_dir):
    """Order records with a shipment take the sales columns of the record of that shipment."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("tracking"), F.col("s_acctbal").alias("sale_price"), F.lit(1).alias("updated_at"))
    return relay.apply_rule(rule("goods", "order", "tracking"), lines(spark, sf_dir), s).select("id", "sale_price")


@query(f"""SELECT DISTINCT l.tracking::VARCHAR AS "index", 'goods' AS type, 0::BIGINT AS updated_at FROM ({LINES}) l WHERE l.tracking <> 0 AND l.tracking % 2 = 0""")
def rule_missing_drafts(spark, sf_dir):
    """Drafts of the records that a rule which inserts looks for and does not find."""
    stored = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("tracking"))
    return relay.missing(rule("goods", "order", "tracking"), lines(spark, sf_dir), stored)


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS id, o_totalprice AS width, CASE WHEN l_linenumber = 1 THEN 5.0 ELSE o_custkey::DOUBLE END AS weight, CASE WHEN l_linenumber % 2 = 0 THEN o_orderkey ELSE l_orderkey + 7 END AS tracking
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey <> 0"""
)
def rule_tracking_from_order(spark, sf_dir):
    """Orders with a shipment give their sizes to the shipments that name them, and their index where those have none."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("index"), F.lit(1).alias("tracking"), F.col("o_totalprice").alias("width"), F.col("o_custkey").cast("double").alias("weight"), F.lit(1).alias("updated_at")
    )
    li = table(spark, sf_dir, "lineitem")
    one = F.col("l_linenumber") == 1
    t = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order"), F.lit(0.0).alias("width"), F.lit(0.0).alias("weight"), F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(F.col("l_orderkey") + 7).alias("tracking"), F.lit(1).alias("updated_at"), one.alias("first")
    )
    got = relay.apply_rule(rule("tracking", "order", "tracking"), o, t)
    return got.select("id", "width", F.when(F.col("first"), 5.0).otherwise(F.col("weight")).alias("weight"), "tracking")


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS day FROM orders), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY day DESC, id) = 1)
    SELECT c_custkey, coalesce(l.id, -1) AS found FROM customer LEFT JOIN l ON c_custkey = k AND c_nationkey % 2 = 0"""
)
def probe_latest_of_site(spark, sf_dir):
    """The latest order of each customer, on the same site only."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 2).alias("cc"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderdate").alias("created_at"), F.lit(0).alias("cc"))
    return relay.probe(c, "c_custkey", o, "o_custkey").select("c_custkey", F.coalesce("found.id", F.lit(-1)).alias("found"))


@query(
    """WITH s AS (SELECT c_custkey AS id, c_mktsegment AS "to", 'r' || c_custkey AS ref, c_name AS name, c_acctbal AS amount FROM customer),
    n AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 9000000 END AS id, c_mktsegment AS "to", CASE WHEN c_custkey % 3 = 1 THEN 'r' || c_custkey ELSE 'none' END AS ref, 'new' AS name, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 5 END AS amount, c_custkey AS k FROM customer)
    SELECT k, CASE WHEN k % 3 = 1 THEN k WHEN k % 3 = 0 THEN k ELSE k + 9000000 END AS id, 'new' AS name, CASE WHEN n.amount <> 0 OR k % 3 = 2 THEN n.amount ELSE s.amount END AS amount,
    CASE k % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'ref' ELSE 'new' END AS matched_by FROM n JOIN s ON s.id = k"""
)
def merge_under_stored(spark, sf_dir):
    """New rows on top of the stored rows of their id, else of their ref; stored keys stay."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stored = c.select(k.alias("id"), F.col("c_mktsegment").alias("to"), F.concat(F.lit("r"), k).alias("ref"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.lit(1).alias("updated_at"), k.alias("index"))
    new = c.select(
        F.when(k % 3 == 0, k).otherwise(k + 9000000).alias("id"), F.col("c_mktsegment").alias("to"), F.when(k % 3 == 1, F.concat(F.lit("r"), k)).otherwise("none").alias("ref"), F.lit("new").alias("name"), F.when(k % 2 == 0, 0.0).otherwise(5.0).alias("amount"), k.alias("k")
    )
    got = relay.merged_under(new.withColumn("index", F.col("id")), stored.withColumn("k", F.col("id")), ["id", "name", "amount", "k"])
    return got.select("k", "id", "name", "amount", "matched_by")


@query(
    """SELECT doc_id, CASE WHEN page_id IS NOT NULL THEN 0 WHEN item_id IS NOT NULL THEN 1 WHEN c_custkey IS NOT NULL THEN 2 ELSE -1 END::INTEGER AS found_in, coalesce(url, benchmark.text, c_name, '-') AS title
    FROM documents LEFT JOIN pages ON page_id = doc_id LEFT JOIN benchmark ON item_id = doc_id LEFT JOIN customer ON c_custkey = doc_id"""
)
def lookup_chain(spark, sf_dir):
    """A document by its key in the first of three tables that has it."""
    stamp = F.lit(0).alias("updated_at")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), stamp)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"), stamp)
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), stamp)
    keys = table(spark, sf_dir, "documents").select("doc_id")
    return relay.first_found(keys, "doc_id", (pages, "id"), (items, "id"), (users, "id")).select("doc_id", F.coalesce("found_in", F.lit(-1)).alias("found_in"), F.coalesce("found.title", F.lit("-")).alias("title"))


def _orders_and_shipments(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    number = F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("9-"), F.lpad(k.cast("string"), 8, "0")))
    orders = o.select(k.alias("id"), (k + 100).alias("index"), number.alias("tracking_number"), F.when(k % 7 == 0, 1).otherwise(0).cast("long").alias("tracking"), F.lit(2.0).alias("width"), F.lit(0.0).alias("weight"))
    shipments = o.filter("o_orderkey % 5 < 3").select(
        (k + 1000000).alias("id"), (k + 2000000).alias("index"), F.when(k % 5 == 0, F.concat(F.lit("9_"), F.lpad(k.cast("string"), 8, "0"))).otherwise("").alias("tracking_number"),
        F.when(k % 5 == 2, k + 100).otherwise(0).alias("order"), F.when(k % 5 == 1, F.concat(F.lit('{"memo":"9'), F.lpad(k.cast("string"), 8, "0"), F.lit('"}'))).otherwise("{}").alias("data"),
        F.when(k % 2 == 0, 0).otherwise(5).cast("long").alias("updated_at"), F.when(k % 3 == 0, 4.0).otherwise(0.0).alias("width"), F.lit(0.0).alias("weight"),
    )
    return relay.tracking_of_orders(orders, shipments, 99)


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 5 < 3 THEN o_orderkey + 2000000 ELSE 0 END AS tracking,
    CASE o_orderkey % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'payload' WHEN 2 THEN 'order' ELSE 'none' END AS found_by FROM orders"""
)
def reverse_tracking_orders(spark, sf_dir):
    """Orders with the shipment found by number, payload or order index."""
    return _orders_and_shipments(spark, sf_dir)[0].select("id", "tracking", F.coalesce("found_by", F.lit("none")).alias("found_by"))


@query(
    """SELECT o_orderkey + 1000000 AS id, o_orderkey + 100 AS "order", CASE WHEN o_orderkey % 3 = 0 THEN 4.0 ELSE 2.0 END AS width, CASE WHEN o_orderkey % 2 = 0 THEN 99 ELSE 5 END::BIGINT AS updated_at
    FROM orders WHERE o_orderkey % 5 < 3 AND (o_orderkey % 5 < 2 OR o_orderkey % 3 <> 0)"""
)
def reverse_tracking_shipments(spark, sf_dir):
    """The shipments that gain an order or a size by it."""
    return _orders_and_shipments(spark, sf_dir)[1].select("id", "order", "width", "updated_at")


@query("""SELECT '9' || lpad(o_orderkey::VARCHAR, 8, '0') AS tracking_number, o_orderkey + 100 AS "order", 'tracking' AS type, 0::BIGINT AS updated_at FROM orders WHERE o_orderkey % 5 = 3""")
def reverse_tracking_drafts(spark, sf_dir):
    """Drafts for numbers without a shipment."""
    return _orders_and_shipments(spark, sf_dir)[2]


ID = HASH.format


@query(
    f"""WITH g AS (SELECT l_orderkey AS "order", l_partkey, min(l_linenumber) AS line FROM lineitem GROUP BY ALL)
    SELECT "order", (l_orderkey_no || '-' || l_partkey) AS no, l_partkey % 4 AS event FROM (SELECT *, '77' || "order" AS l_orderkey_no FROM g)"""
)
def order_shipments(spark, sf_dir):
    """A shipment for each goods entry of an order, with the event of the goods."""
    li = table(spark, sf_dir, "lineitem")
    goods = li.groupBy(F.col("l_orderkey").alias("index")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("no")))).alias("goods"))
    orders = goods.withColumn("tracking_number", F.concat(F.lit("77-"), F.col("index")))
    no = F.col("p_partkey").cast("string")
    stored = table(spark, sf_dir, "part").select(S.entity_index(F.lit("goods"), F.lit("team"), no).alias("index"), no.alias("no"), (F.col("p_partkey") % 4).alias("event"))
    return relay.shipments_of_orders(orders, "goods", "team", stored).select("order", "no", "event")


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['goods','order','tracking','coupon','event','review','other']) AS kind, unnest([4,4,4,2,2,3,0]) AS n) WHERE n > 0 GROUP BY kind")
def related_kinds(spark, sf_dir):
    """The types that have related types, each once; `other` has none."""
    kinds = ["goods", "sales", "shipping", "coupon", "event", "review", "other"]
    rows = [({"sales": "order", "shipping": "tracking"}.get(k, k), t) for k in kinds for t in relay.related_types(k)]
    return spark.createDataFrame(rows, "kind string, other string").select("kind").distinct().withColumn("n", F.lit(1).cast("long"))
