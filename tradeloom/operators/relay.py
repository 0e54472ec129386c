"""Joins between goods, orders, shipments and events by a rule table, drafts, and cross-reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import store

# Columns that travel between related records.
SIZES = ("width", "height", "length", "weight")
SHIPPING = (*SIZES, "shipping_fee", "shipping_method", "shipping_duration", "bundle_shipping")
SALES = (
    "event", "width", "height", "length", "weight", "size", "currency", "cost_price", "sale_price", "discount", "quantity", "tracking", "number",
    "carrier", "shipping_fee", "shipping_method", "shipping_duration", "fulfillment_service", "stock_keeping_unit", "bundle_shipping", "used",
    "lease", "rental", "refurbish", "tax_included", "release_date",
)
EVENT = (
    "started_at", "expired_at", "phone", "address", "discount", "quantity", "usage_per", "usage_limit", "min_order_amount", "max_order_amount",
    "max_discount_amount", "new_customer_only", "first_purchase_only", "region_restrictions",
)
# The types a record of each type is related to, and other names of types.
RELATED = {
    "goods": ("order", "tracking", "coupon", "event"),
    "order": ("goods", "tracking", "coupon", "event"),
    "tracking": ("goods", "order", "coupon", "event"),
    "coupon": ("goods", "event"),
    "event": ("goods", "coupon"),
    "review": ("goods", "coupon", "event"),
}
ALSO_KNOWN = {"receiving": "tracking", "shipping": "tracking", "sales": "order"}


@dataclass(frozen=True)
class Rule:
    foreign: str
    primary: str
    having: str | None  # the rule is for primary records with (or, with a !, without) a value in this column
    table: str  # where the foreign record is looked for,
    column: str  # by this column,
    value: str  # equal to this one of the primary record
    include: tuple[str, ...] = ()
    giver: str = "primary"  # whose columns travel: those of the primary or of the foreign record
    copy_key: tuple[str, str] | None = None  # column of the primary record, and of the foreign one that gets it where it has none
    insert: bool = False  # whether a foreign record that is missing is drafted


# How a record finds its related records, and what it gives them or takes from them.
RULES = (
    Rule("goods", "order", "tracking", "sales", "tracking", "tracking", SALES, "foreign", None, True),
    Rule("goods", "order", "!tracking", "sales", "index", "index", SALES, "foreign"),
    Rule("tracking", "order", "tracking", "tracking", "order", "index", SIZES, "primary", ("index", "tracking")),
    Rule("tracking", "order", "!tracking", "tracking", "order", "index", ("no", "goods", "event"), "foreign", ("index", "tracking")),
    Rule("event", "order", "event", "event", "index", "event", ("discount",), "foreign"),
    Rule("order", "goods", None, "sales", "goods", "index", SALES, "primary"),
    Rule("tracking", "goods", None, "tracking", "goods", "index", SHIPPING, "primary"),
    Rule("event", "goods", "event", "event", "index", "event", ("discount",), "foreign"),
    Rule("goods", "tracking", None, "sales", "goods", "goods", SHIPPING, "foreign"),
    Rule("order", "tracking", "goods", "sales", "goods", "goods", SHIPPING, "primary", ("index", "tracking")),
    Rule("order", "tracking", "!goods", "tracking", "tracking", "index", ("no", "order", "goods", "event"), "foreign", ("index", "order")),
    Rule("goods", "event", None, "sales", "event", "index", ("discount",), "primary"),
    Rule("order", "event", None, "sales", "event", "index", ("discount",), "primary"),
    Rule("event", "coupon", "event", "event", "index", "event", EVENT, "foreign"),
    Rule("coupon", "event", None, "event", "event", "index", EVENT, "primary"),
)


def related_types(kind: str) -> list[str]:
    """The types that a record of a type is related to; none for an unknown type."""
    return list(RELATED.get(ALSO_KNOWN.get(kind, kind), ()))


def rules_of(foreign: str, primary: str) -> list[Rule]:
    kind = lambda t: "event" if t == "coupon" and "coupon" not in (foreign, primary)[1:] else t
    return [r for r in RULES if r.foreign == kind(foreign) and r.primary == primary]


def _has(column: str) -> Column:
    return ~scalars.empty(F.col(column))


def matched(rule: Rule, primary: DataFrame, foreign: DataFrame, same: tuple[str, ...] = ("to", "cc")) -> DataFrame:
    """(_primary, _foreign): structs of the records that the rule relates; every record that takes has one that gives.

    Keys are compared as text, and null, empty or zero ones match nothing. `same` are columns that have to agree too, as far
    as both tables have them: the team and the site. Of several givers of a key, the one that was updated last counts, the
    least id of equal ones, so a key never multiplies rows.
    """
    if rule.having:
        name = rule.having.lstrip("!")
        primary = primary.filter(~_has(name) if rule.having.startswith("!") else _has(name)) if name in primary.columns else primary.filter(F.lit(rule.having.startswith("!")))
    shared = [c for c in same if c in primary.columns and c in foreign.columns]
    sides = {"primary": (primary, rule.value), "foreign": (foreign, rule.column)}
    keyed = {}
    for side, (df, key) in sides.items():
        keyed[side] = df.filter(_has(key)).select(F.col(key).cast("string").alias(f"_k{side}"), *[F.col(c).alias(f"_{side}{c}") for c in shared], F.struct("*").alias(f"_{side}"))
    giver = rule.giver
    keyed[giver] = store.latest(keyed[giver], [f"_k{giver}", *[f"_{giver}{c}" for c in shared]], [F.desc(f"_{giver}.updated_at"), F.asc(f"_{giver}.id")])
    on = [F.col("_kprimary") == F.col("_kforeign"), *[F.col(f"_primary{c}").eqNullSafe(F.col(f"_foreign{c}")) for c in shared]]
    return keyed["primary"].join(keyed["foreign"], on).select("_primary", "_foreign")


def filled(taker: Column, giver: Column, columns: list[str], include: tuple[str, ...], have: list[str], stamp: Column) -> list[Column]:
    """The taker's columns, those in include from the giver unless it has none there; a draft that gains something is one no more."""
    merged = {c: scalars.merge_value(taker[c], giver[c]) if c in include and c in have else taker[c] for c in columns}
    if "updated_at" in columns:
        gains = [~merged[c].eqNullSafe(taker[c]) for c in include if c in columns and c in have]
        merged["updated_at"] = F.when(scalars.any_of([F.lit(False), *gains]) & (F.coalesce(taker["updated_at"], F.lit(0)) == 0), stamp).otherwise(taker["updated_at"])
    return [merged[c].alias(c) for c in columns]


def apply_rule(rule: Rule, primary: DataFrame, foreign: DataFrame, now_ms: int = 0, same: tuple[str, ...] = ("to", "cc")) -> DataFrame:
    """The records that take, merged with those that give: foreign ones where the primary record gives, else primary ones.

    Records without a counterpart are not in the result; the caller upserts it. A key is copied only to where none is.
    """
    pairs = matched(rule, primary, foreign, same)
    own, other, have, given = ("_foreign", "_primary", foreign.columns, primary.columns) if rule.giver == "primary" else ("_primary", "_foreign", primary.columns, foreign.columns)
    out = pairs.select(*filled(F.col(own), F.col(other), have, rule.include, given, F.lit(now_ms)), F.col(other).alias("_other"))
    if rule.copy_key and rule.giver == "primary" and rule.copy_key[1] in have:
        source, target = rule.copy_key
        out = out.withColumn(target, F.when(scalars.empty(F.col(target)), F.col(f"_other.{source}").cast(dict(out.dtypes)[target])).otherwise(F.col(target)))
    return out.drop("_other")


def missing(rule: Rule, primary: DataFrame, foreign: DataFrame) -> DataFrame:
    """Drafts (index, type, updated_at 0) of the foreign records that a rule with insert looks for and does not find."""
    wanted = primary.filter(_has(rule.value))
    return drafts(wanted, rule.value, foreign.filter(_has(rule.column)), rule.column, rule.foreign)


def probe(rows: DataFrame, key: str, table: DataFrame, column: str, now_same: tuple[str, ...] = ("to", "cc")) -> DataFrame:
    """rows with the latest matching row of a table as the struct `found`: same key, team and site; null where there is none."""
    shared = [c for c in now_same if c in rows.columns and c in table.columns]
    latest = table.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_key"), *[F.col(c).alias(f"_s{c}") for c in shared], F.struct("*").alias("found"))
    latest = store.latest(latest, ["_key", *[f"_s{c}" for c in shared]], [F.desc("found.created_at"), F.asc("found.id")])
    on = [rows[key].cast("string") == F.col("_key"), *[rows[c].eqNullSafe(F.col(f"_s{c}")) for c in shared]]
    return rows.join(latest, on, "left").drop("_key", *[f"_s{c}" for c in shared])


def merged_under(new: DataFrame, stored: DataFrame, columns: list[str], keep: tuple[str, ...] = ("id", "no", "index")) -> DataFrame:
    """New rows on top of the stored rows they match: by id within team and site, else by ref.

    A new value wins unless it is null, empty or zero, but the stored keys stay. New rows that match nothing pass as they are.
    """
    by_id = stored.select(F.col("id").alias("_i"), F.col("to").alias("_t"), F.struct("*").alias("_by_id"))
    by_id = store.latest(by_id, ["_i", "_t"], [F.desc("_by_id.updated_at"), F.asc("_by_id.index")])
    by_ref = stored.filter(F.coalesce("ref", F.lit("")) != "").select(F.col("ref").alias("_r"), F.col("to").alias("_u"), F.struct("*").alias("_by_ref"))
    by_ref = store.latest(by_ref, ["_r", "_u"], [F.desc("_by_ref.updated_at"), F.asc("_by_ref.id")])
    rows = new.join(by_id, (new["id"] == F.col("_i")) & (new["to"] == F.col("_t")), "left").join(by_ref, (new["ref"] == F.col("_r")) & (new["to"] == F.col("_u")), "left")
    rows = rows.withColumn("_old", F.coalesce("_by_id", "_by_ref"))
    both = lambda c: scalars.merge_value(F.col(c), F.col(f"_old.{c}")) if c in keep else scalars.merge_value(F.col(f"_old.{c}"), F.col(c))
    made = [F.when(F.col("_old").isNull(), F.col(c)).otherwise(both(c)).alias(c) for c in columns]
    return rows.select(*made, F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_ref").isNotNull(), "ref").otherwise("new").alias("matched_by"))


def first_found(keys: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> DataFrame:
    """keys with the row of the first (table, column) that has the key: a chain of look-ups. Adds `found_in`, the number of the table, null where none has it.

    The tables need the same columns; of several rows of a table the one updated last counts.
    """
    all_ = None
    for i, (table, column) in enumerate(tables):
        rows = table.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_key"), F.lit(i).alias("found_in"), F.struct("*").alias("found"))
        all_ = rows if all_ is None else all_.unionByName(rows)
    wanted = all_.join(keys.select(F.col(key).cast("string").alias("_key")).distinct(), "_key", "left_semi")
    best = store.latest(wanted, ["_key"], [F.asc("found_in"), F.desc("found.updated_at"), F.asc("found.id")])
    return keys.join(best, keys[key].cast("string") == F.col("_key"), "left").drop("_key")


def tracking_of_orders(orders: DataFrame, shipments: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The way back from orders to shipments: (orders with their shipment, changed shipments, new drafts).

    An order with a tracking number finds its shipment by that number, else by a shipment whose payload holds the number,
    else by its own index. A shipment found gets the order's sizes where it has none, and the order's index if it has no
    order; a draft that gains something is counted from now on. Orders whose number finds nothing get a draft.

    orders: id, index, tracking_number, tracking and sizes; shipments: id, index, tracking_number, order, data, updated_at and sizes.
    Of several shipments that fit, the least id counts, and of several orders of one shipment the least index gives.
    """
    clean = lambda c: F.regexp_replace(scalars.digits_for_letters(F.trim(c)), "[-_]", "")
    asked = orders.withColumn("_no", F.nullif(clean(F.col("tracking_number")), F.lit("")))
    own = shipments.withColumn("_own", F.nullif(clean(F.col("tracking_number")), F.lit("")))
    inside = own.select("id", F.explode(F.array_distinct(F.filter(F.split("data", "[^A-Za-z0-9]+"), lambda w: w.rlike("[0-9]")))).alias("_key"))  # numbers in the payload
    by_number = own.select(F.col("_own").alias("_key"), F.lit(0).alias("_way"), F.col("id").alias("_ship")).filter("_key is not null")
    by_payload = inside.select("_key", F.lit(1).alias("_way"), F.col("id").alias("_ship"))
    by_order = own.filter(_has("order")).select(F.col("order").cast("string").alias("_key"), F.lit(2).alias("_way"), F.col("id").alias("_ship"))
    least = lambda df: df.groupBy("_key", "_way").agg(F.min("_ship").alias("_ship"))
    numbers = asked.filter("_no is not null").select(F.col("id").alias("_order"), F.col("_no").alias("_key")).join(least(by_number.unionByName(by_payload)), "_key")
    indexes = asked.filter("_no is not null").select(F.col("id").alias("_order"), F.col("index").cast("string").alias("_key")).join(least(by_order), "_key")
    way = numbers.select("_order", "_way", "_ship").unionByName(indexes.select("_order", "_way", "_ship")).groupBy("_order").agg(F.min(F.struct("_way", "_ship")).alias("_best"))
    linked = asked.join(way, asked["id"] == F.col("_order"), "left").withColumn("_ship", F.col("_best._ship"))
    at = shipments.select(F.col("id").alias("_sid"), F.col("index").alias("_sindex"))
    done = linked.join(at, F.col("_ship") == F.col("_sid"), "left")
    done = done.withColumn("tracking", F.when(scalars.empty(F.col("tracking")) & F.col("_sindex").isNotNull(), F.col("_sindex")).otherwise(F.col("tracking")))
    done = done.withColumn("found_by", F.when(F.col("_best._way") == 0, "number").when(F.col("_best._way") == 1, "payload").when(F.col("_best._way") == 2, "order"))
    givers = store.latest(linked.filter("_ship is not null").select("_ship", F.struct(*orders.columns).alias("_giver")), ["_ship"], [F.asc("_giver.index"), F.asc("_giver.id")])
    pairs = shipments.join(givers, shipments["id"] == F.col("_ship"))
    sizes = [c for c in SIZES if c in shipments.columns and c in orders.columns]
    fill = {c: F.when(scalars.empty(F.col(c)) & ~scalars.empty(F.col(f"_giver.{c}")), F.col(f"_giver.{c}")).otherwise(F.col(c)) for c in sizes}
    fill["order"] = F.when(scalars.empty(F.col("order")), F.col("_giver.index").cast(dict(shipments.dtypes)["order"])).otherwise(F.col("order"))
    changed = pairs.select(*[fill.get(c, F.col(c)).alias(c) for c in shipments.columns], F.struct(*[F.col(c).alias(c) for c in fill]).alias("_before"))
    differs = scalars.any_of([~F.col(c).eqNullSafe(F.col(f"_before.{c}")) for c in fill])
    changed = changed.filter(differs).withColumn("updated_at", F.when(F.coalesce("updated_at", F.lit(0)) == 0, F.lit(now_ms)).otherwise(F.col("updated_at"))).drop("_before")
    alone = done.filter(F.col("_no").isNotNull() & F.col("_ship").isNull())
    new = alone.groupBy("_no").agg(F.min("index").alias("order")).select(F.col("_no").alias("tracking_number"), "order", F.lit("tracking").alias("type"), F.lit(0).cast("long").alias("updated_at"))
    return done.select(*orders.columns, "found_by"), changed, new


def look_up(keys: DataFrame, key: str, table: DataFrame, column: str, order: list[Column]) -> DataFrame:
    """keys with the first row of the table, by the order, whose column equals the key as text."""
    probe = store.latest(table.filter(F.col(column).isNotNull()).withColumn("_key", F.col(column).cast("string")), ["_key"], order)
    return keys.join(probe, keys[key].cast("string") == probe["_key"], "left").drop("_key")


def relay(primary: DataFrame, foreign: DataFrame, primary_key: str, foreign_key: str, include: list[str]) -> DataFrame:
    """Foreign rows with the columns in `include` filled from their primary record, where that has them.

    A key has one giver: of several primary rows the first by the columns given, the greatest first.
    """
    giver = primary.select(F.col(primary_key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in include])
    giver = store.latest(giver, ["_key"], [F.desc(f"_{c}") for c in include])
    filled = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in foreign.columns else F.col(f"_{c}") for c in include}
    return foreign.join(giver, foreign[foreign_key] == F.col("_key"), "left").withColumns(filled).drop("_key", *[f"_{c}" for c in include])


def drafts(wanted: DataFrame, key: str, stored: DataFrame, stored_key: str, kind: str) -> DataFrame:
    """A draft (updated_at 0) for every different key without a stored record."""
    keys = wanted.select(F.col(key).cast("string").alias("index")).filter(F.col("index").isNotNull()).distinct()
    missing = keys.join(stored.select(F.col(stored_key).cast("string").alias("index")), "index", "left_anti")
    return missing.select("index", F.lit(kind).alias("type"), F.lit(0).cast("long").alias("updated_at"))


def present(rows: DataFrame, key: str, table: DataFrame, column: str) -> DataFrame:
    """The rows whose key a record has: what a guard against a second draft asks."""
    return rows.join(table.select(F.col(column).cast("string").alias("_key")), F.col(key).cast("string") == F.col("_key"), "left_semi")


def cross_reference(keys: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, hop) of all records within two hops of the seeds; records are neighbours if a key value is equal.

    keys: (key_value, id) pairs. The hop of a value is the least of its records', and that of a record at most one more
    than the least of its values', so each hop is two aggregations over the pairs, and a value that many records share
    costs one row for each of them and not one for each pair.
    """
    near = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in (1, 2):
        values = keys.join(near, "id").select("key_value").distinct()
        reached = keys.join(values, "key_value", "left_semi").select("id", F.lit(hop).alias("hop"))
        near = near.unionByName(reached).groupBy("id").agg(F.min("hop").alias("hop"))
    return near


def related_to_all(pairs: DataFrame, limit: int = 10, salts: int = 64) -> DataFrame:
    """For every record: the first `limit` others by id that refer to what it refers to; (me, id, rank).

    pairs: (id, ref). Each ref keeps its limit + 1 least ids, taken by a salt first, so a hot ref is spread over tasks
    and costs each of its records a few rows and not one for each other. Null refs relate to nothing.
    """
    known = pairs.filter(F.col("ref").isNotNull()).distinct()
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    few = known.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("_r", rank("ref", "_salt")).filter(F.col("_r") <= limit + 1)
    least = few.withColumn("_r", rank("ref")).filter(F.col("_r") <= limit + 1).groupBy("ref").agg(F.collect_list("id").alias("least"))
    others = known.join(least, "ref").select(F.col("id").alias("me"), F.explode("least").alias("id"))
    both = others.filter(F.col("id") != F.col("me")).distinct()
    return both.withColumn("rank", rank("me")).filter(F.col("rank") <= limit)


def unnest_goods(orders: DataFrame, goods: str, keep: list[str]) -> DataFrame:
    """One shipment row for each entry of an order's goods, with its place in the order."""
    return orders.select(*keep, F.posexplode(goods).alias("place", "entry")).select(*keep, "place", "entry.*")


def shipments_of_orders(orders: DataFrame, goods: str, team: str, stored_goods: DataFrame | None = None) -> DataFrame:
    """One shipment for each tracking number and goods entry of an order: keys hashed, links to order and goods set.

    orders: index, tracking_number and an array of structs `goods` with no (and any other columns). A shipment's no is the tracking number and
    the goods' number; its index and id follow from that as for any record. With stored_goods (index, event) it gets the
    goods' event; an index has 32 bits, which different goods can share, so with a column `no` the number has to be the same too. Entries of one order with equal numbers are one shipment, the first. Orders without a number have none.
    """
    rows = orders.filter(_has("tracking_number")).select(F.col("index").alias("order"), "tracking_number", F.posexplode(goods).alias("place", "entry"))
    rows = rows.withColumn("goods", scalars.entity_index(F.lit("goods"), F.lit(team), F.col("entry.no").cast("string")))
    rows = rows.withColumn("no", F.concat_ws("-", scalars.clean_no(F.col("tracking_number")), F.col("entry.no").cast("string")))
    rows = store.latest(rows, ["order", "no"], [F.asc("place")])
    index = scalars.entity_index(F.lit("tracking"), F.lit(team), F.col("no"))
    made = rows.withColumn("index", index).withColumn("id", scalars.entity_id(F.lit(team), F.col("index"))).withColumn("type", F.lit("tracking"))
    if stored_goods is not None:
        keys = ["goods"]
        stored = stored_goods.withColumnRenamed("index", "goods")
        if "no" in stored.columns:
            keys.append("_no")
            stored = stored.withColumn("_no", scalars.clean_no(F.col("no").cast("string")))
            made = made.withColumn("_no", scalars.clean_no(F.col("entry.no").cast("string")))
        made = made.join(stored.groupBy(*keys).agg(F.max("event").alias("event")), keys, "left").drop("_no")
    return made
