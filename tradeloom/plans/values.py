"""Queries that exercise scalar functions, markup and small table operators, several at a time, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup, payloads
from ..functions import scalars as S
from ..operators import predicate, relay, spans, store, vectors
from ..sources import files
from ..streaming import tasks
from .catalogue import query, table
from .linked import LINES, lines


@query(
    """SELECT o_orderkey, replace(o_orderpriority, '-', '') AS clean, 'order no ' || o_orderkey AS spoken, length(o_orderkey::VARCHAR)::INTEGER AS code, o_orderkey % 2 = 0 AS numeric, 0.8 AS weight, length(o_orderpriority) > 24 AS example FROM orders"""
)
def token_shapes(spark, sf_dir):
    k = F.col("o_orderkey")
    number = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(",000"))).otherwise(F.concat(k.cast("string"), F.lit(" kg")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        S.clean_no("o_orderpriority").alias("clean"),
        S.humanise(F.concat(F.lit("orderNo"), k)).alias("spoken"),
        S.longest_code(F.concat(F.lit("x-"), k, F.lit(" yy"))).alias("code"),
        S.is_numeric(number).alias("numeric"),
        S.phrase_weight(F.concat(F.lit("a"), F.lpad(k.cast("string"), 6, "0"))).alias("weight"),
        S.is_value_example(F.col("o_orderpriority")).alias("example"),
    )


@query(
    r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS p FROM pages)
    SELECT page_id, CASE page_id % 5 WHEN 4 THEN false ELSE true END AS dead, page_id % 2 = 0 AS same,
    lower(regexp_replace(p, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '')) AS link, left(url, length(url) - length(regexp_extract(url, '[^/]*$', 0))) || 'next' AS applied FROM u"""
)
def link_tests(spark, sf_dir):
    k, url = F.col("page_id"), F.col("url")
    href = F.when(k % 5 == 0, "#top").when(k % 5 == 1, " JavaScript:void(0)").when(k % 5 == 2, "mailto:a@b").when(k % 5 == 3, "").otherwise(url)
    other = F.when(k % 2 == 0, F.concat(F.regexp_extract(url, "^([a-z]+://[^/]*)", 1), F.lit("/else"))).otherwise("https://nowhere.test/")
    last = F.regexp_extract(url, "[^/]*$", 0)
    head = F.substring(url, F.lit(1), F.length(url) - F.length(last))
    return table(spark, sf_dir, "pages").select("page_id", S.dead_href(href).alias("dead"), S.same_host(url, other).alias("same"), S.link_key(url).alias("link"), S.from_pattern(head, F.lit(""), F.lit("next")).alias("applied"))


@query(
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages), p AS (SELECT page_id, string_split(regexp_extract(url, '//([^/?]*)', 1), '.') AS h, list_filter(string_split(regexp_extract(regexp_replace(url, '^[a-z]+://[^/?]*', ''), '^([^?]*)', 1), '/'), lambda s: s <> '') AS s,
      list_filter(string_split(regexp_extract(url, '\?(.*)$', 1), '&'), lambda x: contains(x, '=')) AS q FROM u),
    c AS (SELECT page_id, 1.0 AS prior, unnest(list_transform(q, lambda x: regexp_extract(x, '=(.*)$', 1))) AS value FROM p UNION ALL SELECT page_id, 0.92, s[-1] FROM p WHERE len(s) > 0
      UNION ALL SELECT page_id, 0.8, unnest(s[1:len(s) - 1]) FROM p UNION ALL SELECT page_id, 0.05, unnest(list_filter(h, lambda x: x <> '')) FROM p)
    SELECT page_id, prior::DOUBLE AS prior, count(*) AS n, string_agg(value, ',' ORDER BY value) AS listed FROM c GROUP BY ALL"""
)
def url_identifiers_all(spark, sf_dir):
    """Every candidate for an identifier in a link, by its prior."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(S.url_identifiers(F.col("url"))).alias("c"))
    return found.groupBy("page_id", F.col("c.prior").alias("prior")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("c.value")), ",").alias("listed"))


DATES = """CASE o_orderkey % 6 WHEN 0 THEN '2024-03-05' WHEN 1 THEN 'x 24/3/5.' WHEN 2 THEN '2024-03/05' WHEN 3 THEN '12024-03-05' WHEN 4 THEN '2024.12.31 10:00' ELSE '010-1234-5678' END"""


@query(
    """SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 4) AS dated, CASE o_orderkey % 6 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '24/3/5' WHEN 4 THEN '2024.12.31' ELSE '' END AS literal, o_orderkey % 6 IN (0, 1, 4) AS as_date, o_orderkey % 6 = 5 OR o_orderkey % 6 IN (2, 3) AS as_phone, o_orderkey % 6 IN (2, 3, 5) AS as_identifier,
    CASE o_orderkey % 6 WHEN 0 THEN 'Date' WHEN 1 THEN 'TrackingCode' WHEN 2 THEN 'Numeric' WHEN 3 THEN 'Phone' WHEN 4 THEN 'Link' ELSE 'Text' END AS kind, CASE o_orderkey % 6 WHEN 2 THEN 'Number' ELSE 'String' END AS hint, o_orderkey % 6 = 3 AS placeholder FROM orders"""
)
def value_formats(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    v = pick("2024-03-05", "x 24/3/5.", "2024-03/05", "12024-03-05", "2024.12.31 10:00", "010-1234-5678")
    name = pick("order_date", "tracking_number", "sale_price", "phone", "link", "memo")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.has_date(v).alias("dated"), S.date_literal(v).alias("literal"), S.matches_format(F.lit("Date"), v).alias("as_date"), S.matches_format(F.lit("Phone"), v).alias("as_phone"), S.matches_format(F.lit("Identifier"), v).alias("as_identifier"),
        S.field_format(name).alias("kind"), S.type_hint(name).alias("hint"), S.is_placeholder(pick("1", "yyyy", "x", "N/A", "nul", "stringy")).alias("placeholder"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'KRW' ELSE 'USD' END AS currency, (o_orderkey % 5)::INTEGER AS condition, '9123456,77-88-99' AS numbers,
    CASE WHEN days > 365 THEN floor(days / 365)::BIGINT || ' years ago' WHEN days > 30 THEN floor(days / 30)::BIGINT || ' months ago' WHEN days > 1 THEN days || ' days ago' WHEN days = 1 THEN '24 hours ago' ELSE 'just now' END AS age, 'a,b' AS phrases
    FROM (SELECT *, datediff('day', o_orderdate, TIMESTAMP '1998-08-02') AS days FROM orders) WHERE days >= 0"""
)
def words_of_values(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") <= F.lit("1998-08-02").cast("timestamp_ntz"))
    given = F.when(k % 3 == 0, " eur").otherwise("")
    state = F.element_at(F.array(*[F.lit(x) for x in ("new", "Used once", "lease", "rental car", "refurbished")]), (k % 5 + 1).cast("int"))
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    now = F.unix_millis(F.lit("1998-08-02").cast("timestamp"))
    return o.select(
        "o_orderkey", S.currency(given, F.when(k % 3 == 1, "ko").otherwise("xx")).alias("currency"), S.condition_code(state).alias("condition"), F.array_join(S.tracking_numbers(F.lit("no 9123456 or 77-88-99 not 12345")), ",").alias("numbers"), S.relative_age(millis, now).alias("age"), F.array_join(S.split_phrases(F.lit("a, b/a|")), ",").alias("phrases")
    )


@query("""SELECT doc, (SELECT max(p.pos) FROM t p WHERE p.doc = t.doc AND p.pos < t.pos AND p.indent < t.indent)::INTEGER AS parent, pos::INTEGER AS pos,
    (coalesce((SELECT min(n.pos) FROM t n WHERE n.doc = t.doc AND n.pos > t.pos AND n.indent <= t.indent), (SELECT max(m.pos) + 1 FROM t m WHERE m.doc = t.doc)) - 1)::INTEGER AS stop FROM (SELECT 1) x,
    (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey % 4 AS indent FROM lineitem) t""".replace(
    "FROM t p", "FROM (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey % 4 AS indent FROM lineitem) p").replace(
    "FROM t n", "FROM (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey % 4 AS indent FROM lineitem) n").replace(
    "FROM t m", "FROM (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem) m").replace("(SELECT max(p.pos)", "coalesce((SELECT max(p.pos)").replace("p.indent < t.indent)::INTEGER AS parent", "p.indent < t.indent), -1)::INTEGER AS parent"))
def indent_tree(spark, sf_dir):
    """The parent of each line by its indent, and where its block ends."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).alias("pos"), (F.col("l_partkey") % 4).cast("int").alias("indent"))
    return markup.indent_tree(rows, "doc")


@query(
    """SELECT l_orderkey AS doc, l_linenumber AS col, (coalesce(sum(l_suppkey % 3 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS at FROM lineitem"""
)
def column_cursor(spark, sf_dir):
    """The column of each cell by the spans before it."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("row"), F.col("l_linenumber").alias("col"), "l_partkey", "l_suppkey", (F.col("l_suppkey") % 3 + 1).alias("colspan"))
    return markup.column_cursor(rows, ["doc", "row"], ["col", "l_partkey", "l_suppkey"]).select("doc", "col", "at")


@query("SELECT p_partkey, 'Price' AS label, p_retailprice::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'Name', p_name FROM part UNION ALL SELECT p_partkey, 'Memo', 'm' || p_size FROM part UNION ALL SELECT p_partkey, 'kind', p_brand FROM part")
def label_value_pairs(spark, sf_dir):
    """Pairs of a form, and the selected option of its list."""
    part = table(spark, sf_dir, "part")
    html = F.concat(
        F.lit("<table><tr><th>Price</th><td>"), F.col("p_retailprice").cast("string"), F.lit("</td></tr><tr><th>Name</th><td>"), F.col("p_name"), F.lit("</td></tr></table><input placeholder='Memo' value='m"), F.col("p_size").cast("string"),
        F.lit("'><select name='kind'><option>other</option><option selected>"), F.col("p_brand"), F.lit("</option></select>"),
    )
    pages = part.select("p_partkey", html.alias("html"))
    pairs = markup.html_pairs(pages, "p_partkey")
    picked = markup.html_selects(pages, "p_partkey").select("p_partkey", F.col("name").alias("label"), F.col("selected").alias("value"))
    return pairs.unionByName(picked)


@query("SELECT p_partkey, 'li.row' AS selector, (p_size % 5 + 3)::INTEGER AS n FROM part")
def repeated_row_selectors(spark, sf_dir):
    """The selector of the rows that repeat on a page."""
    rows = F.repeat(F.lit("<li class='row'><b>x</b></li>"), (F.col("p_size") % 5 + 3).cast("int"))
    pages = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<div><p>a</p></div><ul>"), rows, F.lit("</ul>")).alias("html"))
    return markup.html_repeats(pages, "p_partkey")


@query("SELECT doc_id, '<div>' || array_to_string(string_split(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10)), '</div>' || chr(10) || '<div>') || '</div>' AS html FROM documents")
def text_as_markup(spark, sf_dir):
    """The lines of a text as elements, so that it takes the way of a page."""
    return table(spark, sf_dir, "documents").select("doc_id", files.as_markup(F.col("text")).alias("html"))


@query("SELECT o_orderkey, 10 AS status, 'late' AS note FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderkey % 2 = 1")
def insert_update_recover(spark, sf_dir):
    """Rows that were absent put in, columns of some rows set, and tasks that a crash left running set back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    stored = o.filter("o_orderkey % 2 = 0").withColumns({"status": F.lit(1), "note": F.lit("old")})
    moved = store.update_where(tasks.recover(stored), F.col("note") == "old", {"note": F.lit("late")})
    return store.insert_absent(moved, o.withColumns({"status": F.lit(1), "note": F.lit("new")}), "o_orderkey")


@query("SELECT count(*) AS rows, true AS any_open, false AS any_far FROM orders WHERE o_custkey % 3 = 1 AND o_totalprice >= 1000 AND o_totalprice <= 90000 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def tenant_ranges_probe(spark, sf_dir):
    """A team's rows in a range and from a day on, and probes for existence."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).cast("string").alias("to"), F.col("o_totalprice").alias("amount"), "o_orderstatus", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    kept = predicate.tenant(o, "1").filter(predicate.parse_condition("amount", {"gte": 1000, "lte": 90000}) & predicate.parse_condition("date", {"gte": "1995-01-01"}))
    return kept.agg(F.count("*").alias("rows")).withColumns({"any_open": F.lit(store.exists(o, F.col("o_orderstatus") == "O")), "any_far": F.lit(store.exists(o, F.col("amount") < -1))})


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def expired_results(spark, sf_dir):
    """Cached results of the last ten days, by the stamp in their key."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("cache_"), F.unix_millis(F.col("ts").cast("timestamp"))).alias("key"))
    stamp = F.regexp_extract("key", "([0-9]+)$", 1).cast("long")
    now = e.agg(F.max(stamp)).first()[0]
    return tasks.expire(e, stamp, now, 10).select("event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE '' END AS differs, 'x,y' AS merged FROM events")
def payload_tools(spark, sf_dir):
    """Payloads unpacked from gzip and nesting, compared, and their lists merged."""
    e = table(spark, sf_dir, "events")
    nested = payloads.gzipped(F.concat(F.lit('{"json_data":{"json_data":'), F.col("props"), F.lit("}}")))
    other = F.when(F.col("event_id") % 2 == 0, '{"a":1,"b":3}').otherwise('{"a":1,"b":2}')
    return e.select("event_id", F.get_json_object(payloads.unpacked(nested), "$.k").cast("long").alias("k"), F.array_join(payloads.differences(F.lit('{"a":1,"b":2}'), other), ",").alias("differs"), F.array_join(payloads.merged_by(F.lit('[{"n":"x"}]'), F.lit('[{"n":"x","q":1},{"n":"y"}]'), "n"), ",").alias("merged"))


@query(f"""SELECT id, coalesce(p_name, '-') AS name FROM ({LINES}) LEFT JOIN (SELECT p_name, p_partkey FROM part) ON goods = p_partkey AND goods <> 0""")
def property_look_up(spark, sf_dir):
    """The first record whose property equals a key, as text."""
    goods = table(spark, sf_dir, "part").filter("p_partkey <> 0").select(F.col("p_partkey").cast("string").alias("no"), "p_name")
    got = relay.look_up(lines(spark, sf_dir), "goods", goods, "no", [F.asc("p_name")])
    return got.select("id", F.coalesce("p_name", F.lit("-")).alias("name"))


@query("SELECT item_id, 0 AS start, len(list_filter(string_split_regex(trim(text, ' '), '\\s+'), lambda x: x <> ''))::INTEGER AS covered FROM benchmark")
def bridged_spans(spark, sf_dir):
    """Kept spans with the gaps between them: they cover a question whole."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "").alias("w"))
    grams = spans.ngrams(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "start", "size", (F.length("span") % 7 / 7).alias("score"))
    done = spans.bridged_by(spans.suppress_by(grams, "item_id"), words.select("item_id", F.size("w").alias("words")), "item_id")
    return done.groupBy("item_id").agg(F.min("start").cast("int").alias("start"), F.sum("size").cast("int").alias("covered"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS own, 0.0 AS none FROM embeddings")
def cosine_edges(spark, sf_dir):
    """The cosine of a vector with itself, and with one of no length."""
    e = table(spark, sf_dir, "embeddings")
    zero = F.transform("embedding", lambda x: x * 0)
    return e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("embedding")), 6).alias("own"), vectors.cosine(F.col("embedding"), zero).alias("none"))
