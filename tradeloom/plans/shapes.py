"""Queries over shapes of links, identifiers, tags and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import shapes
from ..operators import metrics
from .catalogue import query, table

TAGS_SQL = ", ".join(f"'{t}'" for t in shapes.MARKUP_TAGS)


@query(
    r"""SELECT page_id, length(regexp_extract(url, '^([^:/?#]*:)?//[^/?#]*', 0))::INTEGER AS host_end,
    regexp_matches(lower(regexp_extract(url, '//([^/?#]*)', 1)), '(^|\.)example\.(com|org)$') AS shop,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/a/c?x=1' AS absolute,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1), '[^/]*$', '') || 'next.html' AS beside FROM pages"""
)
def link_shapes(spark, sf_dir):
    url = F.col("url")
    shop = shapes.host_matches(S.url_parts(url)[0], ["*.example.com", "example.org"])
    return table(spark, sf_dir, "pages").select(
        "page_id", shapes.host_end(url).alias("host_end"), shop.alias("shop"), shapes.resolved(F.lit("/a/b/../c?x=1"), url).alias("absolute"), shapes.resolved(F.lit("./next.html"), url).alias("beside")
    )


@query(
    r"""WITH w AS (SELECT p.page_id, p.url, d.word FROM pages p JOIN (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS word FROM documents) d ON d.doc_id = p.page_id)
    SELECT page_id, count(*) FILTER (WHERE length(word) >= 4 AND regexp_matches(word, '[0-9]') AND contains(lower(url), lower(word))) AS in_url, count(*) AS words FROM w GROUP BY page_id"""
)
def value_in_url_pool(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(shapes.words_of(F.col("text")))).alias("word"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    met = words.join(pages, F.col("doc_id") == F.col("page_id"))
    return met.groupBy("page_id").agg(F.count_if(shapes.in_url_pool(F.col("word"), F.col("url"))).alias("in_url"), F.count("*").alias("words"))


@query(
    f"""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'td[x] | ' || p_name WHEN 1 THEN 'Note | ' || p_name WHEN 2 THEN ' TR ' ELSE p_name END AS v FROM part),
    t AS (SELECT *, lower(regexp_extract(trim(v, ' '), '^([^\\[ (|]*)[^|]*\\|', 1)) AS tag FROM v)
    SELECT p_partkey, trim(v, ' ') = '' OR lower(trim(v, ' ')) IN ({TAGS_SQL}) OR tag IN ({TAGS_SQL}) AS markup,
    CASE WHEN tag IN ({TAGS_SQL}) THEN trim(regexp_replace(trim(v, ' '), '^[^|]*\\|', ''), ' ') ELSE trim(v, ' ') END AS clean FROM t"""
)
def markup_values(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    v = F.when(k == 0, F.concat(F.lit("td[x] | "), name)).when(k == 1, F.concat(F.lit("Note | "), name)).when(k == 2, F.lit(" TR ")).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", shapes.is_markup(v).alias("markup"), shapes.without_markup(v).alias("clean"))


LINES = "SELECT doc_id, pos - 1 AS pos, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"
RUNS = r"regexp_split_to_array(regexp_extract(line, '^[^|]*\|(.*)$', 1), '[^\p{L}\p{N}]+')"


def _labelled(spark, sf_dir):
    """The lines of documents, each with its first word as label."""
    lines = metrics.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.withColumn("line", F.concat(F.substring_index("line", " ", 1), F.lit(" | "), F.col("line")))


@query(
    rf"""WITH l AS (SELECT doc_id, pos, split_part(line, ' ', 1) AS head, split_part(line, ' ', 1) || ' | ' || line AS line FROM ({LINES}) WHERE line <> ''),
    w AS (SELECT doc_id, pos, CASE WHEN contains(head, '|') THEN NULL ELSE head END AS head, unnest(list_filter({RUNS}, lambda x: x <> '')) AS token, unnest(range(0, len(list_filter({RUNS}, lambda x: x <> '')))) AS spot FROM l),
    f AS (SELECT doc_id, CASE WHEN lower(regexp_extract(head, '^([^\[ (]*)', 1)) IN ({TAGS_SQL}) THEN 'identifier code number' ELSE head END AS label, token, min(pos * 1000000 + spot) AS first
      FROM w WHERE length(token) BETWEEN 2 AND 32 AND regexp_matches(token, '[0-9]') AND head IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS place FROM f)
    SELECT doc_id, label, token, place::INTEGER AS place FROM r WHERE place <= 48"""
)
def labelled_token_candidates(spark, sf_dir):
    lines = _labelled(spark, sf_dir).filter(~F.substring_index("line", " ", 1).contains("|"))
    return shapes.labelled_tokens(lines, "doc_id", "line")


@query(
    rf"""WITH l AS (SELECT doc_id, pos, split_part(line, ' ', 1) || ' | ' || line AS line FROM ({LINES}) WHERE line <> '' AND NOT contains(split_part(line, ' ', 1), '|')),
    w AS (SELECT doc_id, pos, unnest(list_filter({RUNS}, lambda x: x <> '')) AS token, unnest(range(0, len(list_filter({RUNS}, lambda x: x <> '')))) AS spot FROM l)
    SELECT doc_id, arg_min(token, pos * 1000000 + spot) AS token FROM w WHERE length(token) >= 8 AND regexp_matches(token, '[0-9]') GROUP BY doc_id"""
)
def first_identifier_token(spark, sf_dir):
    lines = _labelled(spark, sf_dir).filter(~F.substring_index("line", " ", 1).contains("|"))
    return shapes.first_identifier(lines, "doc_id", "line")


@query(
    """WITH s AS (SELECT n_regionkey AS g, min(length(c_custkey::VARCHAR)) AS least, max(length(c_custkey::VARCHAR)) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT o_orderkey, n_regionkey AS g, length(o_orderkey::VARCHAR) BETWEEN greatest(least - 2, 0) AND most + 2 AS digits_fit, false AS mixed_fit
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN s ON g = n_regionkey"""
)
def identifier_shapes(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    people = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_regionkey").alias("g"))
    learned = shapes.learned_shapes(people.withColumn("token", F.col("c_custkey").cast("string")), ["g"], "token")
    rows = o.join(people, o.o_custkey == people.c_custkey).join(learned, "g")
    key = F.col("o_orderkey").cast("string")
    return rows.select("o_orderkey", "g", shapes.shape_allowed(key).alias("digits_fit"), shapes.shape_allowed(F.concat(F.lit("A"), key)).alias("mixed_fit"))


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'th' WHEN 'view' THEN 'tr' WHEN 'purchase' THEN 'h2' ELSE 'td' END AS tag, event_type IN ('click', 'purchase') AS label, event_type IN ('click', 'view', 'purchase') AS no_value,
    event_id % 2 = 0 AS multi, event_id % 2 = 1 AS id_link FROM events"""
)
def tag_and_field_tests(spark, sf_dir):
    kind = F.col("event_type")
    tag = F.when(kind == "click", "th").when(kind == "view", "tr").when(kind == "purchase", "h2").otherwise("td")
    field = F.when(F.col("event_id") % 2 == 0, "Shipping_Address").otherwise("ID, Link")
    return table(spark, sf_dir, "events").select(
        "event_id", tag.alias("tag"), shapes.is_label_tag(tag).alias("label"), shapes.holds_no_value(tag).alias("no_value"), shapes.is_multi_value(field).alias("multi"), shapes.is_id_link(field).alias("id_link")
    )


@query(
    """SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) - (o_orderkey % 9) * 86400000 AS since, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 60 ELSE 540 END::INTEGER AS zone,
    strftime(o_orderdate, '%Y-%m-%d') AS started, CASE WHEN o_orderkey % 2 = 0 THEN '2030-01-01' END AS expired FROM orders"""
)
def zones_and_dates(spark, sf_dir):
    lang = F.when(F.col("o_orderpriority") == "1-URGENT", "EN").when(F.col("o_orderpriority") == "2-HIGH", "fr").otherwise("xx")
    given = F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = F.col("o_orderkey") % 2 == 1
    started, expired = shapes.filled_dates(F.when(odd, given).otherwise(""), given, F.lit(""), F.when(odd, "").otherwise("2030-01-01"))
    since = shapes.midnight_before(F.col("o_orderdate"), F.col("o_orderkey") % 9)
    return table(spark, sf_dir, "orders").select("o_orderkey", since.alias("since"), shapes.utc_offset(lang).alias("zone"), started.alias("started"), expired.alias("expired"))


@query(
    """WITH g AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, p_name)[1:5] AS items FROM lineitem JOIN part ON l_partkey = p_partkey WHERE length(p_name) > 3 GROUP BY 1)
    SELECT o_orderkey, 'This is a Commercial Invoice document. Document number is ' || o_orderkey || '. Issued on ' || strftime(o_orderdate, '%Y-%m-%d') || '. Buyer/Consignee is ' || c_name || '. Total amount is ' || (o_totalprice::DECIMAL(18,2))::VARCHAR || ' USD.'
      || CASE WHEN items IS NULL THEN '' ELSE ' Contains items: ' || array_to_string(items, ', ') || '.' END AS summary
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN g ON l_orderkey = o_orderkey"""
)
def document_summary(spark, sf_dir):
    li, p, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "customer"))
    named = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("items"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(named, o.o_orderkey == named.l_orderkey, "left")
    none = F.lit(None).cast("string")
    text = shapes.summary(
        F.lit("CI"), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("N/A"), F.col("c_name"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), none, none, none, none, F.coalesce(F.col("items.p_name"), F.array().cast("array<string>"))
    )
    return rows.select("o_orderkey", text.alias("summary"))


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R')::INTEGER AS kept FROM lineitem GROUP BY 1")
def rows_trimmed(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("rows"))
    return listed.select("l_orderkey", F.size(shapes.without_equal(F.col("rows"), "l_returnflag", "R")).alias("kept"))


@query(
    """WITH r AS (SELECT l_returnflag, property, coalesce(min(nullif(x, 0)), 0) AS min_value, coalesce(max(nullif(x, 0)), 0) AS max_value
      FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_tax, l_quantity * 0 AS empty FROM lineitem) ON l_quantity, l_tax, empty INTO NAME property VALUE x) GROUP BY ALL)
    SELECT * FROM r WHERE property <> 'empty'"""
)
def property_ranges_known(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("empty", F.col("l_quantity") * 0)
    ranges = metrics.ranges(rows, ["l_returnflag"], ["l_quantity", "l_tax", "empty"])
    wanted = ranges.select("l_returnflag", "property").distinct()
    return shapes.known_ranges(wanted, ranges, ["l_returnflag"])


@query("SELECT c_custkey, c_name AS back, true AS hidden FROM customer")
def sealed_and_opened(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    shut = table(spark, sf_dir, "customer").select("c_custkey", "c_name", shapes.sealed(F.col("c_name"), key).alias("shut"))
    hidden = ~F.col("shut").contains(F.col("c_name")) & shapes.opened(F.col("shut"), F.lit("fedcba9876543210")).isNull()
    return shut.select("c_custkey", shapes.opened(F.col("shut"), key).alias("back"), hidden.alias("hidden"))


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(trim(text, ' ')), '\\s+'), lambda w: w <> '' AND w NOT IN ('the', 'and', 'of')))::INTEGER AS n FROM documents WHERE text IS NOT NULL")
def question_words(spark, sf_dir):
    words = shapes.query_words(F.col("text"), ("the", "and", "of"))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(words).alias("n"))
