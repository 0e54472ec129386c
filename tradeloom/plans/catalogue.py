"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, payloads
from ..functions import scalars as S
from ..operators import metrics, predicate, records, relay, spans, store, vectors
from ..streaming import tasks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice >= 1500 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10"""
)
def condition_filter_page(spark, sf_dir):
    context = {"status": "O", "condition": {"sale_price": {"operator": "gte", "value": "1,500"}}}
    names = {"status": "o_orderstatus", "amount": "o_totalprice", "created_at": "o_orderdate"}
    rows = table(spark, sf_dir, "orders").filter(predicate.condition(context, names))
    rows = rows.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return predicate.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 10)


HASH = "'0x' || substr(sha256({0}), 1, 40)"


def rounded(name, digits=6):
    return F.round(name, digits).alias(name if isinstance(name, str) else "x")


# ---- predicates, paging, top


@query(
    """SELECT o_orderkey, o_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE n_regionkey = 1 AND o_orderstatus IN ('O', 'F')"""
)
def tag_scope_filter(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumns({"cc": F.col("n_regionkey").cast("string"), "type": F.col("o_orderstatus")})
    kept = rows.filter(predicate.tag_filter("host:1 mode:commerce") & predicate.scope_filter(cc="1", types=("O", "F")))
    return kept.select("o_orderkey", "o_custkey", "n_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'")
def incremental_newer_than(spark, sf_dir):
    return predicate.newer_than(table(spark, sf_dir, "orders"), "o_orderdate", F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).select("o_orderkey", "o_orderdate")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%and%' AND text ILIKE '%with%'")
def all_words_ilike(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(predicate.all_words("the AND with", ["text"])).select("doc_id")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 300")
def dynamic_sort_top300(spark, sf_dir):
    return predicate.page(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 300)


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    WHERE l_extendedprice >= (SELECT quantile_disc(l_extendedprice, 0.8) FROM lineitem)"""
)
def top_bottom_percent(spark, sf_dir):
    return predicate.share(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 20.0)


@query("SELECT o_orderkey, o_orderdate FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 300) ORDER BY o_orderdate")
def limit_before_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return predicate.limit_first(rows, [F.asc("o_orderkey")], 300, [F.asc("o_orderdate"), F.asc("o_orderkey")])


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id DESC, turn LIMIT 40 OFFSET 20")
def talks_page(spark, sf_dir):
    return predicate.page(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), [F.desc("conv_id"), F.asc("turn")], 40, 20)


# ---- values


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_extendedprice END AS amount FROM lineitem")
def amount_coalesce(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    named = F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.lit(None).cast("double").alias("total_amount"), F.col("l_discount").alias("price")))
    payload = F.when(F.col("l_linenumber") % 2 == 0, F.to_json(named)).otherwise(F.to_json(F.struct(F.col("l_extendedprice").alias("sale_price"), F.col("l_tax").alias("price"))))
    keys = ["total_amount", "sale_price", "supply_price", "price", "shipping_fee", "discount"]
    return rows.select("l_orderkey", "l_linenumber", S.first_present(payload, keys).alias("amount"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN 5 ELSE epoch_ms(o_orderdate) - CASE o_orderkey % 8 WHEN 6 THEN 32400000 ELSE 0 END END AS created FROM orders"""
)
def created_at_coalesce(spark, sf_dir):
    """The day of a record by the first of the eight date keys that it has: each in turn, with a zone, and an unreadable one."""
    k = F.col("o_orderkey") % 8
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    named = [F.when(k == i, F.concat(text, F.lit("+09:00") if i == 6 else F.lit(""))).alias(name) for i, name in enumerate(records.DATE_KEYS[:7])]
    data = F.to_json(F.struct(*named, F.when(k == 7, "some day").otherwise("1999-01-01T00:00:00").alias(records.DATE_KEYS[7])))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.created_of(records.parsed(data), F.lit(5).cast("long")).alias("created"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 9 WHEN 'O' THEN 1 ELSE 10 END AS code, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'progress' ELSE 'draft' END AS word FROM orders")
def status_code(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", " Complete").when(F.col("o_orderstatus") == "O", "progress").otherwise("DRAFT")
    coded = table(spark, sf_dir, "orders").select("o_orderkey", S.status_code(word).alias("code"))
    return coded.withColumn("word", S.status_word(F.col("code")))


@query(f"SELECT doc_id, {HASH.format('doc_id::VARCHAR || source')} AS id FROM documents")
def hashed_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.hash_id(F.concat(F.col("doc_id").cast("string"), "source")).alias("id"))


@query()
def crc32_index(spark, sf_dir):
    index = S.entity_index(F.lit("order"), F.lit("team"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", index.alias("index"), S.entity_id(F.lit("team"), index).alias("id"))


@query(
    f"""SELECT digest, count(*) AS n, min(doc_id) AS first_id FROM (
      SELECT doc_id, {HASH.format("lower(regexp_replace(translate(text, 'OoIlSsBZz', '001155822'), '[\\p{P}\\p{S}\\p{Z}]', '', 'g'))")} AS digest FROM documents)
    GROUP BY digest HAVING count(*) > 1"""
)
def digest_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", S.digest(F.col("text")).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(
    """WITH t AS (SELECT doc_id, unnest(list_distinct(string_split_regex(text, '\\s+'))) AS token FROM documents)
    SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(token, '(^|[^0-9])[0-9]{2,4}-[0-9]{1,2}-[0-9]{1,2}($|[^0-9])')
        OR regexp_matches(token, '(^|[^0-9])[0-9]{2,4}/[0-9]{1,2}/[0-9]{1,2}($|[^0-9])')
        OR regexp_matches(token, '(^|[^0-9])[0-9]{2,4}[.][0-9]{1,2}[.][0-9]{1,2}($|[^0-9])')) AS dates FROM t"""
)
def field_format_gate(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("token"))
    return tokens.agg(F.count("*").alias("n"), F.count_if(S.matches_format(F.lit("Date"), F.col("token"))).alias("dates"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS iso FROM orders")
def date_normalise(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    given = F.when(k == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(k == 1, F.date_format("o_orderdate", "M-d-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.normalise_date(given).alias("iso"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderdate + INTERVAL 3 HOUR + INTERVAL 9 HOUR AS t FROM orders),
    r AS (SELECT *, date_trunc('day', t) AS d, date_trunc('month', t) AS m, date_trunc('year', t) AS y FROM o)
    SELECT o_orderkey, epoch_ms(CASE k WHEN 0 THEN d WHEN 1 THEN d - INTERVAL 1 DAY WHEN 2 THEN m WHEN 3 THEN m - INTERVAL 1 MONTH WHEN 4 THEN y WHEN 5 THEN y - INTERVAL 1 YEAR ELSE t - INTERVAL 7 DAY END) - 32400000 AS start,
    epoch_ms(CASE k WHEN 1 THEN d WHEN 3 THEN m WHEN 5 THEN y ELSE t END) - 32400000 - CASE WHEN k IN (1, 3, 5) THEN 1 ELSE 0 END AS finish FROM r"""
)
def time_intent_range(spark, sf_dir):
    """All seven intents, seen from each order's day."""
    intents = ["today", "yesterday", "this_month", "last_month", "this_year", "last_year", "recently"]
    intent = F.element_at(F.array(*[F.lit(i) for i in intents]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    a, b = S.time_range(intent, F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 3 HOURS"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("start"), b.alias("finish"))


@query(
    """WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, (CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 4 + 2) % 4 ELSE o_orderkey % 4 END) * 3 + 3 AS m FROM orders)
    SELECT o_orderkey, make_date(y, m, 1) AS first_day, (make_date(y, m, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS last_day FROM o"""
)
def season_range(spark, sf_dir):
    """All seasons in both hemispheres, in the year of each order."""
    k = F.col("o_orderkey")
    season = F.element_at(F.array(*[F.lit(x) for x in ("spring", "summer", "autumn", "winter")]), (k % 4 + 1).cast("int"))
    a, b = S.season_range(season, F.year("o_orderdate"), k % 2 == 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("first_day"), b.alias("last_day"))


@query("SELECT o_orderkey, round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR AS plain FROM orders")
def thousands_strip(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.strip_thousands(F.format_number("o_totalprice", 2)).alias("plain"))


@query("SELECT doc_id, trim(regexp_replace(text, '[^\\x20-\\x7E가-힣ㄱ-ㆎ]+', ' ', 'g'), ' ') AS clean FROM documents")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.sanitize(F.col("text")).alias("clean"))


@query(
    """SELECT lang, CASE doc_id % 9 WHEN 0 THEN 'ko' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' WHEN 3 THEN 'ru' WHEN 4 THEN 'ar' WHEN 5 THEN 'hi' WHEN 6 THEN 'th' WHEN 7 THEN CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'unknown' END ELSE 'unknown' END AS block, count(*) AS n FROM documents GROUP BY ALL"""
)
def lang_block(spark, sf_dir):
    """The script of texts: each block in front of a text in another, as the priority goes, and digits alone."""
    marks = ["상품 ", "かな ", "漢字 ", "текст ", "نص ", "पाठ ", "ข้อความ ", ""]
    k = F.col("doc_id") % 9
    text = F.when(k == 8, "12 34")
    for i, mark in enumerate(marks):
        text = text.when(k == i, F.concat(F.lit(mark), "text"))
    return table(spark, sf_dir, "documents").groupBy("lang", S.language_block(text).alias("block")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.element_at(records.parsed(F.col("props")), F.lit("k")).try_cast("long").alias("k"))


@query("SELECT p_partkey, 'name is ' || p_name || '. brand is ' || p_brand || '. size is ' || p_size || '.' AS sentence FROM part")
def json_to_sentence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.sentence([("name", F.col("p_name")), ("brand", F.col("p_brand")), ("size", F.col("p_size")), ("note", F.lit(""))]).alias("sentence"))


@query("SELECT event_id, user_id, CASE WHEN value = 0 OR value IS NULL THEN event_id::DOUBLE ELSE value END AS merged FROM events")
def merge_node(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", S.merge_value(F.col("event_id").cast("double"), F.col("value")).alias("merged"))


@query("SELECT event_id, props AS back FROM events")
def gzip_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", payloads.gunzipped(payloads.gzipped("props")).alias("back"))


# ---- URLs and markup


@query(
    """SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)) AS host,
    regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*', ''), '^([^?]*)', 1) AS path FROM pages"""
)
def url_split(spark, sf_dir):
    host, path, _ = S.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))


@query(
    """WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '//([^/?#]*)', 1)), '.') AS l FROM pages)
    SELECT page_id, CASE WHEN array_to_string(l[-2:], '.') IN ('co.kr','or.kr','go.kr','ne.kr','co.jp','or.jp','ne.jp','co.uk','org.uk','com.cn','com.au')
      THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM h"""
)
def base_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.base_domain(S.url_parts(F.col("url"))[0]).alias("domain"))


@query(
    """WITH u AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS p FROM pages)
    SELECT page_id, p[-1] AS value, 0.92 AS prior FROM u WHERE len(p) > 0"""
)
def url_id_candidates(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(S.url_identifiers(F.col("url"))).alias("c"))
    return found.filter("c.prior = 0.92").select("page_id", "c.value", F.col("c.prior").cast("decimal(3,2)").alias("prior"))


@query(
    """WITH u AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS p FROM pages)
    SELECT page_id, substr(url, 1, length(url) - length(p[-1]) - (CASE WHEN suffix(url, '/') THEN 1 ELSE 0 END)) AS head FROM u WHERE len(p) > 0 AND strpos(url, '?') = 0 AND strpos(url, '#') = 0"""
)
def url_pattern(spark, sf_dir):
    found = table(spark, sf_dir, "pages").filter(~F.col("url").rlike("[?#]")).select("page_id", "url", F.explode(S.url_identifiers(F.col("url"))).alias("c")).filter("c.prior = 0.92")
    return found.select("page_id", S.url_pattern(F.col("url"), F.col("c.value"))[0].alias("head"))


@query("SELECT page_id, len(regexp_extract_all(html, '\\shref\\s*=\\s*\"([^\"]*)\"', 1, 'i')) AS links FROM pages")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(markup.links(F.col("html"))).cast("long").alias("links"))


@query()
def html_preclean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(markup.preclean(F.col("html"))).alias("n"), F.sha2(markup.preclean(F.col("html")), 256).alias("sha"))


@query()
def html_lines(spark, sf_dir):
    return markup.html_lines(table(spark, sf_dir, "pages")).select("page_id", "pos", "indent", "tag", "href", "text")


@query()
def html_sections(spark, sf_dir):
    lines = markup.section_of(markup.html_lines(table(spark, sf_dir, "pages")))
    return lines.filter(F.col("tag") == "p").select("page_id", "pos", "section", "text")


@query()
def html_titles(spark, sf_dir):
    return markup.title_candidates(markup.html_lines(table(spark, sf_dir, "pages")))


# ---- aggregates


@query("SELECT event_type, user_id % 10 AS site, count(*) FILTER (WHERE value < 1) AS draft, count(*) FILTER (WHERE value >= 1) AS n FROM events GROUP BY ALL")
def metrics_draft_count(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("site", F.col("user_id") % 10)
    return metrics.draft_counts(rows, ["event_type", "site"], F.col("value") < 1)


@query(
    """SELECT l_returnflag, property, coalesce(min(nullif(x, 0)), 0) AS min_value, coalesce(max(nullif(x, 0)), 0) AS max_value
    FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME property VALUE x) GROUP BY ALL"""
)
def metrics_min_max_nonzero(spark, sf_dir):
    return metrics.ranges(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(
    """WITH d AS (SELECT event_type, count(*) AS draft, count(*) AS n FROM events GROUP BY 1), c AS (SELECT event_type, -count(*) - 5 AS draft, 3 AS n FROM events WHERE value < 50 GROUP BY 1)
    SELECT event_type, greatest(0, sum(draft))::BIGINT AS draft, greatest(0, sum(n))::BIGINT AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM c) GROUP BY 1"""
)
def metrics_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    counts = e.groupBy("event_type").agg(F.count("*").alias("draft"), F.count("*").alias("n"))
    changes = e.filter("value < 50").groupBy("event_type").agg((-F.count("*") - 5).alias("draft"), F.lit(3).cast("long").alias("n"))
    return metrics.apply_deltas(counts, changes, ["event_type"])


@query(
    """WITH l AS (SELECT doc_id, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    SELECT line, count(*) AS n, count(DISTINCT doc_id) AS items FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1"""
)
def text_frequency_noise(spark, sf_dir):
    lines = metrics.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return metrics.line_frequency(lines, "doc_id").filter("n > 1").select("line", "n", "items")


@query(
    """WITH l AS (SELECT conv_id, turn, role FROM conversations), f AS (SELECT conv_id, role, count(DISTINCT turn) AS items FROM l GROUP BY ALL),
    s AS (SELECT conv_id, count(DISTINCT turn) AS all_items FROM l GROUP BY 1)
    SELECT f.conv_id, role AS line, items, all_items FROM f JOIN s ON f.conv_id = s.conv_id WHERE items >= ceil(all_items * 0.4)"""
)
def item_df_threshold(spark, sf_dir):
    return metrics.boilerplate(table(spark, sf_dir, "conversations").withColumnRenamed("role", "line"), "turn", "conv_id", 0.4).select("conv_id", "line", "items", "all_items")


@query(
    """WITH l AS (SELECT doc_id, trim(u.line, ' ') AS line, u.pos FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'pos': i})) AS u FROM documents)),
    g AS (SELECT doc_id, line, pos - lag(pos) OVER (PARTITION BY doc_id, line ORDER BY pos) AS gap FROM l WHERE line <> '')
    SELECT doc_id, line, CAST(min(gap) AS INTEGER) AS min_gap, CAST(max(gap) AS INTEGER) AS max_gap, count(*) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY ALL"""
)
def occurrence_gaps(spark, sf_dir):
    return metrics.gaps(metrics.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
    SELECT user_id, event_type, rn // 300 AS part, n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS logs FROM r GROUP BY ALL"""
)
def log_group_by_href(spark, sf_dir):
    """All logs of a key, in parts of 300, with the key's count over all rows."""
    got = metrics.group_all_logs(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", F.col("event_id").cast("string"))
    return got.withColumn("logs", F.array_join("logs", ","))


# ---- upserts and set operations


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return store.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_name FROM customer
    UNION ALL SELECT c_custkey + 1000000, c_acctbal, c_name FROM customer WHERE c_custkey % 50 = 0"""
)
def upsert_latest_wins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    changed = c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = c.filter("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    old = c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") - 7)
    edits = changed.withColumn("at", F.lit(2)).unionByName(old.withColumn("at", F.lit(1))).unionByName(new.withColumn("at", F.lit(1)))
    return store.upsert(c.withColumn("at", F.lit(0)), edits, "c_custkey", [F.desc("at")], guard="at").drop("at")


@query(
    """WITH o AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE 5.0 END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE '' END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(nullif(n.c_acctbal, 0), o.c_acctbal) AS c_acctbal, coalesce(nullif(n.c_mktsegment, ''), o.c_mktsegment, '-') AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey
    WHERE coalesce(nullif(n.c_acctbal, 0), o.c_acctbal) IS NOT NULL"""
)
def merge_records(spark, sf_dir):
    """Stored and new records by key: new values win unless empty or zero, and either side may be missing."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.filter(k % 5 != 0).select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.filter(k % 7 != 0).select("c_custkey", F.when(k % 2 == 0, 0.0).otherwise(5.0).alias("c_acctbal"), F.when(k % 3 == 0, "NEW").otherwise("").alias("c_mktsegment"))
    got = store.merge(old, new, "c_custkey", ["c_acctbal", "c_mktsegment"])
    return got.filter("c_acctbal is not null").withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("-")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 4 = 1")
def sync_delta(spark, sf_dir):
    server = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 4
    local = server.filter(k != 0).withColumn("o_orderdate", F.when(k == 1, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate")))
    return store.sync_delta(server, local, "o_orderkey", "o_orderdate")


@query("SELECT c_custkey AS id, c_name AS name, 'user' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'team' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def users_union_team(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("user").alias("kind"))
    team = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("team").alias("kind"))
    return store.union_first("id", users, team)


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'items' WHEN event_type = 'purchase' THEN 'sales' ELSE 'users' END AS target, count(*) AS n FROM events GROUP BY 1")
def route_tables(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "Order").when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("user")
    return table(spark, sf_dir, "events").groupBy(store.route(kind).alias("target")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 10 ELSE CASE o_orderstatus WHEN 'O' THEN 9 ELSE 1 END END AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def queue_update_delete(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 10).otherwise(9).alias("status"))
    moved = rows.withColumn("status", F.when(F.col("status") == 9, 9).otherwise(F.when(F.col("status") == 1, 10).otherwise(tasks.next_status(F.col("status"), F.lit("done")))))
    gone = li.filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return store.delete_ids(moved, gone, "o_orderkey")


# ---- relay


@query("SELECT l_orderkey, l_linenumber, p_name, coalesce(p_retailprice, 0) AS price FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def relay_goods_order(spark, sf_dir):
    goods = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(0.0).alias("price"))
    return relay.relay(goods, lines, "p_partkey", "l_partkey", ["p_name", "price"]).select("l_orderkey", "l_linenumber", "p_name", "price")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_orderdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def relay_order_tracking(spark, sf_dir):
    return relay.relay(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "o_orderkey", "l_orderkey", ["o_orderstatus", "o_orderdate"]).select(
        "l_orderkey", "l_linenumber", "o_orderstatus", "o_orderdate"
    )


@query("SELECT o_orderkey, coalesce(l_linenumber, 0) AS l_linenumber, coalesce(l_discount, 0.0) AS l_discount FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) = 1) ON o_orderkey = l_orderkey")
def relay_event_discount(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    found = relay.look_up(keys, "o_orderkey", events, "l_orderkey", [F.desc("l_discount"), F.asc("l_linenumber")])
    return found.select("o_orderkey", "l_linenumber", "l_discount").na.fill(0, ["l_linenumber"]).na.fill(0.0, ["l_discount"])


@query("SELECT o_orderkey, l_partkey, l_quantity, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1)::INTEGER AS place FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def unnest_order_goods(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(entries.alias("goods")), "o_orderkey")
    return relay.unnest_goods(orders, "goods", ["o_orderkey"]).select("o_orderkey", "l_partkey", "l_quantity", "place")


@query("""SELECT DISTINCT (l_partkey + 3)::VARCHAR AS "index", 'goods' AS type, 0::BIGINT AS updated_at FROM lineitem WHERE l_partkey + 3 NOT IN (SELECT p_partkey FROM part)""")
def relay_draft_anti(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 3).alias("goods"))
    return relay.drafts(wanted, "goods", table(spark, sf_dir, "part"), "p_partkey", "goods")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def relay_exists_semi(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return relay.present(o, "o_orderkey", li, "l_orderkey").select("o_orderkey")


@query(
    """WITH k AS (SELECT DISTINCT 'p' || l_partkey AS v, l_orderkey AS id FROM lineitem),
    h0 AS (SELECT DISTINCT id FROM (SELECT l_orderkey AS id FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey LIMIT 20)),
    h1 AS (SELECT DISTINCT id FROM k WHERE v IN (SELECT v FROM k WHERE id IN (SELECT id FROM h0)) AND id NOT IN (SELECT id FROM h0)),
    s1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
    h2 AS (SELECT DISTINCT id FROM k WHERE v IN (SELECT v FROM k WHERE id IN (SELECT id FROM h1)) AND id NOT IN (SELECT id FROM s1))
    SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2"""
)
def cross_reference_2hop(spark, sf_dir):
    """What the 20 hits of a search, the dearest lines, lead to in two hops."""
    li = table(spark, sf_dir, "lineitem")
    keys = li.select(F.concat(F.lit("p"), "l_partkey").alias("key_value"), F.col("l_orderkey").alias("id"))
    hits = predicate.page(li.select(F.col("l_orderkey").alias("id"), "l_extendedprice"), [F.desc("l_extendedprice"), F.asc("id")], 20)
    return relay.cross_reference(keys, hits)


@query(
    """WITH k AS (SELECT DISTINCT source, doc_id FROM documents WHERE source IS NOT NULL),
    t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 11),
    b AS (SELECT DISTINCT k.doc_id AS me, t.doc_id AS id FROM k JOIN t ON k.source = t.source AND k.doc_id <> t.doc_id)
    SELECT me, id, (row_number() OVER (PARTITION BY me ORDER BY id))::INTEGER AS rank FROM b QUALIFY rank <= 10"""
)
def related_documents(spark, sf_dir):
    """The first ten others of the same source, for every document."""
    return relay.related_to_all(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("ref")))


# ---- vectors and search


def _query_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]


@query(
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score
    FROM embeddings WHERE label <> 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 20"""
)
def cosine_topk(spark, sf_dir):
    rows = vectors.nearest(table(spark, sf_dir, "embeddings"), "embedding", _query_vector(spark, sf_dir), 20, "vec_id", F.col("label") != 3)
    return rows.select("vec_id", rounded("score"))


SCORES = "SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings"


def scores(spark, sf_dir):
    vector = _query_vector(spark, sf_dir)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.cosine_to(F.col("embedding"), vector).alias("score"))


@query(f"SELECT label, round(greatest(0, max(score * CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.92 END)), 6) AS pooled FROM ({SCORES}) GROUP BY label")
def centroid_max_pool(spark, sf_dir):
    weight = F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.92)
    return vectors.max_pool(scores(spark, sf_dir), ["label"], F.col("score") * weight).select("label", rounded("pooled"))


def matrix(spark, sf_dir):
    s = scores(spark, sf_dir).groupBy(F.col("label"), (F.col("vec_id") % 7).alias("line")).agg(F.round(F.avg("score"), 6).alias("score"))
    return s.select((F.col("label") % 4).alias("doc"), F.col("label").alias("field"), "line", "score")


MATRIX = f"SELECT label % 4 AS doc, label AS field, vec_id % 7 AS line, round(avg(score), 6) AS score FROM ({SCORES}) GROUP BY label, vec_id % 7"


@query(
    f"""SELECT doc, field, line, round(score - avg(score) OVER (PARTITION BY doc, line) - avg(score) OVER (PARTITION BY doc, field) + avg(score) OVER (PARTITION BY doc), 5) AS centred FROM ({MATRIX})"""
)
def double_center(spark, sf_dir):
    return vectors.double_center(matrix(spark, sf_dir), "doc", "field", "line", "score").select("doc", "field", "line", rounded("centred", 5))


@query(
    f"""WITH m AS ({MATRIX}), r AS (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY score DESC, field) AS rank FROM m),
    t AS (SELECT doc, line, max(score) FILTER (WHERE rank = 1) AS a, max(score) FILTER (WHERE rank = 2) AS b FROM r GROUP BY ALL)
    SELECT r.doc, r.field, r.line, rank::INTEGER AS rank, round(score - CASE WHEN rank = 1 THEN coalesce(b, 0) ELSE a END, 5) AS margin FROM r JOIN t ON r.doc = t.doc AND r.line = t.line"""
)
def rival_margin(spark, sf_dir):
    return vectors.rivals(matrix(spark, sf_dir), ["doc", "line"], "score", "field").select("doc", "field", "line", "rank", rounded("margin", 5))


@query()
def exclusive_assign(spark, sf_dir):
    return vectors.exclusive_by_document(matrix(spark, sf_dir), "doc", "field", "line", "score", 0.0, 0.0)


@query(f"SELECT vec_id, label, round(exp((score - max(score) OVER (PARTITION BY label)) / 0.05) / sum(exp((score - m) / 0.05)) OVER (PARTITION BY label), 5) AS probability FROM (SELECT *, max(score) OVER (PARTITION BY label) AS m FROM ({SCORES}))")
def softmax_scores(spark, sf_dir):
    return vectors.softmax(scores(spark, sf_dir), ["label"], "score").select("vec_id", "label", rounded("probability", 5))


@query(f"SELECT label, round(sum(score * pow(0.5, rn - 1)), 5) AS decayed FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM ({SCORES})) WHERE rn <= 5 GROUP BY label")
def decay_sum_top5(spark, sf_dir):
    return vectors.decayed_top(scores(spark, sf_dir), ["label"], "score", "vec_id").select("label", rounded("decayed", 5))


@query(f"SELECT label, round(avg(score), 5) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM ({SCORES})) WHERE rn <= 10 GROUP BY label")
def top10_mean(spark, sf_dir):
    return vectors.top_mean(scores(spark, sf_dir), ["label"], "score", "vec_id").select("label", rounded("top_mean", 5))


@query(
    """WITH d AS (SELECT * FROM documents WHERE lang = 'en'),
    a AS (SELECT doc_id AS id, 3.0 AS score FROM d ORDER BY doc_id LIMIT 25),
    b AS (SELECT doc_id AS id, 2.0 AS score FROM d WHERE text ILIKE '%the%' AND text ILIKE '%with%' ORDER BY doc_id LIMIT 25),
    s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id IN (SELECT doc_id FROM d) ORDER BY s DESC, id LIMIT 25),
    c AS (SELECT id, 1.0 - (row_number() OVER (ORDER BY s DESC, id) - 1) * 0.001 AS score FROM s)
    SELECT id, round(sum(score), 6)::DOUBLE AS score, count(*) AS tracks FROM (SELECT id, score::DOUBLE AS score FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id ORDER BY sum(score) DESC, id LIMIT 20 OFFSET 5"""
)
def hybrid_three_track(spark, sf_dir):
    got = vectors.hybrid_search(
        table(spark, sf_dir, "documents"), "doc_id", ["text"], "the with", table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), F.col("lang") == "en", 20, 5
    )
    return got.select("id", rounded("score"), "tracks")


LAGS = 40


@query(
    f"""WITH r AS (SELECT label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT a.label, k.stride::INTEGER AS stride, round(avg(list_cosine_similarity(a.v, b.v)), 5) AS similarity
    FROM r a JOIN (SELECT unnest(range(2, {LAGS + 1})) AS stride) k ON a.n >= 20 AND k.stride <= a.n // 3 JOIN r b ON b.label = a.label AND b.rn = a.rn + k.stride GROUP BY ALL"""
)
def lagged_self_similarity(spark, sf_dir):
    """Strides 2 to 40 or a third of the label's rows; labels of under 20 rows have none."""
    rows = table(spark, sf_dir, "embeddings")
    bound = rows.groupBy(F.col("label").alias("_of")).agg(F.when(F.count("*") >= 20, F.floor(F.count("*") / 3)).alias("_most"))
    got = vectors.self_similarity(rows, "label", "vec_id", "embedding", range(2, LAGS + 1))
    return got.join(bound, F.col("label").eqNullSafe(F.col("_of"))).filter(F.col("stride") <= F.col("_most")).select("label", "stride", rounded("similarity", 5))


# ---- spans


@query(
    """WITH w AS (SELECT item_id, list_filter(string_split_regex(trim(text, ' '), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
    s AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), n AS (SELECT item_id, w, i, unnest(range(2, 9)) AS k FROM s)
    SELECT item_id, (i - 1)::INTEGER AS start, k::INTEGER AS size, array_to_string(w[i:i + k - 1], ' ') AS span FROM n WHERE i + k - 1 <= len(w)"""
)
def ngram_spans(spark, sf_dir):
    return spans.ngrams(table(spark, sf_dir, "benchmark"), "item_id", "text")


def scored_spans(spark, sf_dir):
    every = spans.ngrams(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return every.select("item_id", "start", "size", (F.pmod(F.crc32(F.col("span").cast("binary")), F.lit(1000)) / 1000).alias("score"))


@query()
def span_selection(spark, sf_dir):
    return spans.suppress_by(scored_spans(spark, sf_dir), "item_id")


@query()
def span_overlap_bonus(spark, sf_dir):
    return spans.overlap_bonus(scored_spans(spark, sf_dir), "item_id").select("item_id", "start", "size", rounded("bonus"))


@query("SELECT gram, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(text) - 1, 2)), lambda i: substr(lower(text), i, 3))) AS gram FROM documents) GROUP BY gram HAVING count(*) > 100")
def gram_index(spark, sf_dir):
    return store.gram_table(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("gram").agg(F.count("*").alias("docs")).filter("docs > 100")


# ---- windows of time (beyond the records' own needs)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    got = tasks.tumbling(table(spark, sf_dir, "events"), "ts", "1 day")
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded("total", 4))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark, sf_dir):
    got = tasks.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return got.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
