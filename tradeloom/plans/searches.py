"""Queries over search, server-side answers and their metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, search
from ..streaming import tasks
from .catalogue import query, table
from .catalogue import _query_vector as query_vector


def _sales(spark, sf_dir):
    """Orders as the server's rows: tenant, type, status code, condition flags, stamps."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 2).cast("string").alias("to"), F.when(k % 3 == 0, "order").otherwise("goods").alias("type"), (k % 4).alias("status"), F.col("o_totalprice").alias("sale_price"), (k % 5).alias("used"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at")
    )


SALES = """SELECT o_orderkey AS id, (o_orderkey % 2)::VARCHAR AS "to", CASE WHEN o_orderkey % 3 = 0 THEN 'order' ELSE 'goods' END AS type, o_orderkey % 4 AS status, o_totalprice AS sale_price, o_orderkey % 5 AS used, epoch_ms(o_orderdate) AS created_at FROM orders"""


@query(f"""SELECT id, sale_price FROM ({SALES}) WHERE "to" = '1' AND type = 'order' AND status = 3 AND sale_price >= 2000 AND sale_price <= 9000000 ORDER BY sale_price, id LIMIT 300""")
def edge_rows_by_context(spark, sf_dir):
    """The server's answer: tenant, type, status, range, the least first."""
    context = {"type": "order", "status": 3, "substantial": "sale_price", "find": "few", "condition": {"sale_price": {"gte": 2000, "lte": 9000000}, "colour": {"eq": 1}, "used_min": {"eq": 1}}}
    return search.edge_rows(_sales(spark, sf_dir), context, "1").select("id", "sale_price")


@query(f"""SELECT id, created_at FROM ({SALES}) WHERE "to" = '0' AND used > 0 AND created_at >= epoch_ms(TIMESTAMP '1996-01-01') ORDER BY created_at DESC, id LIMIT 300""")
def edge_rows_by_condition_word(spark, sf_dir):
    """A condition word as status asks for its flag, and a date for its milliseconds."""
    context = {"status": "used", "condition": {"date": {"gte": "1996-01-01"}}}
    return search.edge_rows(_sales(spark, sf_dir), context, "0").select("id", "created_at")


@query(f"SELECT count(*) FILTER (WHERE sale_price > 1000 AND type IN ('order', 'x')) AS read, count(*) FILTER (WHERE type = 'goods') AS fell_back FROM ({SALES})")
def free_predicate_and_fallback(spark, sf_dir):
    """A predicate written in SQL, and the fallback of one that names no column of the table."""
    rows = _sales(spark, sf_dir)
    read = search.where(rows, "sale_price > 1000 AND type IN ('order', 'x')").agg(F.count("*").alias("read"))
    back = search.where(rows, "json_data LIKE '%1%'", F.col("type") == "goods").agg(F.count("*").alias("fell_back"))
    return read.crossJoin(back)  # one row each


@query("SELECT o_orderkey AS id FROM orders WHERE contains(replace(o_orderpriority, '-', ''), '2HIGH')")
def tracking_number_like(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data"))
    return rows.filter(search.tracking_like("2-HI_GH")).select("id")


@query("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, (contains(t, 'license')::INTEGER + contains(t, 'the')::INTEGER) AS n_words FROM d WHERE contains(t, 'license') OR contains(t, 'the')""")
def full_text_words(spark, sf_dir):
    """Documents with any word of a question, by the gram index and the words themselves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = search.gram_index(docs, "doc_id", ["text"], (3,))
    return search.text(index, docs, "doc_id", ["text"], "License the").select("doc_id", "n_words")


@query("""SELECT gram, count(*) AS docs FROM (SELECT DISTINCT p_partkey, unnest(list_concat(list_transform(range(1, greatest(length(t), 2)), lambda i: substr(t, i, 2)), list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3)))) AS gram
    FROM (SELECT p_partkey, unnest([lower(p_name), lower(p_type)]) AS t FROM part)) WHERE gram <> '' GROUP BY gram""")
def gram_index_of_two_sizes(spark, sf_dir):
    """The n-gram index of sizes 2 and 3 over several columns."""
    index = search.gram_index(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_type"])
    return index.groupBy("gram").agg(F.count("*").alias("docs"))


@query(
    """WITH e AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id % 2 = 1 AND label = 3)
    SELECT id, round(s, 6) AS score FROM e ORDER BY s DESC, id LIMIT 100"""
)
def vector_with_metadata(spark, sf_dir):
    """The nearest rows of a tenant with equal metadata."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2).cast("string").alias("to"), F.lit("goods").alias("type"), "label", F.col("embedding").alias("vector"))
    got = search.by_vector(rows, query_vector(spark, sf_dir), "1", {"type": "goods", "condition": {"label": {"eq": 3}, "price": {"gte": 3}}})
    return got.select("id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS metadata, len(embedding)::INTEGER AS size FROM embeddings")
def vectors_upserted(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    got = search.upsert_vectors(e.withColumn("metadata", F.lit("old")), e.filter("id % 3 = 0").withColumn("metadata", F.lit("new")))
    return got.select("id", "metadata", F.size("values").alias("size"))


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 5")
def documents_entry(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("created_at"))
    return search.search_documents(rows, F.col("lang") == "en", 50, 5).select("id")


def _context_sql(each):
    one = """SELECT id, context FROM (SELECT id, {n} AS context, sum(score) AS score FROM (
      SELECT * FROM (SELECT id, 3.0 AS score FROM d WHERE {w} ORDER BY id LIMIT {k}) UNION ALL SELECT * FROM (SELECT id, 2.0 FROM d WHERE {w} AND contains(lower(text), 'the') ORDER BY id LIMIT {k})
      UNION ALL SELECT id, 1.0 - (row_number() OVER (ORDER BY s DESC, id) - 1) * 0.001 FROM (SELECT * FROM d WHERE {w} ORDER BY s DESC, id LIMIT {k})) GROUP BY id ORDER BY score DESC, id LIMIT {k})"""
    parts = " UNION ALL ".join(one.format(n=n, w=w, k=each) for n, w in enumerate(("type = 'en' AND amount >= 100", "type = 'fr'")))
    return f"""WITH d AS (SELECT doc_id AS id, text, lang AS type, n_chars::DOUBLE AS amount, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM documents JOIN embeddings ON vec_id = doc_id)
    SELECT id, min(context)::INTEGER AS context FROM ({parts}) GROUP BY id"""


def _contexts(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = d.join(e, d.doc_id == e.vec_id).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("type"), F.col("n_chars").cast("double").alias("amount"), F.col("embedding").alias("vector"))
    return [{"type": "en", "condition": {"price": {"operator": "gte", "value": 100}}}, {"type": "fr"}], rows, "the", query_vector(spark, sf_dir)


@query(_context_sql(5))
def ai_search_entry(spark, sf_dir):
    """The best five of each context of a question."""
    return search.ai_search(*_contexts(spark, sf_dir)).select("id", "context")


@query(_context_sql(3))
def research_entry(spark, sf_dir):
    return search.research(*_contexts(spark, sf_dir)).select("id", "context")


@query(
    """WITH d AS (SELECT event_type, count(*) AS draft, 3 AS n FROM events GROUP BY 1), c AS (SELECT event_type, -2 * count(*) AS draft, 1 AS n FROM events GROUP BY 1)
    SELECT event_type, sum(draft)::BIGINT AS draft, sum(n)::BIGINT AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM c) GROUP BY 1"""
)
def signed_site_counts(spark, sf_dir):
    """Draft and record counts after signed changes, below zero too."""
    e = table(spark, sf_dir, "events").groupBy("event_type")
    counts = e.agg(F.count("*").alias("draft"), F.lit(3).cast("long").alias("n"))
    return search.signed_counts(counts, e.agg((-2 * F.count("*")).alias("draft"), F.lit(1).cast("long").alias("n")), ["event_type"])


@query(
    """WITH x AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME property VALUE x)
    SELECT l_returnflag, property, least(min(x), 0.5) AS min_value, greatest(max(x), 0.5) AS max_value FROM x GROUP BY ALL"""
)
def site_bounds_widened(spark, sf_dir):
    """Bounds of properties after new rows; zero is a value here."""
    rows = table(spark, sf_dir, "lineitem")
    bounds = metrics.ranges(rows, ["l_returnflag"], ["l_quantity", "l_tax"]).withColumns({"min_value": F.lit(0.5), "max_value": F.lit(0.5)})
    return search.widened(bounds, rows, ["l_returnflag"], ["l_quantity", "l_tax"])


@query(
    r"""SELECT lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, count(DISTINCT lower(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''))) AS urls FROM pages GROUP BY 1"""
)
def distinct_links_by_host(spark, sf_dir):
    return search.distinct_urls(table(spark, sf_dir, "pages"), "url")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def result_count(spark, sf_dir):
    return search.shown_count(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O")


@query(
    """SELECT o_custkey, o_orderstatus, o_orderkey, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
    WHERE place <= CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 1000000 END"""
)
def capped_by_kind(spark, sf_dir):
    """Rows up to the cap of their kind."""
    got = search.capped(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], {"O": 2, "F": 3}, "o_orderstatus")
    return got.select("o_custkey", "o_orderstatus", "o_orderkey", "place")


@query(
    """WITH t AS (SELECT event_id AS id, event_type AS type, epoch_ms(ts) AS created_at FROM events WHERE event_id % 3 = 0), p AS (SELECT * FROM t ORDER BY created_at, id LIMIT 300),
    l AS (SELECT min(created_at * 1000000 + id) AS stop FROM p WHERE type = 'purchase')
    SELECT id FROM p, l WHERE stop IS NULL OR created_at * 1000000 + id < stop"""
)
def cron_batch(spark, sf_dir):
    """The oldest 300 waiting tasks up to the first lock."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "lock").otherwise("task").alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.when(F.col("event_id") % 3 == 0, 10).otherwise(9).alias("status"))
    return tasks.cron_batch(rows).select("id")


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 99 WHEN o_orderkey % 2 = 0 THEN 0 ELSE 7 END::BIGINT AS updated_at, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 0 END AS draft, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS n FROM orders"""
)
def drafts_promoted(spark, sf_dir):
    """Drafts that late details reach are records from then on, and counted so."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(7).cast("long").alias("updated_at"))
    late = o.filter("id % 4 = 0 or id % 4 = 1").select("id")
    return tasks.promoted(o, late, 99).select("id", "updated_at", "draft", "n")
