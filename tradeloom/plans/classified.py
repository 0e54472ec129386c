"""Queries over score matrices of pages, with their SQL: pages are runs of 50 vectors, kinds and fields are the labels' first vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify, metrics
from .catalogue import query, table

SIMS = """SELECT vec_id AS line, vec_id // 50 AS doc, category, round(list_cosine_similarity(embedding::DOUBLE[], b), 6) AS sim
  FROM embeddings, (SELECT label AS category, arg_min(embedding::DOUBLE[], vec_id) AS b FROM embeddings GROUP BY 1)"""
KINDS = "(SELECT count(DISTINCT label) FROM embeddings)"
# own: the similarity with a field; prej: that with the next field
CELLS = f"""SELECT a.doc, a.line, a.category AS field, a.sim AS own, b.sim AS prej FROM ({SIMS}) a JOIN ({SIMS}) b ON a.line = b.line AND b.category = (a.category + 1) % {KINDS}"""


def sims(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    bank = e.groupBy(F.col("label").alias("category")).agg(F.min_by("embedding", "vec_id").alias("vector")).select("category", F.lit("").alias("phrase"), F.lit(1.0).alias("weight"), "vector")
    lines = e.select(F.col("vec_id").alias("line"), F.floor(F.col("vec_id") / 50).alias("doc"), "embedding")
    return classify.similarities(lines, "embedding", bank).select("line", "doc", "category", F.round("sim", 6).alias("sim"))


def cells(spark, sf_dir):
    a = sims(spark, sf_dir)
    n = a.agg(F.count_distinct("category").alias("_k"))
    b = a.select("line", F.col("category").alias("_c"), F.col("sim").alias("prej"))
    a = a.crossJoin(F.broadcast(n))  # one row
    return a.join(b.withColumnRenamed("line", "_l"), (F.col("line") == F.col("_l")) & (F.col("_c") == (F.col("category") + 1) % F.col("_k"))).select("doc", "line", F.col("category").alias("field"), F.col("sim").alias("own"), "prej")


def rounded(name, digits=4):
    return F.round(name, digits).alias(name)


@query(f"SELECT line, field, round(greatest(0, own - prej * CASE WHEN line % 2 = 0 THEN 0.3 ELSE 0.7 END - own * CASE WHEN line % 2 = 0 THEN 0.05 ELSE 0.10 END), 9) AS score FROM ({CELLS})")
def span_scores(spark, sf_dir):
    c = cells(spark, sf_dir)
    words = F.when(F.col("line") % 2 == 0, 2).otherwise(3)
    return c.select("line", "field", F.round(classify.span_score(F.col("own"), F.col("prej"), F.col("own"), words), 9).alias("score"))


@query(
    f"""WITH c AS (SELECT doc % 10 AS field, line AS phrase, category AS bank, sim FROM ({SIMS})),
    g AS (SELECT field, phrase, max(sim) FILTER (WHERE bank = field) AS own, coalesce(max(sim) FILTER (WHERE bank <> field), 0) AS rival FROM c GROUP BY ALL)
    SELECT field, phrase FROM g WHERE own IS NOT NULL AND greatest(own, 0) >= greatest(rival, 0)"""
)
def self_poisoned_prejudices(spark, sf_dir):
    c = sims(spark, sf_dir).select((F.col("doc") % 10).alias("field"), F.col("line").alias("phrase"), F.col("category").alias("bank"), "sim")
    return classify.poisoned(c)


@query(
    """WITH d AS (SELECT doc_id % 20 AS field, doc_id, unnest(string_split_regex(text, '[,\n/|]')) AS raw, generate_subscripts(string_split_regex(text, '[,\n/|]'), 1) AS pos FROM documents),
    p AS (SELECT field, trim(raw, ' ') AS phrase, doc_id, pos FROM d),
    q AS (SELECT field, phrase, min(doc_id * 1000000 + pos) AS first FROM p WHERE length(phrase) BETWEEN 1 AND 24 AND length(regexp_replace(phrase, '[^0-9]', '', 'g')) * 4 < length(phrase) GROUP BY ALL),
    r AS (SELECT field, phrase, row_number() OVER (PARTITION BY field ORDER BY first) AS place FROM q)
    SELECT field, phrase, place::INTEGER AS place FROM r WHERE place <= 48"""
)
def label_phrases(spark, sf_dir):
    """The phrase bank of a dictionary made of all documents: a field's texts in the order of doc_id."""
    d = table(spark, sf_dir, "documents").withColumn("field", F.col("doc_id") % 20)
    joined = d.groupBy("field").agg(F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).getField("text"), ",").alias("text"))
    bank = classify.phrase_bank(joined.select(F.lit("en").alias("lang"), F.lit("order").alias("page_type"), "field", F.lit("semantic").alias("kind"), "text"))
    return bank.select("field", "phrase", "place")


def _matrix_of_pairs(spark, sf_dir):
    c = cells(spark, sf_dir).groupBy("doc", "field", (F.col("line") % 7).alias("phrase")).agg(F.round(F.max("own"), 6).alias("own"), F.round(F.avg("prej"), 6).alias("prej"), F.round(F.avg("own"), 6).alias("section"))
    return c.withColumn("section", F.when(F.col("phrase") == 0, -1.0).otherwise(F.col("section"))).withColumn("fits", (F.col("field") + F.col("phrase")) % 3 != 0)


PAIRS = f"""SELECT doc, field, line % 7 AS phrase, round(max(own), 6) AS own, round(avg(prej), 6) AS prej, CASE WHEN line % 7 = 0 THEN -1 ELSE round(avg(own), 6) END AS section, (field + line % 7) % 3 <> 0 AS fits FROM ({CELLS}) GROUP BY doc, field, line % 7"""


@query(
    f"""WITH k AS (SELECT * FROM ({PAIRS}) WHERE own >= 0.5 AND prej < own AND fits), m AS (SELECT *, avg(CASE WHEN section >= 0 THEN section END) OVER w AS mean, count(CASE WHEN section >= 0 THEN 1 END) OVER w AS n FROM k WINDOW w AS (PARTITION BY doc, phrase))
    SELECT doc, field, phrase, round(own + 0.5 * CASE WHEN n > 1 AND section >= 0 THEN section - mean ELSE 0 END, 5) AS score FROM m"""
)
def label_section_pairs(spark, sf_dir):
    return classify.pair_cells(_matrix_of_pairs(spark, sf_dir)).select("doc", "field", "phrase", F.round("score", 5).alias("score"))


@query()
def label_section_fields(spark, sf_dir):
    """The pairs assigned, strongest first (greedy: tested against brute force)."""
    return classify.pair_fields(_matrix_of_pairs(spark, sf_dir)).select("doc", "field", "phrase", rounded("score"))


@query()
def header_to_fields(spark, sf_dir):
    """Headers assigned to fields by margin (greedy: tested against brute force)."""
    c = cells(spark, sf_dir).withColumnRenamed("line", "header").withColumn("own", F.round(F.sqrt(F.abs("own")), 6))
    return classify.header_fields(c).select("doc", "field", "header", rounded("score"))


CANDIDATES = f"SELECT doc, line AS place, 't' || line AS token, '/g/' || line AS href, own, prej, CASE line % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.92 ELSE 0.05 END AS prior FROM ({CELLS}) WHERE field = 0"


@query(
    f"""WITH c AS (SELECT *, (own - prej) + 0.15 * (prior - 1) AS score FROM ({CANDIDATES})), k AS (SELECT * FROM c WHERE own >= 0.3 AND score > 0)
    SELECT doc, token, href, round(score, 5) AS score FROM k QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, place) = 1"""
)
def identifier_of_record(spark, sf_dir):
    c = cells(spark, sf_dir).filter("field = 0")
    prior = F.when(F.col("line") % 3 == 0, 1.0).when(F.col("line") % 3 == 1, 0.92).otherwise(0.05)
    rows = c.select("doc", F.col("line").alias("place"), F.concat(F.lit("t"), "line").alias("token"), F.concat(F.lit("/g/"), "line").alias("href"), "own", "prej", prior.alias("prior"))
    return classify.best_identifier(rows).select("doc", "token", "href", F.round("score", 5).alias("score"))


@query(
    f"""WITH k AS (SELECT doc, line, own - prej AS score, line::VARCHAR AS token FROM ({CELLS}) WHERE field = 0 AND own >= 0.4 AND own - prej > 0.05 AND length(line::VARCHAR) <= 4)
    SELECT doc, token, 'https://shop.a/view/' || token || '?x=1' AS link FROM k QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, line) = 1"""
)
def links_recovered(spark, sf_dir):
    c = cells(spark, sf_dir).filter("field = 0")
    rows = c.select("doc", F.lit("shop.a").alias("site"), F.col("line").alias("place"), F.col("line").cast("string").alias("token"), "own", "prej")
    learned = spark.createDataFrame([("shop.a", 1, 2, True, False)], "site string, least int, most int, any_digits boolean, any_mixed boolean")
    pattern = spark.createDataFrame([("shop.a", "https://shop.a/view/", "?x=1", "shop.a")], "site string, head string, tail string, host string")
    return classify.recovered_links(rows, learned, pattern)


def _assigned(spark, sf_dir):
    c = cells(spark, sf_dir).select("doc", "field", "line", F.col("own").alias("score"))
    w_line = F.max(F.struct("score", (-F.col("field")).alias("f"))).alias("b")
    best = c.groupBy("doc", "field").agg(F.max(F.struct("score", (-F.col("line")).alias("l"))).alias("b")).select("doc", "field", (-F.col("b.l")).alias("line"), F.col("b.score").alias("score"))
    one = best.groupBy("doc", "line").agg(w_line).select("doc", (-F.col("b.f")).alias("field"), "line", F.col("b.score").alias("score"))
    return c, one


@query()
def single_candidate_fields(spark, sf_dir):
    """Fields with one free line above a floor take it (in turn: tested against brute force)."""
    c, one = _assigned(spark, sf_dir)
    return classify.single_candidates(c.filter("score >= 0.6"), one.filter("field % 2 = 0")).select("doc", "field", "line", rounded("score"))


ONE = f"""SELECT doc, field, line, score FROM (SELECT doc, field, line, own AS score FROM ({CELLS}) QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY own DESC, line) = 1) QUALIFY row_number() OVER (PARTITION BY doc, line ORDER BY score DESC, field) = 1"""


@query(
    f"""WITH o AS ({ONE}), c AS ({CELLS}), f AS (SELECT DISTINCT doc, field FROM c), g AS (SELECT doc, field FROM f EXCEPT SELECT doc, field FROM o WHERE field % 2 = 0),
    p AS (SELECT g.doc, g.field, o.line, c.own AS score FROM g JOIN o ON o.doc = g.doc AND o.field % 2 = 0 AND o.field % 3 = g.field % 3 AND o.line % 4 <> 0 JOIN c ON c.doc = g.doc AND c.field = g.field AND c.line = o.line WHERE g.field % 3 <> 2)
    SELECT doc, field, line, round(score, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY p.score DESC, line) = 1"""
)
def format_family_shares(spark, sf_dir):
    """Fields left over take the best line of a field of the same format, if its value fits."""
    c, one = _assigned(spark, sf_dir)
    kind = F.when(F.col("field") % 3 == 0, "Date").when(F.col("field") % 3 == 1, "Numeric").otherwise("Text")
    formats = c.select("field").distinct().withColumn("format", kind)
    value = F.when(F.col("line") % 4 == 0, "none").when(F.col("field") % 3 == 0, "2024-01-02").otherwise("12,345")
    taken = one.filter("field % 2 = 0")
    values = taken.select("doc", "line", value.alias("value"))
    return classify.shared_lines(c, taken, formats, values).select("doc", "field", "line", rounded("score"))


@query(f"SELECT doc, line, field FROM ({CELLS}) WHERE line % 5 NOT IN (0, 1) AND (field % 2 = 0 OR (line % 5 = 3 AND own - prej >= 0.15))")
def detail_matrix_cells(spark, sf_dir):
    k = F.col("line") % 5
    tag = F.when(k == 0, "th").when(k == 1, "tr").when(k == 2, "td").when(k == 3, "option").otherwise("span")
    c = cells(spark, sf_dir).withColumns({"tag": tag, "format": F.when(F.col("field") % 2 == 0, "Text").otherwise("Enum"), "selected": k == 3})
    return classify.detail_cells(c).select("doc", "line", "field")


@query(
    """SELECT o_orderkey AS doc, o_orderkey % 3 AS field, CASE o_orderkey % 3 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '1,500' ELSE 'blue' END AS value FROM orders WHERE o_orderkey % 5 <> 4"""
)
def answers_gated(spark, sf_dir):
    """The first answer that is a value of the field's format, within three misses."""
    k, j = F.col("o_orderkey") % 3, F.col("o_orderkey") % 5
    right = F.when(k == 0, "td[a] | 2024-03-05").when(k == 1, "1,500").otherwise("span | blue")
    wrong = F.array(F.lit("tr"), F.lit("N/A"), F.when(k == 0, "soon").when(k == 1, "none").otherwise(""), F.lit("td"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), k.alias("field"), F.when(k == 0, "Date").when(k == 1, "Numeric").otherwise("Text").alias("format"), F.posexplode(F.concat(F.slice(wrong, F.lit(1), j.cast("int")), F.array(right))).alias("attempt", "value"))
    return classify.passed_values(rows)


@query(
    f"""WITH o AS (SELECT doc, line % 3 AS grp, own AS status, prej AS rival FROM ({CELLS}) WHERE field = 0), g AS (SELECT doc, grp, avg(status) - avg(rival) + 0.5 * (max(abs(grp)) * 0.01 - 0.01) AS contrast FROM o GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS rn, lead(contrast) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY doc ORDER BY contrast DESC, grp))
    SELECT doc, grp, round(contrast, 5) AS contrast FROM r WHERE rn = 1 AND contrast > 0.02 AND coalesce(contrast - nxt, contrast) > 0.02"""
)
def status_select(spark, sf_dir):
    c = cells(spark, sf_dir).filter("field = 0").select("doc", (F.col("line") % 3).alias("grp"), F.col("own").alias("status"), F.col("prej").alias("rival"))
    got = classify.chosen_select(c.withColumns({"role_status": F.col("grp") * 0.01, "role_rival": F.lit(0.01)}))
    return got.select("doc", "grp", F.round("contrast", 5).alias("contrast"))


@query(f"SELECT line, (prej > 0.5) OR (own > 0.38 AND NOT ((prej > 0.30 AND prej >= own * 0.85) OR (prej * 1.1 > own AND prej * 1.1 > 0.40))) AS noise FROM ({CELLS}) WHERE field = 1")
def navigation_noise(spark, sf_dir):
    c = cells(spark, sf_dir).filter("field = 1")
    return c.select("line", classify.is_noise(F.col("own"), F.col("prej") * 1.1, F.col("prej"), F.col("prej")).alias("noise"))


@query(f"SELECT line, round((max(sim) - avg(sim)) - greatest(0.4 - greatest(max(sim), 0) * 0.85, 0) * 0.5, 5) + 0 AS score FROM ({SIMS}) GROUP BY line HAVING max(sim) >= 0")
def title_candidate_scores(spark, sf_dir):
    listed = sims(spark, sf_dir).groupBy("line").agg(F.collect_list("sim").alias("s"))
    return listed.filter(F.array_max("s") >= 0).select("line", (F.round(classify.title_score(F.col("s"), F.lit(0.4)), 5) + F.lit(0.0)).alias("score"))


GRID = "SELECT l_partkey % 50 AS doc, l_orderkey % 6 AS \"row\", l_linenumber % 3 AS col, CASE WHEN l_linenumber % 3 = 0 THEN 'edit' ELSE l_returnflag || ' returned item' END AS text, l_linestatus = 'O' AND l_linenumber % 3 = 1 AS linked FROM lineitem"


@query(
    f"""WITH c AS ({GRID}), r AS (SELECT doc, count(DISTINCT "row") AS n FROM c GROUP BY 1 HAVING count(DISTINCT "row") >= 3), h AS (SELECT doc, text, max(k) AS hits FROM (SELECT doc, text, col, count(*) AS k FROM c GROUP BY ALL) GROUP BY ALL),
    o AS (SELECT doc, text, count(DISTINCT "row") AS own, bool_or(linked) AS linked FROM c GROUP BY ALL)
    SELECT doc, text, round(own / n, 5) AS coverage, hits, CASE WHEN linked OR length(text) >= 10 THEN 'keep' ELSE 'drop' END AS state FROM o JOIN h USING (doc, text) JOIN r USING (doc) WHERE hits >= ceil(n * 0.7) AND own / n >= 0.7"""
)
def table_column_repeats(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, "edit").otherwise(F.concat("l_returnflag", F.lit(" returned item")))
    c = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("doc"), (F.col("l_orderkey") % 6).alias("row"), k.alias("col"), text.alias("text"), ((F.col("l_linestatus") == "O") & (k == 1)).alias("linked"))
    return classify.column_repeats(c).withColumn("coverage", F.round("coverage", 5))


TITLES = f"SELECT doc, category, max(sim) AS pool, round(greatest(avg(sim), 0), 6) AS only_, round(max(sim) * 0.9, 6) AS win FROM ({SIMS}) GROUP BY ALL"


@query(
    f"""WITH t0 AS ({TITLES}), t AS (SELECT *, pool - avg(pool) OVER d AS a, only_ - avg(only_) OVER d AS o, win - avg(win) OVER d AS w, max(pool) OVER d AS pm FROM t0 WINDOW d AS (PARTITION BY doc)),
    tr AS (SELECT doc, least(least(greatest((max(pm) - 0.1) / 0.15, 0), 1), least(greatest((greatest(max(w) FILTER (WHERE rn = 1) - coalesce(max(w) FILTER (WHERE rn = 2), 0), 0) - 0.02) / 0.08, 0), 1)) AS trust, max(a + o) AS mx
      FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY w DESC, category) AS rn FROM t) GROUP BY doc),
    p AS (SELECT t.*, trust, exp((a + o - mx) / 0.05) / sum(exp((a + o - mx) / 0.05)) OVER (PARTITION BY t.doc) AS pr FROM t JOIN tr USING (doc)),
    l AS (SELECT *, line % 4 = 0 AS cell, row_number() OVER (PARTITION BY line ORDER BY sim DESC, category) AS rn, coalesce(lead(sim) OVER (PARTITION BY line ORDER BY sim DESC, category), 0) AS nxt, avg(sim) OVER (PARTITION BY line) AS mean FROM ({SIMS})),
    v AS (SELECT doc, category, sum((sim - mean) * CASE WHEN cell THEN 1.5 ELSE 1 END) AS total, count(*) AS n FROM l WHERE rn = 1 AND sim >= CASE WHEN cell THEN 0.30 ELSE 0.38 END AND sim - nxt >= CASE WHEN cell THEN 0.015 ELSE 0.03 END AND sim > mean GROUP BY ALL),
    b AS (SELECT doc, category, avg(sim) AS tm FROM (SELECT *, row_number() OVER (PARTITION BY doc, category ORDER BY sim DESC, line) AS rk FROM ({SIMS})) WHERE rk <= 10 GROUP BY ALL),
    s AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(total, 0) AS total, tm - avg(tm) OVER (PARTITION BY p.doc) AS bc FROM p LEFT JOIN v USING (doc, category) LEFT JOIN b USING (doc, category))
    SELECT doc, category, round((((greatest(a, 0) * 15 + greatest(o, 0) * 12) * trust) + CASE WHEN n > 0 THEN total / n ELSE 0 END * 10 * CASE WHEN n > 0 THEN least(ln(n + 1) / 4, 1.2) ELSE 0 END * CASE WHEN n < 3 THEN n / 3 ELSE 1 END + greatest(bc, 0) * 12)
      * (1 + (0.5 + 3 * pr - 1) * trust) * (1 + (least(1 + 6 * greatest(w, 0), 2.5) - 1) * trust), 3) AS score FROM s"""
)
def page_type_scores(spark, sf_dir):
    """How well each kind fits each page, from title and lines."""
    s = sims(spark, sf_dir)
    t = s.groupBy("doc", "category").agg(F.max("sim").alias("pool"), F.round(F.greatest(F.avg("sim"), F.lit(0.0)), 6).alias("only"), F.round(F.max("sim") * 0.9, 6).alias("window")).withColumn("chrome", F.lit(0.1))
    got = classify.page_scores(t, s.withColumn("cell", F.col("line") % 4 == 0))
    return got.select("doc", "category", F.round("score", 3).alias("score"))


@query(
    """WITH e AS (SELECT vec_id // 50 AS doc, vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT unnest(range(2, 17)) AS stride),
    s AS (SELECT a.doc, stride, avg(list_cosine_similarity(a.v, b.v)) AS m FROM e a JOIN k ON true JOIN e b ON b.doc = a.doc AND b.vec_id = a.vec_id + stride GROUP BY ALL)
    SELECT doc, arg_max(stride, m) FILTER (WHERE stride >= 5)::INTEGER AS stride, round(greatest(max(m) FILTER (WHERE stride >= 5) - avg(m), 0), 5) AS contrast FROM s GROUP BY doc"""
)
def page_periodicity(spark, sf_dir):
    """The stride at which a page's lines repeat best, over the mean of all strides."""
    from ..operators import vectors

    rows = table(spark, sf_dir, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 50))
    got = vectors.self_similarity(rows, "doc", "vec_id", "embedding", range(2, 17))
    return classify.periodicity(got).select("doc", "stride", F.round("contrast", 5).alias("contrast"))


ROWS = "SELECT vec_id // 50 AS doc, (vec_id % 50) // 10 AS tbl, vec_id % 10 AS pos, CASE WHEN (vec_id % 50) // 10 = 0 THEN 2 ELSE 4 + vec_id % 2 END AS cells, embedding::DOUBLE[] AS v FROM embeddings"


@query(f"SELECT doc, tbl, arg_max(cells, n * 100 - cells)::BIGINT AS cells FROM (SELECT doc, tbl, cells, count(*) AS n FROM ({ROWS}) GROUP BY ALL) GROUP BY ALL")
def modal_cell_counts(spark, sf_dir):
    return classify.modal_cells(_rows(spark, sf_dir))


def _rows(spark, sf_dir):
    v = F.col("vec_id")
    tbl = F.floor((v % 50) / 10)
    return table(spark, sf_dir, "embeddings").select(F.floor(v / 50).alias("doc"), tbl.alias("tbl"), (v % 10).alias("pos"), F.when(tbl == 0, F.lit(2).cast("long")).otherwise(4 + v % 2).alias("cells"), F.col("embedding").alias("vector"))


@query(
    f"""WITH r AS ({ROWS}), z AS (SELECT doc, tbl, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 2), u AS (SELECT a.doc, a.tbl, stride, avg(list_cosine_similarity(a.v, b.v)) AS m FROM r a JOIN (SELECT unnest([1, 2, 3]) AS stride) k ON a.tbl > 0 JOIN r b ON b.doc = a.doc AND b.tbl = a.tbl AND b.pos = a.pos + stride GROUP BY ALL),
    best AS (SELECT u.*, n FROM u JOIN z USING (doc, tbl) WHERE n >= 3 AND n - stride >= 2 AND m > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY m DESC, tbl, stride) = 1),
    x AS (SELECT a.doc, avg(list_cosine_similarity(a.v, b.v)) AS base FROM r a JOIN r b ON a.doc = b.doc AND a.tbl < b.tbl AND a.pos < 6 AND b.pos < 6 GROUP BY 1)
    SELECT doc, tbl, stride::INTEGER AS stride, round(m, 5) AS uniformity, round(base, 5) AS baseline, round(greatest(m - base, 0) * least(ln(1 + greatest(n - 2, 0)) / 2, 1.2), 5) AS score FROM best JOIN x USING (doc)"""
)
def row_uniformity(spark, sf_dir):
    """How alike the rows of a page's best list are, over the page's tables."""
    got = classify.row_repetition(_rows(spark, sf_dir))
    return got.select("doc", "tbl", "stride", F.round("uniformity", 5).alias("uniformity"), F.round("baseline", 5).alias("baseline"), F.round("score", 5).alias("score"))


@query(
    f"""WITH c AS (SELECT * FROM ({CELLS}) WHERE field = 0), s AS (SELECT line, CASE WHEN line % 3 = 0 THEN 0 ELSE own END AS ls, abs(prej) AS fs, abs(own) AS hl, abs(prej) * 1.1 AS hf FROM c),
    t AS (SELECT *, CASE WHEN (ls > 0.0001) <> (fs > 0.0001) THEN 0.5 ELSE 1 END AS damp FROM s),
    u AS (SELECT *, ls * damp + greatest(hl - hf, 0) * 2 + 0.07 AS as_list, fs * damp + greatest(hf - hl, 0) * 2 AS as_form FROM t)
    SELECT line, CASE WHEN abs(as_form - as_list) < 0.02 THEN greatest(fs - 0.05, 0) + greatest(hf - hl, 0) * 2 > greatest(ls - 0.05, 0) + greatest(hl - hf, 0) * 2 + 0.07 ELSE as_form > as_list END AS detail FROM u"""
)
def list_or_detail(spark, sf_dir):
    c = cells(spark, sf_dir).filter("field = 0")
    own = F.when(F.col("line") % 3 == 0, 0.0).otherwise(F.col("own"))
    form, head = F.abs("prej"), F.abs("own")
    return c.select("line", classify.is_detail(own, form, head, form * 1.1, F.lit(0.02), F.lit(0.01), own, form, F.lit(0.05)).alias("detail"))


@query("SELECT l_orderkey AS doc, arg_min(sel, -n * 1000 + ascii(sel)) AS selector, max(n) AS n FROM (SELECT l_orderkey, l_returnflag AS sel, max(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def best_row_selector(spark, sf_dir):
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("selector"), F.col("l_linenumber").cast("long").alias("n"))
    return classify.best_selector(pieces)


@query(
    """WITH RECURSIVE l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, (l_partkey % 3 + 1) AS span FROM lineitem),
    r AS (SELECT doc, pos, 0 AS grp, span - 1 AS rest FROM l WHERE pos = 1 UNION ALL SELECT l.doc, l.pos, CASE WHEN rest <= 0 THEN grp + 1 ELSE grp END, CASE WHEN rest <= 0 THEN span - 1 ELSE rest - 1 END FROM r JOIN l ON l.doc = r.doc AND l.pos = r.pos + 1)
    SELECT doc, pos::INTEGER AS pos, grp::INTEGER AS grp FROM r"""
)
def rowspan_groups(spark, sf_dir):
    """Rows merged into records by rowspan."""
    return classify.span_groups(_numbered(spark, sf_dir).withColumn("span", F.col("l_partkey") % 3 + 1))


def _numbered(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("pos"), "l_partkey")


@query(
    """WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)
    SELECT doc, pos::INTEGER AS pos, ((pos - 1) // (1 + doc % 3))::INTEGER AS grp FROM l"""
)
def header_height_groups(spark, sf_dir):
    """Rows in groups as high as the header."""
    rows = _numbered(spark, sf_dir)
    return classify.header_groups(rows.select("doc", "pos"), rows.select("doc").distinct().withColumn("height", (1 + F.col("doc") % 3).cast("int")))


@query(
    """WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS col, l_returnflag AS top, l_linestatus AS low FROM lineitem),
    h AS (SELECT doc, col, min(top) OVER (PARTITION BY doc) || ' > ' || low AS header FROM l)
    SELECT doc, col::INTEGER AS at, header FROM h"""
)
def header_text_per_column(spark, sf_dir):
    """Header rows joined over columns: a first row that spans the table, and a second of one cell each."""
    rows = _flagged(spark, sf_dir)
    top = rows.groupBy("doc").agg(F.lit(0).alias("row"), F.lit(0).alias("col"), F.count("*").cast("int").alias("colspan"), F.min("top").alias("text"))
    return classify.header_text(rows.select("doc", F.lit(1).alias("row"), "col", F.lit(1).alias("colspan"), F.col("low").alias("text")).unionByName(top))


def _flagged(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).alias("col"), F.col("l_returnflag").alias("top"), F.col("l_linestatus").alias("low"))


@query(
    """WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS col, l_partkey AS value FROM lineitem)
    SELECT doc, (col % 2)::INTEGER AS at, CASE WHEN col % 2 = 0 THEN 'Item' ELSE 'Note' END AS header, value FROM l"""
)
def cells_with_headers(spark, sf_dir):
    """Cells under their headers, of which there are fewer than columns."""
    rows = _numbered(spark, sf_dir)
    c = rows.select("doc", F.lit(0).alias("row"), (F.col("pos") - 1).alias("col"), F.col("l_partkey").alias("value"))
    heads = rows.select("doc").distinct().crossJoin(F.broadcast(spark.createDataFrame([(0, "Item"), (1, "Note")], "at int, header string")))  # two rows
    return classify.headed_cells(c, heads).select("doc", "at", "header", "value")
