import duckdb
from pyspark.sql import functions as F

from tradeloom.functions import markup
from tradeloom.functions import scalars as S
from tradeloom.operators import metrics, relay, spans
from tradeloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_all_logs_of_a_hot_key(spark):
    df = spark.range(1000).select(F.col("id"), F.lit("u").alias("k"))
    got = metrics.group_all_logs(df, ["k"], "id", F.col("id"), 300).orderBy("part").collect()
    assert [(r["part"], r["n"], len(r["logs"])) for r in got] == [(0, 1000, 300), (1, 1000, 300), (2, 1000, 300), (3, 1000, 100)]
    assert [x for r in got for x in r["logs"]] == list(range(1000))


def test_every_document_is_related(spark):
    pairs = spark.createDataFrame([(i, "hot") for i in range(40)] + [(50, "a"), (51, "a"), (52, None)], "id long, ref string")
    got = relay.related_to_all(pairs).collect()
    assert {r["me"] for r in got} == {*range(40), 50, 51}
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["me"] == 3] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_strides_of_the_operator(spark):
    got = catalogue.lagged_self_similarity(spark, SF)
    n = {r["label"]: r["count"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").count().collect()}
    assert {(r["label"], r["stride"]) for r in got.collect()} == {(k, s) for k in n if n[k] >= 20 for s in range(2, min(n[k] // 3, 40) + 1)}


def test_spans_of_two_to_eight_words(spark):
    assert {r["size"] for r in catalogue.span_overlap_bonus(spark, SF).select("size").distinct().collect()} == set(range(2, 9))
    rows = [(1, s, n, (s * 7 + n * 3) % 10 / 10) for s in range(12) for n in range(2, 9)]
    df = spark.createDataFrame(rows, "item_id long, start int, size int, score double")
    want = {(s, n): max([x for _, a, m, x in rows if s < a < s + n < a + m], default=0.0) * 0.1 for _, s, n, _ in rows}
    assert {(r["start"], r["size"]): r["bonus"] for r in spans.overlap_bonus(df, "item_id").collect()} == want


def as_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)), con.sql(catalogue.SQL[name]).df()
    return sorted(map(tuple, got.collect())), sorted(map(tuple, want[got.columns].astype(object).to_numpy()))


def test_links_numbered_as_pages_are_not_those_pages(spark, tmp_path):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.b/p"), F.col("id") % 3, F.lit("/x")).alias("url"))
    got, want = as_sql(spark, tmp_path, "cached_pages", pages=pages)
    assert got == want and len(got) == 6000


def test_goods_of_one_index_keep_their_events(spark, tmp_path):
    a, b = 49577, 100372  # with equal indexes
    both = spark.createDataFrame([(a,), (b,)], "no long").select(S.entity_index(F.lit("goods"), F.lit("team"), F.col("no").cast("string")))
    assert both.distinct().count() == 1
    parts = spark.createDataFrame([(a,), (b,), (7,)], "p_partkey long")
    lines = spark.createDataFrame([(1, a, 1), (1, b, 2), (2, b, 1), (2, 7, 1), (2, 7, 3)], "l_orderkey long, l_partkey long, l_linenumber int")
    got, want = as_sql(spark, tmp_path, "order_shipments", part=parts, lineitem=lines)
    assert got == want and len(got) == 4


def test_indents_of_many_documents_stream(spark):
    rows = [(d if d else None, 2 * i, (d * 7 + i * i) % 5) for d in range(40) for i in range(d % 9)] + [(99, i, i // 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc long, pos long, indent int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        tree = markup.indent_tree(df, "doc")
        got = {(r["doc"], r["pos"]): (r["parent"], r["stop"]) for r in tree.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for d, p, x in rows:
        own = [(q, y) for e, q, y in rows if e == d]
        end = min([q for q, y in own if q > p and y <= x], default=None)
        want[d, p] = max([q for q, y in own if q < p and y < x], default=-1), max(q for q, _ in own if end is None or q < end)
    assert got == want
    assert "FlatMapGroups" not in tree._jdf.queryExecution().toString()  # a call for each document takes hours


def test_words_are_found_without_lambdas(spark, tmp_path):
    texts = ["The LICENSE", "license", "lic ens the", "t h e", "", None, "licens ense"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = as_sql(spark, tmp_path, "full_text_words", documents=docs)
    assert got == want == [(0, 2), (1, 1), (2, 1)]
    plan = catalogue.QUERIES["full_text_words"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # in a new session Spark moved the condition to where the texts are not


def test_grams_of_odd_texts(spark):
    texts = ["", None, "a", "ab", "abc", "A\U0001f600b\u00e9\n\r x", "\U0001f600\U0001f600", "\U0001f600\U0001f600\U0001f600a"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i")
    for n in (1, 2, 3):
        got = [r[0] for r in df.select(S.letter_grams(F.col("x"), n)).collect()]
        low = [None if x is None else x.lower() for x in texts]
        assert got == [[x] if x is None or len(x) < n else [x[i : i + n] for i in range(len(x) - n + 1)] for x in low]
