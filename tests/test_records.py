import gzip
import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import markup, payloads
from tradeloom.functions import scalars as S
from tradeloom.operators import metrics, predicate, relay, spans, store, vectors
from tradeloom.sources import files
from tradeloom.streaming import tasks


def values(spark, rows, make, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(make(F.col("x")).alias("y")).collect()]


def test_dates(spark):
    given = ["2024-1-5", "12/25/2024", "24.3.7 9:05", "2024-02-31", "1700000000", "1700000000000", "2024-05-06T01:02:03", "x", "99-1-1"]
    want = ["2024-01-05T00:00:00", "2024-12-25T00:00:00", "2024-03-07T09:05:00", "2024-02-31T00:00:00", "2023-11-14T22:13:20", "2023-11-14T22:13:20", "2024-05-06T01:02:03", None, "1999-01-01T00:00:00"]
    assert values(spark, given, S.normalise_date) == want


def test_formats(spark):
    assert values(spark, ["a 2024-01-02 b", "010-1234-5678", "1-2-3", "2024-1/2", None], S.has_date) == [True, False, False, False, None]
    assert values(spark, ["12,345", "1 kg", "12 ea", "2024-01-02", ""], S.is_numeric) == [True, False, False, False, False]
    assert values(spark, ["order_date", "tracking_number", "no", "sale_price", "link", "phone", "memo"], S.field_format) == ["Date", "TrackingCode", "Identifier", "Numeric", "Link", "Phone", "Text"]
    assert values(spark, ["N/A", "yyyy-mm-dd", "x", None, " "], S.is_placeholder) == [True, True, False, True, True]
    assert values(spark, ["상품", "かな", "漢字", "abc", "12"], S.language_block) == ["ko", "ja", "zh", "latin", "unknown"]
    assert values(spark, ["Refund", " hide", "5", None], S.status_code) == [4, 12, 0, 0]


def test_urls(spark):
    rows = ["https://Shop.example.co.kr/goods/view/123?no=77#top", "/a/b?c=d", "//cdn.x.com", "plain"]
    parts = spark.createDataFrame([(r,) for r in rows], "x string").select(*S.url_parts(F.col("x"))).collect()
    assert [tuple(p) for p in parts] == [("shop.example.co.kr", "/goods/view/123", "no=77"), ("", "/a/b", "c=d"), ("cdn.x.com", "", ""), ("", "plain", "")]
    assert values(spark, ["shop.example.co.kr", "a.b.example.com", "localhost"], S.base_domain) == ["example.co.kr", "example.com", "localhost"]
    (got,) = values(spark, rows[:1], S.url_identifiers)
    assert [(g["value"], g["prior"]) for g in got][:2] == [("77", 1.0), ("123", 0.92)]
    df = spark.createDataFrame([("https://a.com/p/9/x?id=9&q=1", "9"), ("https://9.com/p", "9")], "u string, i string")
    assert [tuple(r) for r in df.select(*S.url_pattern(F.col("u"), F.col("i"))).collect()] == [("https://a.com/p/9/x?id=", "&q=1"), (None, None)]
    assert values(spark, ["orderNo2", "goods_id"], S.humanise) == ["order no 2", "goods id"]


def test_conditions(spark):
    df = spark.createDataFrame([("order", 1, 100.0), ("order", 2, 2000.0), ("goods", 1, 5000.0)], "type string, status int, amount double")
    context = {"type": "order", "condition": {"price": {"operator": "gte", "value": "1,500 won"}, "carrier": {"operator": "eq", "value": "1"}, "discount": {"operator": "top", "value": "20"}, "sale_price": {"operator": "lt", "value": "none"}}}
    assert df.filter(predicate.condition(context)).count() == 1
    assert df.filter(predicate.tag_filter("type:GOODS mode:x")).count() == 1
    assert predicate.physical_column("expired_at") == "updated_at" and predicate.physical_column("order_date") == "created_at" and predicate.physical_column("carrier") is None


def test_first_present_and_merge(spark):
    rows = ['{"sale_price": null, "price": 5}', '{"price": "7.5"}', '{"x": 1}', None, "broken"]
    assert values(spark, rows, lambda c: S.first_present(c, ["sale_price", "price"])) == [0.0, 7.5, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([("a", ""), ("a", "b"), ("a", None), ("a", "0")], "a string, b string")
    assert [r[0] for r in df.select(S.merge_value(F.col("a"), F.col("b"))).collect()] == ["a", "b", "a", "a"]


def test_store(spark):
    old = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], "id string, digest string, at int")
    new = spark.createDataFrame([("1", "x", 2), ("2", "z", 2), ("2", "w", 3), ("3", "q", 1)], "id string, digest string, at int")
    got = {tuple(r) for r in store.upsert(old, new, "id", [F.desc("at")], "digest").collect()}
    assert got == {("1", "x", 1), ("2", "w", 3), ("3", "q", 1)}
    assert store.insert_absent(old, new.dropDuplicates(["id"]), "id").count() == 3
    assert store.exists(old, F.col("id") == "1") and not store.exists(old, F.col("id") == "9")


def test_cross_reference(spark):
    keys = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 3), ("c", 4)], "key_value string, id int")
    got = {tuple(r) for r in relay.cross_reference(keys, spark.createDataFrame([(1,)], "id int")).collect()}
    assert got == {(1, 0), (2, 1), (3, 2)}
    assert relay.related_types("order") == ["goods", "tracking", "coupon", "event"]


def test_assignment():
    matrix = [[0.9, 0.8, -1.0], [0.85, 0.1, 0.5], [0.2, 0.7, 0.4]]
    lines = [n for _, n, _ in vectors.exclusive(matrix, 0.0, -1.0)]
    assert len(lines) == len(set(lines)) == 3
    assert vectors.exclusive([[-1.0]], 0.0, 0.0) == []
    assert vectors.exclusive(matrix, 0.3, 0.0, by_score=True)[0][2] == 0.9


def test_ranges(spark):
    df = spark.createDataFrame([("a", 0.0, 3.0), ("a", 2.0, 0.0), ("b", 0.0, 0.0)], "k string, x double, y double")
    got = {(r["k"], r["property"]): (r["min_value"], r["max_value"]) for r in metrics.ranges(df, ["k"], ["x", "y"]).collect()}
    assert got == {("a", "x"): (2.0, 2.0), ("a", "y"): (3.0, 3.0), ("b", "x"): (0.0, 0.0), ("b", "y"): (0.0, 0.0)}


def test_markup(spark):
    html = "<html><script>x<b></script><table><tr><th>Price</th><th colspan=2>Size</th></tr><tr><td>5</td><td>1</td><td>2</td></tr><tr><th>Name</th><td>Cup</td></tr></table><input placeholder=Memo value=hi><select name=s><option>A<option selected>B</select></html>"
    assert markup.label_value_pairs(html) == [("Memo", "hi"), ("Price", "5"), ("Size", "1"), ("Size", "2"), ("Name", "Cup")]
    assert markup.select_groups(html)[0][0] == "s" and markup.select_groups(html)[0][2] == "B"
    assert markup.repeated_rows("<ul>" + "<li class='row x'>a</li>" * 4 + "</ul>") == ("li.row.x", 4)
    assert markup.ancestors([0, 1, 2, 1, 0]) == [-1, 0, 1, 0, -1] and markup.block_end([0, 1, 2, 1, 0], 0) == 3
    assert markup.occupancy([[("a", 2, 1), ("b", 1, 1)], [("c", 1, 1)]]) == [(0, 0, "a", 2, 1), (0, 1, "b", 1, 1), (1, 1, "c", 1, 1)]
    assert markup.subsequence_at(["b", "d"], ["a", "b", "c", "d"]) == 1 and markup.subsequence_at(["z"], ["a"]) == -1
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert markup.html_lines(df).filter("page_id = 1 and tag = 'td'").count() == 4
    assert "script" not in df.select(markup.preclean(F.col("html"))).first()[0]


def test_payloads():
    assert payloads.repair_json("<think>x</think>```json\n{a: 1, “b”: [1, 2,], }``` tail") == {"a": 1, "b": [1, 2]}
    assert payloads.repair_json('{"a": {"b": "c') == {"a": {"b": "c"}}
    assert payloads.repair_json("none") is None
    assert payloads.unpack(gzip.compress(b'{"json_data": {"json_data": {"k": 1}}}')) == {"k": 1}
    assert payloads.unpack("oops") == {"text": "oops"}
    assert payloads.sentences({"b": 1, "id": "x", "a": "", "c": ["p", "q"]}) == "id is x. b is 1. c is p, q."
    assert payloads.deep_diff({"a": {"b": 1}, "c": 2}, {"a": {"b": 2}, "c": 2}) == ["a.b"]
    assert payloads.merge_lists([{"k": 1}], [{"k": 1, "x": 2}, {"k": 2}], "k") == [{"k": 1}, {"k": 2}]


def test_grids(spark, tmp_path):
    grid = [["Price", None, "Name"], ["Net", "Tax", None], ["10", "1", "Cup"], ["", "", ""], ["20", None, "Pen"]]
    assert files.grid_to_rows(grid) == ["Price > Net:10, Price > Tax:1, Name > Tax:Cup", "Price > Net:20, Name > Tax:Pen"]
    assert files.grid_to_rows([]) == []
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>No</t></is></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "a.xlsx").write_bytes(buffer.getvalue())
    (tmp_path / "b.csv").write_text("No,Name\n1,x\n")
    (tmp_path / "c.txt").write_bytes("한글".encode("euc-kr"))
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.xlsx": "No:7", "b.csv": "No:1, Name:x", "c.txt": "한글", "d.docx": None}


def test_spans():
    given = [{"start": 0, "size": 2, "score": 0.5}, {"start": 1, "size": 2, "score": 0.9}, {"start": 4, "size": 1, "score": 0.1}]
    kept = spans.suppress(given)
    assert [(s["start"], s["size"]) for s in kept] == [(1, 2), (4, 1)]
    assert [(s["start"], s["size"]) for s in spans.bridge(kept, 6)] == [(0, 4), (4, 2)]
    assert spans.greedy_chunks(["a", "b", "c"], lambda t: {"a": 0.3, "a b": 0.5}.get(t, 0.1)) == [("a b", 0.5)]
    assert spans.merge_contexts([{"type": "order", "score": 0.1, "condition": {"p": 1}}, {"type": "goods", "score": 0.9, "status": "show", "condition": {"p": 2, "q": 3}}]) == {"type": "goods", "status": "show", "condition": {"p": 1, "q": 3}}


def test_stream(spark, tmp_path):
    for i, rows in enumerate([[("1", 1), ("2", 1)], [("1", 2)]]):
        spark.createDataFrame(rows, "id string, at int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = tasks.read_stream(spark, str(tmp_path / "in"), "id string, at int")
    tasks.upsert_stream(stream, str(tmp_path / "out"), "id", [F.desc("at")], str(tmp_path / "mark")).awaitTermination()
    got = {r["id"]: r["at"] for r in tasks.read_upserted(spark, str(tmp_path / "out"), "id").collect()}
    assert set(got) == {"1", "2"} and got["2"] == 1


def test_task_states(spark):
    df = spark.createDataFrame([(10, None), (1, "done"), (1, "failed"), (1, None), (9, "done")], "status int, outcome string")
    assert [r[0] for r in df.select(tasks.next_status(F.col("status"), F.col("outcome"))).collect()] == [1, 9, 6, 1, 9]


def test_time_range(spark):
    now = F.lit(datetime(2024, 1, 1, 20, 0)).cast("timestamp")
    a, b = spark.range(1).select(*S.time_range(F.lit("last_year"), now)).first()
    assert a == 1672498800000 and b == 1704034800000 - 1
