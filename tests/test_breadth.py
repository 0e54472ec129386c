"""Queries without SQL against brute force, and operators that need more than the tables: links, stores, queues, rules."""

import hashlib
import os
import re
import zlib
from collections import Counter
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from tradeloom.functions import markup, payloads, scalars, shapes
from tradeloom.operators import classify, records, relay, search, spans
from tradeloom.plans import catalogue, classified
from tradeloom.schema import ENTITY
from tradeloom.sources import files
from tradeloom.streaming import tasks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def rows(spark, name, *cols):
    return Counter(tuple(r) for r in catalogue.QUERIES[name](spark, SF).select(*cols).collect())


def greedy(cells, absolute, margin, by_score=False):
    """One cell at a time: the best of those left whose field and line are free. cells: {(field, line): score}."""
    lead = {}
    for (f, n), own in cells.items():
        others = [s for (g, m), s in cells.items() if m == n and g != f]
        rival = max([s for s in others if s >= absolute], default=absolute) if by_score else max([0.0, *others])
        if own >= absolute and own - rival >= margin:
            lead[(f, n)] = own - rival
    out = []
    while lead:
        best = min(lead, key=lambda k: ((-cells[k], -lead[k]) if by_score else (-lead[k], -cells[k]), k))
        out.append((*best, cells[best]))
        lead = {k: v for k, v in lead.items() if k[0] != best[0] and k[1] != best[1]}
    return out


def test_exclusive_assign(spark, db):
    docs = {}
    for doc, field, line, score in db.sql(catalogue.MATRIX).fetchall():
        docs.setdefault(doc, {})[(field, line)] = score
    want = Counter((d, f, n) for d, cells in docs.items() for f, n, _ in greedy(cells, 0.0, 0.0))
    assert want and rows(spark, "exclusive_assign", "doc", "field", "line") == want


def test_label_section_fields(spark, db):
    docs = {}
    for doc, field, phrase, score in db.sql(catalogue.SQL["label_section_pairs"]).fetchall():
        docs.setdefault(doc, {})[(field, phrase)] = score
    want = Counter((d, f, n) for d, cells in docs.items() for f, n, _ in greedy(cells, 0.0, 0.0, True))
    assert want and rows(spark, "label_section_fields", "doc", "field", "phrase") == want


def test_header_to_fields(spark, db):
    docs = {}
    for doc, line, field, own, prej in db.sql(classified.CELLS).fetchall():
        own = round(abs(own) ** 0.5, 6)
        if own >= 0.62 and own - prej >= 0.10:
            docs.setdefault(doc, {})[(field, line)] = own - prej
    want = Counter((d, f, n) for d, cells in docs.items() for f, n, _ in greedy(cells, 0.10, 0.03))
    assert want and rows(spark, "header_to_fields", "doc", "field", "header") == want


def test_single_candidate_fields(spark, db):
    cells = {(d, f, n): s for d, n, f, s, _ in db.sql(classified.CELLS).fetchall()}
    done = [(d, f, n) for d, f, n, _ in db.sql(classified.ONE).fetchall() if f % 2 == 0]
    want = Counter(done)
    for doc in {d for d, _, _ in cells}:
        claimed, fields = {n for d, _, n in done if d == doc}, {f for d, f, _ in done if d == doc}
        for f in sorted({f for d, f, _ in cells if d == doc} - fields):
            mine = [n for d, g, n in cells if d == doc and g == f and cells[(d, g, n)] >= 0.6 and n not in claimed]
            if len(mine) == 1:
                claimed.add(mine[0])
                want[(doc, f, mine[0])] += 1
    assert sum(want.values()) > len(done) and rows(spark, "single_candidate_fields", "doc", "field", "line") == want


def test_crc32_index(spark, db):
    hashed = lambda t: "0x" + hashlib.sha256(t.encode()).hexdigest()[:40]
    want = Counter()
    for (key,) in db.sql("select o_orderkey from orders").fetchall():
        index = zlib.crc32(hashed(f"orderteam{key}").encode())
        want[(key, index, hashed(f"team{index}"))] += 1
    assert rows(spark, "crc32_index", "o_orderkey", "index", "id") == want


def scored(db):
    out = {}
    for item, text in db.sql("select item_id, text from benchmark").fetchall():
        words = text.split()
        for k in range(2, 9):
            for i in range(len(words) - k + 1):
                out.setdefault(item, []).append((i, k, zlib.crc32(" ".join(words[i : i + k]).encode()) % 1000 / 1000))
    return out


def test_span_selection(spark, db):
    want = Counter()
    for item, given in scored(db).items():
        left = sorted(given, key=lambda s: (-s[2], -s[1], s[0]))
        while left:
            i, k, _ = left.pop(0)
            want[(item, i, k)] += 1
            left = [s for s in left if s[0] >= i + k or s[0] + s[1] <= i]
    assert rows(spark, "span_selection", "item_id", "start", "size") == want


def test_span_overlap_bonus(spark, db):
    want = Counter()
    for item, given in scored(db).items():
        for i, k, _ in given:
            best = max((s for a, b, s in given if i < a < i + k < a + b), default=0.0)
            want[(item, i, k, round(best * 0.1, 6))] += 1
    assert rows(spark, "span_overlap_bonus", "item_id", "start", "size", "bonus") == want


def test_html_queries(spark, db):
    pages = db.sql("select page_id, html from pages").fetchall()
    clean = {}
    for key, html in pages:
        out = re.sub(r"(?s)<!--.*?-->", "", html)
        for tag in markup.DROPPED:
            out = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "", out)
            out = re.sub(rf"(?is)<{tag}\b[^>]*/?>", "", out)
        clean[key] = re.sub(r"\n\s*\n+", "\n", out).strip(" ")
    assert rows(spark, "html_preclean", "page_id", "n", "sha") == Counter((k, len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in clean.items())
    lines = catalogue.QUERIES["html_lines"](spark, SF).orderBy("page_id", "pos").collect()
    words = Counter()
    for r in lines:
        words[r["page_id"]] += len(r["text"].split())
    import html as entities

    for key, text in clean.items():
        assert words[key] == len(entities.unescape(re.sub(r"<[^>]*>", " ", text)).split())
    opened = Counter((k, t.lower()) for k, text in clean.items() for t in re.findall(r"<([A-Za-z][A-Za-z0-9]*)", text))
    assert Counter((r["page_id"], r["tag"]) for r in lines) == opened
    titles = Counter((r["page_id"], r["pos"], r["tag"], r["text"]) for r in lines if r["tag"] in markup.HEADINGS and 1 <= len(r["text"]) <= 60)
    assert rows(spark, "html_titles", "page_id", "pos", "tag", "text") == titles
    above, want = {}, Counter()
    for r in lines:
        if r["tag"] in markup.HEADINGS and r["text"]:
            above[r["page_id"]] = r["text"]
        if r["tag"] == "p":
            want[(r["page_id"], r["pos"], above.get(r["page_id"]), r["text"])] += 1
    assert rows(spark, "html_sections", "page_id", "pos", "section", "text") == want


def test_resolved_links(spark):
    bases = ["https://a.com/x/y/z.html?q=1#f", "http://b.org", "https://a.com/x/"]
    hrefs = ["c", "./c", "../c", "../../../c", "/c/./d/../e", "//h.net/p", "https://o.org/", "?k=v", "", "c/", "..", ".", "#top", "a/b/../c?x=../y"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    got = {(r["b"], r["h"]): r["u"] for r in df.select("b", "h", shapes.resolved(F.col("h"), F.col("b")).alias("u")).collect()}
    for (b, h), u in got.items():
        want = urljoin(b, h) if h else b
        assert u.rstrip("/") == want.rstrip("/"), (b, h)


def test_rules(spark):
    """Every rule in its direction, on records of one team and site; empty givers and zero keys leave things as they are."""
    cols = "id string, `to` string, cc string, `index` long, goods long, `order` long, tracking long, event long, no string, discount double, width double, updated_at long"
    base = {"id": "x", "to": "t", "cc": "c", "index": 5, "goods": 0, "order": 0, "tracking": 0, "event": 0, "no": "", "discount": 0.0, "width": 0.0, "updated_at": 0}

    def table(*given):
        return spark.createDataFrame([tuple({**base, **g}.values()) for g in given], cols)

    for rule in relay.RULES:
        primary = {"id": "p", "discount": 0.3, "width": 2.0, "no": "n", "updated_at": 1, rule.value: 7}
        if rule.having:
            name = rule.having.lstrip("!")
            if name != rule.value:
                primary[name] = 0 if rule.having.startswith("!") else 9
        foreign = {"id": "f", "discount": 0.5, "width": 4.0, "no": "m", "updated_at": 0, rule.column: 7}
        alone = {"id": "other", rule.column: 8}
        got = relay.apply_rule(rule, table(primary, {**primary, "id": "far", "cc": "elsewhere"}), table(foreign, alone), 99).collect()
        assert [r["id"] for r in got] == ["f" if rule.giver == "primary" else "p"], rule
        taker, giver = (foreign, primary) if rule.giver == "primary" else (primary, foreign)
        for c in ("discount", "width", "no"):
            assert got[0][c] == (giver if c in rule.include else taker)[c], (rule, c)
    assert relay.related_types("sales") == list(relay.RELATED["order"]) and relay.related_types("?") == []
    one = relay.RULES[5]
    several = relay.apply_rule(one, table({"id": "a", "index": 7, "discount": 0.1, "updated_at": 1}, {"id": "b", "index": 7, "discount": 0.2, "updated_at": 2}), table({"id": "f", "goods": 7}), 99).collect()
    assert [(r["id"], r["discount"], r["updated_at"]) for r in several] == [("f", 0.2, 99)]


def test_stored_tables(spark, tmp_path):
    store = records.Store(spark, str(tmp_path / "store"))
    assert store.read("items").count() == 0 and store.config() == {} and store.get("k") is None
    row = records.documents(spark.createDataFrame([("1", "x")], "id string, text string"))
    store.write({"items": row, "pages": row})
    store.set("k", [1, 2])
    store.save_config({**store.config(), "port": 3})
    again = records.Store(spark, str(tmp_path / "store"))
    assert again.read("items").collect()[0]["text"] == "x" and again.get("k") == [1, 2] and again.config()["port"] == 3
    assert records.hit(again.read("items"), "id", "1").count() == 1 and records.hit(again.read("items"), "id", "9").count() == 0
    with pytest.raises(ValueError):
        store.write({"items": row.drop("mode")})
    row.withColumn("status", F.lit("s")).write.mode("overwrite").parquet(str(tmp_path / "store/items/1"))  # another schema
    assert again.read("items").count() == 0
    for f in (tmp_path / "store/pages/1").iterdir():
        if f.suffix == ".parquet":
            f.write_bytes(b"broken")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert again.read("pages").count() == 0
    assert {k: v.count() for k, v in again.snapshot().items()} == {"tasks": 0, "pages": 0, "users": 0, "items": 0}
    store.reset()
    assert again.read("items").count() == 0 and ENTITY.fieldNames() == again.read("items").columns


def test_payload_codec(spark):
    import base64
    import gzip

    inner = '{"tracking_number":"12","price":"3","text":"' + "long " * 20 + '"}'
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    df = spark.createDataFrame([("1", '{"data":"%s"}' % packed), ("2", '{"data":"short","x":1}'), ("3", None), ("4", "broken")], "id string, p string")
    got = {r["id"]: r for r in records.entity_rows(df, "p", 5).collect()}
    assert '"tracking":"12"' in got["1"]["data"] and '"sale_price":"3"' in got["1"]["data"] and got["1"]["text"].startswith("long")
    assert got["2"]["data"] == '{"data":"short","x":"1"}' and got["3"]["data"] == got["4"]["data"] == "{}" and got["4"]["updated_at"] == 5


def test_predicate_fallback(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert search.where(df, "x > 1 AND y LIKE 'b%'").count() == 1
    assert search.where(df, "no_column = 1", F.col("x") == 1).count() == 1 and search.where(df, "x >", F.lit(True)).count() == 2
    with pytest.raises(Exception):
        search.where(df, "no_column = 1")


def test_queues(spark, tmp_path):
    turns, slept = iter([0, 0, 0, 0, 0, 2, 0]), []
    assert tasks.poll(lambda: None, lambda _: next(turns), turns=7, sleep=slept.append) == 2
    assert slept == [1.0, 2.0, 4.0, 8.0, 10.0, 1.0]
    woken = iter([False, True, False])
    pauses = []
    tasks.poll(lambda: None, lambda _: 0, wake=lambda s: (pauses.append(s), next(woken))[1], turns=3)
    assert pauses == [1.0, 2.0, 1.0]
    times = iter([0.0, 0.0, 30.0, 49.0, 51.0])
    assert tasks.within_budget([1, 2, 3, 4, 5], lambda b: None, 50.0, lambda: next(times)) == 3
    a, b = tasks.Lock(spark, str(tmp_path / "lock")), tasks.Lock(spark, str(tmp_path / "lock"))
    assert a.take() and not b.take()
    a.give()
    assert b.take()
    queue = spark.createDataFrame([(1, "x", 10, 5), (2, "ai_search", 10, 1), (3, "x", 1, 1), (4, "lock", 10, 3), (5, "x", 10, 2)], "id int, type string, status int, created_at int")
    assert [r["id"] for r in tasks.waiting(queue).collect()] == [5, 4, 1]
    assert sorted(r["id"] for r in tasks.cron_batch(queue).collect()) == [2, 5]
    before = spark.createDataFrame([(1, 1), (2, 1)], "id int, at int")
    now = spark.createDataFrame([(1, 1), (2, 3)], "id int, at int")
    assert [r["id"] for r in tasks.unchanged(before, now, "id", "at").collect()] == [1]


def test_stream_once_and_progress(spark, tmp_path):
    from datetime import datetime

    seen = []
    listener = tasks.follow(spark, lambda name, batch, n: seen.append((name, batch, n)))
    day = datetime(2024, 1, 1)
    spark.createDataFrame([("1", day), ("1", day), ("2", day)], "id string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tasks.once(tasks.read_stream(spark, str(tmp_path / "in"), "id string, at timestamp"), "at", "1 hour", "id")
    query = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 2
    for _ in range(50):
        if any(n == 3 for _, _, n in seen):
            break
        import time

        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert any(n == 3 for _, _, n in seen)


def test_absorbing_spans():
    given = [{"start": 0, "size": 3, "score": 0.5, "priority": 1, "category": "goods"}, {"start": 2, "size": 2, "score": 0.9, "priority": 0, "category": "event"}, {"start": 5, "size": 1, "score": 0.1, "priority": 0, "category": "coupon"}]
    kept = spans.absorb(given)
    assert [(s["category"], s["also"]) for s in kept] == [("goods", ["event"]), ("coupon", [])]


def test_table_rows_and_headers():
    html = "<table><thead><tr><th colspan=2>Price</th><th>Name</th></tr><tr><td>Net</td><td>Tax</td></tr></thead><tbody><tr><td rowspan=2>1</td><td>a</td></tr><tr><td>b</td></tr><tr><td>2</td><td>c</td></tr></tbody></table>"
    assert markup.table_headers(html) == [["Price", "Name"], ["Net", "Tax"]]
    assert [[t for *_, t in r if t] for r in markup.split_rows(html, "tbody", "tr")] == [["1", "a", "b"], ["2", "c"]]
    assert markup.split_rows("", "tbody", "tr") == [] and markup.table_headers(None) == []
    assert markup.only_allowed('<a href="x" onclick="y" data-z=1 class=\'c\'>t</a><br/>') == '<a href="x" class="c">t</a><br/>'


def test_bands_of_an_image():
    bands = [{"header": {"no": "A", "date": ""}, "line_items": [{"description": "x"}], "total": 0}, {"header": {"no": "", "date": "d"}, "line_items": [{"description": "x"}, {"description": "y"}], "total": 5}, None]
    assert payloads.merged_bands(bands, {"line_items": "description"}) == {"header": {"no": "A", "date": "d"}, "line_items": [{"description": "x"}, {"description": "y"}], "total": 5}


def test_chunked_vectors(spark):
    import numpy as np

    from tradeloom.operators import vectors

    df = spark.createDataFrame([("a b c d e",), ("",), (None,)], "t string")
    embed = lambda words: np.array([len(" ".join(words)), 1.0])
    got = [r[0] for r in df.select(vectors.chunked_vector(embed, 2)(F.col("t"))).collect()]
    one, two, three = (v / np.linalg.norm(v) for v in (np.array([3.0, 1]), np.array([3.0, 1]), np.array([1.0, 1])))
    want = (one + two + three) / 3
    assert np.allclose(got[0], want / np.linalg.norm(want)) and got[1] == got[2] == [0.0, 0.0]


def test_similarity_bank_has_a_bound(spark):
    lines = spark.createDataFrame([(1, [1.0, 0.0])], "line int, v array<double>")
    bank = spark.createDataFrame([("c", "p", 1.0, [1.0, 0.0])] * 3, "category string, phrase string, weight double, vector array<double>")
    assert classify.similarities(lines, "v", bank).count() == 3
    with pytest.raises(ValueError):
        classify.similarities(lines, "v", bank, most=2)


def test_languages_and_zones(spark):
    df = spark.createDataFrame([("상품 abc",), ("le produit",), ("12 34",), ("хлеб",)], "t string")
    detect = lambda t: F.when(t.contains("le "), "fr")
    assert [r[0] for r in df.select(scalars.language(F.col("t"), detect)).collect()] == ["ko", "fr", "en", "ru"]
    zones = spark.createDataFrame([("FA",), ("pt",), ("sw",), ("xx",), (None,)], "l string")
    assert [tuple(r) for r in zones.select(shapes.utc_offset(F.col("l")), shapes.is_southern(F.col("l"))).collect()] == [(210, False), (-180, True), (180, True), (540, False), (540, None)]
    keys = spark.range(1).select(*scalars.scope_keys(F.lit("t"), F.lit("k"), F.lit("ab"), F.lit("/x"), F.lit(True)), *scalars.scope_keys(F.lit("t"), F.lit("k"), F.lit("AB"), F.lit("/x"))).first()
    assert keys[0] == keys[2] and keys[1] != keys[3]


def test_whole_blocks_of_a_page():
    page = ["h1 | Title", "table", "  tr", "    td | " + "x" * 40, "p | after"]
    assert markup.truncate_whole(page, 100) == page
    assert markup.truncate_whole(page, 8) == page[:1]
    assert markup.truncate_whole(page[1:], 3) == page[1:3]
    assert markup.truncate_whole(["ul", "  b | " + "y" * 40, "p"], 2) == ["ul"] and markup.truncate_whole([], 5) == []


def test_binary_documents_and_images(spark, tmp_path):
    assert files.printable("견적서 No 12".encode("utf-16-le") + b"\0\0\1\2Total 55\0").split("\n")[0] == "견적서 No 12"
    (tmp_path / "a.hwp").write_bytes(b"\0\1Invoice 77\0")
    (tmp_path / "b.doc").write_bytes(b"\0")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert "Invoice 77" in got["a.hwp"] and got["b.doc"] == ""

    def vision(content):
        if content[:1] == b"\0":
            raise ValueError
        return [{"no": content.decode(), "items": [{"d": 1}]}, {"no": "", "items": [{"d": 1}, {"d": 2}]}]

    (tmp_path / "img").mkdir()
    (tmp_path / "img/x.png").write_bytes(b"n1")
    (tmp_path / "img/y.png").write_bytes(b"\0")
    data = {r["path"][-5:]: r["data"] for r in files.read_images(spark, str(tmp_path / "img"), vision, {"items": "d"}).collect()}
    assert data == {"x.png": '{"items": [{"d": 1}, {"d": 2}], "no": "n1"}', "y.png": None}
