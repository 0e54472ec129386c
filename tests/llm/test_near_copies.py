import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradeloom.llm import near_copies, simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    return not (x or y) or len(x & y) / len(x | y) >= 0.8


def brute(given):
    """The doc_ids that stand for their class."""
    sets = [grams(t) for _, t in given]
    up = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if up[i] != up[j] and alike(sets[i], sets[j]):
                up = [up[j] if u == up[i] else u for u in up]
    return sorted(min(given[i][0] for i in range(len(given)) if up[i] == r) for r in set(up))


def corpus():
    rng = random.Random(5)
    out = []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        for k in range(6):
            now = list(words)
            for _ in range(k * len(now) // 70):
                now[rng.randrange(len(now))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(now))
    return list(enumerate([*out, "", "  ", None, "a b", "A  b", "a c"]))


@pytest.mark.parametrize("bucket", [16, 2])
def test_near_copies_at_five_words(spark, bucket):
    given = corpus()
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    want = brute(given)
    assert sorted(r[0] for r in near_copies.first_of_each(docs, bucket=bucket).select("doc_id").collect()) == want
    assert simhash.first_of_each(docs).count() > len(want)


def test_stage_takes_near_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[100:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    assert (simhash.simhash(rows[0][1], 3) ^ simhash.simhash(rows[1][1], 3)).bit_count() > 2
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, None).collect()} == {1, 3}


def test_recall_on_real_texts(spark):
    """Of all pairs at 0.8 or more, by brute force, nine of ten at least are in one class; and no class joins what no chain of such pairs does."""
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    sets = {i: grams(t) for i, t in given}
    holders = {}
    for i, g in sets.items():
        for x in g:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in holders.values() if len(ids) < 200 for a, b in itertools.combinations(sorted(ids), 2))
    pairs = {p for p, n in shared.items() if n >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    tags = {r["doc_id"]: r["tag"] for r in near_copies._texts(docs, "doc_id", "text").collect()}
    root = {r["tag"]: r["root"] for r in near_copies.classes(docs).collect()}
    caught = sum(root[tags[a]] == root[tags[b]] for a, b in pairs)
    assert len(pairs) > 20 and caught >= 0.9 * len(pairs)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    assert all(len({top(i) for i in sets if root[tags[i]] == r and sets[i]}) <= 1 for r in set(root.values()))


def test_a_large_group_of_near_copies(spark):
    """Thousands of rows that differ in a word: one class, however many share a bucket."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[: i % 110] + [f"x{i}"] + words[i % 110 + 1 :])) for i in range(1500)] + [(5000 + i, f"own{i} " * 3 + f"text{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in near_copies.first_of_each(docs).select("doc_id").collect()}
    assert kept == {0, *range(5000, 5020)}


def test_probes_are_not_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or df)
    links = simhash.near_links(spark.range(40).select(F.col("id").alias("fp")), 4)
    assert plans and "BroadcastHashJoin" not in plans[0]  # 66 rows a fingerprint, which the driver would hold
    assert all((r["a"] ^ r["b"]).bit_count() <= 2 for r in links.collect())


def test_fingerprints_give_candidates(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join([*words, "more"]), " ".join(reversed(words)), "", " "]
    known = near_copies.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("doc_id")
    rows = known.collect()
    want = {tuple(sorted((x["tag"], y["tag"]))) for x, y in itertools.combinations(rows, 2) if (x["fp"] ^ y["fp"]).bit_count() <= 2 or x["fp"] == y["fp"]}
    got = {(r["a"], r["b"]) for r in near_copies.fingerprint_pairs(known).collect()}
    assert len(want) >= 2 and got <= want
    up = {r["tag"]: r["tag"] for r in rows}
    for pairs in (got, want):
        for a, b in pairs:
            up = {k: up[a] if v == up[b] else v for k, v in up.items()}
        if pairs is got:
            classes = len(set(up.values()))
    assert len(set(up.values())) == classes


def test_stage_goes_through_the_multi_index(spark, monkeypatch):
    import corpus_pipeline

    calls = []
    monkeypatch.setattr(near_copies, "near_links", lambda fps: calls.append(fps.columns) or simhash.near_links(fps))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")], "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, None).collect()) == [1, 3]
    assert calls == [["fp"]]
