"""SimHash near-duplicates by multi-index hashing, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import chunks, cut, documents

SHINGLE = 3
DISTANCE = 2
SEED = 42
BUCKET = 32  # fingerprints in a bucket up to which its pairs are compared
FOREST_NODES = 1_000_000  # that a task holds before it hands on what it has joined


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of hashes, unsigned: a bit is 1 if set in over half of them."""
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint, unsigned: a bit is 1 if set in over half the hashes of the word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n)
    return of_hashes(hashes)


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", size: int = SHINGLE) -> DataFrame:
    """doc_id, tag (a hash of the text) and fp (the fingerprint as a signed long) of every row; null text is empty, with fingerprint 0."""

    def run(batches):
        for ids, tags, texts in chunks(batches, ["doc_id", "tag", "text"]):
            got = np.array([simhash(t, size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(got)], names=["doc_id", "tag", "fp"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    return read.mapInArrow(run, "doc_id long, tag long, fp long")


def _segments(fp, ball: bool):
    """(segment number, value) keys as longs: the fingerprint's two halves, or all values at one bit or none from them."""
    flips = [0, *(1 << b for b in range(32))] if ball else [0]
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    keys = [high.bitwiseXOR(F.lit(x).cast("long")) for x in flips]
    keys += [low.bitwiseXOR(F.lit(x).cast("long")) + F.lit(1 << 32) for x in flips]
    return F.array(*keys)


def near_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect every two different fingerprints at 2 bits or fewer, and no others. The method's tables
    serve buckets of up to `bucket` fingerprints; larger ones take another way that is as exact.

    Two such fingerprints differ by one bit at most in one half. So each half is a table; every fingerprint probes
    it with the 33 values of the ball around its own half, and a match is a link if the whole distance holds.
    A table bucket of over `bucket` fingerprints isn't compared pair by pair: those in it, and those that probe it,
    meet instead at the 65 values within one bit of the whole fingerprint, which two of them share exactly if they
    are at 2 bits or fewer; all at a value are then linked to the least there. Either way the number of rows is
    in proportion to the number of fingerprints.
    """
    entries = fps.select(F.explode(_segments(F.col("fp"), False)).alias("key"), F.col("fp").alias("b"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n"))
    # Spark judges the size of a side by the files before explode(), so a few MB of them had all probes broadcast
    light = entries.join(sizes.filter(F.col("n") <= bucket).hint("merge"), "key").select("key", "b")
    heavy = sizes.filter(F.col("n") > bucket).select("key", F.lit(None).cast("long").alias("b"))
    probes = fps.select(F.explode(_segments(F.col("fp"), True)).alias("key"), F.col("fp").alias("a"))
    found = probes.join(light.unionByName(heavy).hint("merge"), "key")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = cut(found.filter(F.col("b").isNull() | ((F.col("a") < F.col("b")) & (apart <= DISTANCE))).select("a", "b").distinct())
    balls = [F.lit(0), *(F.lit(1 << b if b < 63 else -(2**63)) for b in range(64))]
    near = F.array(*[F.col("a").bitwiseXOR(x.cast("long")) for x in balls])
    crowd = found.filter(F.col("b").isNull()).select(F.explode(near).alias("at"), F.col("a").alias("b"))
    least = crowd.groupBy("at").agg(F.min("b").alias("a"), F.collect_list("b").alias("all"))  # 65 fingerprints at most
    stars = least.select("a", F.explode("all").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    return found.filter(F.col("b").isNotNull()).unionByName(stars)


def _forest(links: DataFrame) -> DataFrame:
    """Each task replaces its links by stars with the same components."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars():
            rows = [(root(x), x) for x in list(up) if root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > FOREST_NODES:
                yield stars()
                up.clear()
        yield stars()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(b, a): every linked node but the least of its component, and that least one.

    Links are first thinned to a forest task by task, then alternating large-star and small-star steps, each a join
    with minima that are taken before the shuffle, until the links no longer change. Each round is cut to the shared folder.
    """
    now, before = cut(_forest(links)), None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")
        large = large.filter(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
        small = large.join(least, F.col("b") == F.col("u"))
        hooked = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b"))
        seen = Observation()
        sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("h"), F.sum(F.xxhash64("b", "a") % (1 << 31)).alias("g")
        now = cut(hooked.filter(F.col("a") != F.col("b")).distinct().observe(seen, *sums))
        mark = seen.get
        if mark == before:
            return now.select("b", "a")
        before = mark
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, doc_id="doc_id", text="text", size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, tag, fp, root and component_id of every row; root names the class."""
    rows = cut(fingerprints(docs, doc_id, text, size))
    known = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(known.select("fp"), bucket))
    placed = known.join(roots, known.fp == roots.b, "left").select("fp", "least", F.coalesce("a", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(named, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(of, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; fingerprints link at 2 differing bits or fewer.

    Words are split at ASCII white space after A-Z become lower case. Null and empty texts have fingerprint 0 and
    link like any other. component_id is the least doc_id reachable, null ids aside; a null doc_id has its own row.
    Equal fingerprints are merged before anything is compared, and repeated rows keep a row each. An empty table
    gives no row; other columns are not read.
    """
    found = classes(docs, doc_id, text, size, bucket)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rows_of(docs: DataFrame, best: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """The rows of docs that best (_id, _tag: a hash of the text) names, repeated ones once, with all columns of docs."""
    mark = "_text"
    while mark in docs.columns:
        mark += "_"
    tagged = docs.withColumn(mark, F.xxhash64(text))
    kept = tagged.join(best, F.col(doc_id).cast("long").eqNullSafe(best["_id"]) & (F.col(mark) == best["_tag"]), "left_semi")
    return kept.dropDuplicates([doc_id, mark]).drop(mark)


def first_of_each(docs: DataFrame, doc_id="doc_id", text="text", size: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand for their class: one of each, with the least doc_id, a null one only if there is no other."""
    found = classes(docs, doc_id, text, size)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.tag").alias("_tag"))
    return rows_of(docs, first, doc_id, text)


def op3_multi_index(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
