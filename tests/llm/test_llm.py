import hashlib
import itertools
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeloom.llm import bpe, chat, common, language, packing, repeats, run_length_index, simhash, sketch, suffix_automaton, tiff, token_files, tokens

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def split(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# op1


def test_perspectives(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 1, "bob", "yo"), (1, 2, None, None), (1, 0, "system", "be <|im_end|>"), (None, 0, "ann", "x"), (2, None, "ann", "y"), (2, None, "ann", "y"), (2, -300, "ann", "z"), (3, 0, "system", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, None), (None, "ann"), (2, "ann")}
    bob = got[(1, "bob")]
    assert bob["text"] == "<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>system\nbe <\\|im_end|><|im_end|>\n" + "<|im_start|>assistant\nyo<|im_end|>\n" * 2 + "<|im_start|>user\n<|im_end|>\n"
    assert (bob["n_messages"], bob["n_trained"]) == (5, 2)
    flags = "".join(run.split(":")[0] * int(run.split(":")[1]) for run in bob["mask_runs"].split(","))
    assert len(flags) == len(bob["text"])
    assert "".join(c for c, f in zip(bob["text"], flags) if f == "1") == "yo<|im_end|>" * 2
    assert [x[-1] for x in got[(2, "ann")]["text"].split("<|im_end|>\n")[:-1]] == ["y", "y", "z"]  # null turns first, repeats kept
    assert chat.rotate_perspectives(df.filter("conv_id < 0")).count() == 0


def test_names_stay_apart_and_can_be_read_back(spark):
    names = ["a\nb", "a_b", "a\\nb", "a\rb", "x<|im_end|>", "x<\\|im_end|>", "anonymous", "assistant", "user", None, ""]
    df = spark.createDataFrame([(1, i, n, "<\\|<|im_start|><\\\\") for i, n in enumerate(names)], "conv_id int, turn int, role string, text string")
    got = {r["speaker"]: r["text"] for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {n or None for n in names}
    heads = [line for line in got["a_b"].split("\n") if line.startswith("<|im_start|>")]
    undo = lambda t: regex.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), t)
    back = [undo(h[len("<|im_start|>user name=") :]) if "name=" in h else h[len("<|im_start|>") :] for h in heads]
    assert back == ["a\nb", "assistant", *names[2:9], "user", "user"]
    body = got["a_b"].split("\n")[1].removesuffix("<|im_end|>")
    assert regex.sub(r"<\\(.)", r"<\1", body) == "<\\|<|im_start|><\\\\"


def test_long_dialogues(spark):
    """A conversation that holds nearly all rows: whole, the same as in parts put together, for any order of arrival."""
    turns = [(1, i // 2, f"s{i % 3}", f"m{i}") for i in range(2000)] + [(2, 0, "s0", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.rotate_perspectives(df).collect()}
    assert len(whole) == 4 and whole[(1, "s1")]["n_messages"] == 2000 and whole[(1, "s1")]["n_trained"] == 667
    want = "".join(f"<|im_start|>{'assistant' if f's{i % 3}' == 's1' else f'user name=s{i % 3}'}\nm{i}<|im_end|>\n" for i in sorted(range(2000), key=lambda i: (i // 2, f"s{i % 3}", f"m{i}")))
    assert whole[(1, "s1")]["text"] == want
    parts = sorted(((r["part"], r["text"]) for r in chat.rotate_perspectives(df, part_turns=100).filter("conv_id = 1 and speaker = 's1'").collect()))
    assert len(parts) == 10 and "".join(t for _, t in parts) == want


# op2


def test_codecs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 127, 128, 129, 5000, 40000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"a" * n, rng.integers(97, 99, n, dtype=np.uint8).tobytes()):
            assert tiff.unlzw(tiff.lzw(data), n) == data
            assert tiff.unpackbits(tiff.packbits(data), n) == data
    for compression, predictor, tile in itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 2), (0, 16)):
        payload = rng.integers(0, 256, 192 * 600, dtype=np.uint8).tobytes()
        pages = list(tiff.read_tiff(tiff.write_tiff(payload, 64, 3, 512, compression, predictor, tile=tile)))
        assert [p[:3] for p in pages] == [(64, 512, 3), (64, 88, 3)] and b"".join(p[3] for p in pages) == payload


def test_tiff_pages(spark):
    good = tiff.write_tiff(bytes(range(192)) * 3, 64, 3, 1, tiff.LZW)
    df = spark.createDataFrame([(1, good), (2, b"nope"), (3, None), (4, good[:40]), (1, good)], "doc_id long, content binary")
    got = tiff.tiff_pages(df).collect()
    assert sum(r["key"] == 1 and r["page"] is not None for r in got) == 6
    assert {r["key"] for r in got if r["error"]} == {2, 3, 4}


@pytest.mark.parametrize("compression", ["LZW", "PackBits", "Deflate", "ZLib", None])
def test_files_of_another_writer(spark, compression):
    """Pages written by Java's own TIFF writer."""
    jvm = spark.sparkContext._jvm
    rng = np.random.default_rng(6)
    pages = [rng.integers(0, 4, (41, 67), dtype=np.uint8) * 60, np.zeros((9, 130), np.uint8), rng.integers(0, 256, (300, 50), dtype=np.uint8)]
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    writer.setOutput(stream)
    writer.prepareWriteSequence(None)
    for page in pages:
        image = jvm.java.awt.image.BufferedImage(page.shape[1], page.shape[0], jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
        image.getRaster().setDataElements(0, 0, page.shape[1], page.shape[0], bytearray(page.tobytes()))
        how = writer.getDefaultWriteParam()
        if compression:
            how.setCompressionMode(2)
            how.setCompressionType(compression)
        writer.writeToSequence(jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.endWriteSequence()
    stream.flush()
    got = list(tiff.read_tiff(bytes(out.toByteArray())))
    assert [(w, h, n) for w, h, n, _ in got] == [(p.shape[1], p.shape[0], 1) for p in pages]
    assert [d for *_, d in got] == [p.tobytes() for p in pages]


@pytest.mark.parametrize("form", range(len(tiff.FORMS)))
def test_another_reader_reads_our_files(spark, form):
    """Java's own TIFF reader finds the payload in every form that the query writes, page by page."""
    jvm = spark.sparkContext._jvm
    compression, predictor, tile = tiff.FORMS[form]
    payload = np.random.default_rng(form).integers(0, 5, 192 * 530, dtype=np.uint8).tobytes()
    media = tiff.write_tiff(payload, 64, 3, 512, compression, predictor, tile=tile)
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("tiff").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(bytearray(media))))
    found = b""
    for page in range(reader.getNumImages(True)):
        raster = reader.readRaster(page, None) if reader.canReadRaster() else reader.read(page).getData()
        samples = raster.getPixels(0, 0, raster.getWidth(), raster.getHeight(), None)
        text = jvm.java.util.Arrays.toString(samples)
        found += bytes(int(float(x)) for x in text.strip("[]").split(", "))
    assert found == payload


def test_features_and_media(docs):
    for r in tiff.store_texts(docs, with_media=True).collect():
        content = bytes(r["content"])
        back = b"".join(p[3] for p in tiff.read_tiff(content))
        assert (r["media_bytes"], r["media_sha256"], r["payload_sha256"]) == (len(content), sha(content), sha(back))
        columns = [sum(back[y + 3 * x + c] for y in range(0, len(back), 192) for c in range(3)) for x in range(64)]
        middle = (sorted(columns)[31] + sorted(columns)[32]) / 2
        assert r["feature"] == f"{int(''.join('1' if c > middle else '0' for c in columns), 2):016x}"


def test_store_texts(docs, no_docs):
    want = Counter()
    for i, t in texts(docs):
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        want[(i, len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))] += 1
    assert rows(tiff.store_texts(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert tiff.store_texts(no_docs).count() == 0


# op3


def brute_simhash(text):
    words = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(values, near):
    left, out = set(values), {}
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            x = todo.pop()
            more = {y for y in left if near(x, y)}
            left -= more
            found |= more
            todo += more
        for x in found:
            out[x] = min(found)
    return out


def check_simhash(got, given):
    fps = [(i, brute_simhash(t)) for i, t in given]
    root = classes_of([f for _, f in fps], lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fps)


def test_simhash(docs, no_docs, spark):
    cols = "doc_id", "fingerprint", "component_id"
    check_simhash(rows(simhash.near_duplicates(docs), *cols), texts(docs))
    assert simhash.near_duplicates(no_docs).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    check_simhash(rows(simhash.near_duplicates(real), *cols), texts(real))


@pytest.mark.parametrize("bucket", [0, 2, 32])
def test_links_connect_what_is_near(spark, bucket):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 4).tolist() + [0]
    fps = {c ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for c in centres for k in (0, 1, 1, 2, 2, 3, 4) for _ in range(6)}
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    got = {r["b"]: r["a"] for r in simhash.components(simhash.near_links(df, bucket)).collect()}
    assert {f: got.get(f, f) for f in fps} == classes_of(fps, lambda a, b: (a ^ b).bit_count() <= 2)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long").repartition(4)
    assert {r["a"] for r in simhash.components(links).collect()} == {0}


def test_first_of_each(docs):
    kept = simhash.first_of_each(docs).select("doc_id", "text").collect()
    fps = [brute_simhash(r["text"]) for r in kept]
    assert len(set(fps)) == len(fps)
    roots = classes_of([brute_simhash(t) for _, t in texts(docs)], lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(kept) == len(set(roots.values()))


# op4 and op6


def brute_words(given, n=35):
    words = [split(t) for _, t in given]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = Counter()
    for (i, _), w in zip(given, words):
        gone = {j + k for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for k in range(n)}
        out[(i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))] += 1
    return out


def brute_bytes(given, n=50):
    first = {}
    raws = [(-(2**63) if i is None else i, i, (t or "").encode()) for i, t in given]
    for key, _, raw in raws:
        for j in range(len(raw) - n + 1):
            s = raw[j : j + n]
            first[s] = min(key, first.get(s, key))
    out = Counter()
    for key, i, raw in raws:
        keep = [True] * len(raw)
        for j in range(len(raw) - n + 1):
            if first[raw[j : j + n]] < key:
                keep[j : j + n] = [False] * n
        runs = sum(not k and (j == 0 or keep[j - 1]) for j, k in enumerate(keep))
        out[(i, len(raw), keep.count(False), runs, sha(bytes(b for b, k in zip(raw, keep) if k)))] += 1
    return out


def test_remove_repeats(docs, no_docs, spark):
    cols = "doc_id", "n_words", "n_removed", "kept_sha256"
    assert rows(suffix_automaton.remove_repeats(docs), *cols) == brute_words(texts(docs))
    assert suffix_automaton.remove_repeats(no_docs).count() == 0
    rng = np.random.default_rng(1)
    tight = [(i, " ".join(rng.choice(["a", "b"], int(rng.integers(0, 90))))) for i in range(60)]
    df = spark.createDataFrame(tight, "doc_id long, text string").repartition(5)
    for n in (3, 7, 12):
        assert rows(suffix_automaton.remove_repeats(df, length=n), *cols) == brute_words(tight, n)


def test_remove_earlier(docs, no_docs, spark):
    cols = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert rows(run_length_index.remove_earlier(docs), *cols) == brute_bytes(texts(docs))
    assert run_length_index.remove_earlier(no_docs).count() == 0
    rng = np.random.default_rng(2)
    tight = [(i, "".join(rng.choice(["a", "b", "é"], int(rng.integers(0, 120))))) for i in range(50)]
    df = spark.createDataFrame(tight, "doc_id long, text string").repartition(5)
    for n in (6, 9, 16):
        assert rows(run_length_index.remove_earlier(df, length=n), *cols) == brute_bytes(tight, n)


def longest(text, i, passages):
    n = 0
    while n < len(text) - i and any(text[i : i + n + 1] in p for p in passages):
        n += 1
    return n


def test_matching_statistics_of_the_run_length_index():
    rng = np.random.default_rng(7)
    for trial in range(60):
        n = int(rng.choice([2, 5, 8, 9, 30]))
        word = lambda least: bytes(rng.integers(97, 97 + 1 + trial % 3, int(rng.integers(least, n + 30))).astype(np.uint8))
        passages = sorted({word(n) for _ in range(rng.integers(1, 12))})
        owners = rng.integers(0, 5, len(passages))
        index = run_length_index.RunLengthIndex(passages, owners, n)
        read = passages + [word(n) for _ in range(4)]
        for step, who, length, row, at in index.stream(read):
            text = b"\xff".join(passages) + b"\xff"
            for w, got, place in zip(who.tolist(), length.tolist(), at.tolist()):
                start = len(read[w]) - step
                want = longest(read[w], start, passages)
                assert got == want or min(got, want) >= n
                assert text[place : place + min(got, n)] == read[w][start : start + min(got, n)]  # the samples lead to a place that matches
        for text, least in zip(read, index.least_owners(read)):
            for j in range(len(text) - n + 1):
                assert least[j] == min([o for p, o in zip(passages, owners) if text[j : j + n] in p], default=repeats.NOWHERE)
        anchors = np.zeros(len(passages))  # one anchor of many shards
        assert (run_length_index.least_owners(passages, anchors, owners, None, n, shard=20) == run_length_index.least_owners(passages, anchors, owners, None, n)).all()


def test_automaton():
    a = suffix_automaton.SuffixAutomaton(3)
    a.add("abcab")
    a.add("bca")
    assert [n for n, _ in a.stream("xbcabz")] == [0, 1, 2, 3, 3, 0]
    assert a.windows("xbcabz") == [1, 2] and a.windows("bca", seen=True) == []
    assert a.windows("bca", mark=True) == [0] and a.windows("xbcab", seen=True) == [1]


def test_windows_held_elsewhere():
    rng = np.random.default_rng(8)
    for trial in range(60):
        n = 2 + trial % 4
        passages = sorted({b" ".join(bytes([x]) for x in rng.permutation(range(97, 97 + n + 3))[: n + trial % 3].tolist()) for _ in range(8)})
        places = rng.integers(1, 3, len(passages))
        for shard in (5, 1000):
            got = suffix_automaton.held_elsewhere(passages, np.zeros(len(passages)), None, places, n, shard)
            for i, p in enumerate(passages):
                words = p.split()
                for j in range(len(words) - n + 1):
                    held = sum(int(k) for q, k in zip(passages, places) if any(q.split()[x : x + n] == words[j : j + n] for x in range(len(q))))
                    assert (got[i, j] == -1) == (held > 1)


@pytest.mark.parametrize("broadcast", [True, False])
def test_frequent_passages_and_hot_anchors(spark, broadcast):
    """A passage in every document, a line in different surroundings, a null id, and repeats in one document."""
    rng = np.random.default_rng(9)
    line = " ".join(f"licence{i}" for i in range(60))
    head = "          " * 3 + "common opening of many lines "
    given = []
    for i in range(40):
        own = " ".join(f"{x:x}" for x in rng.integers(0, 10**9, 30))
        given.append((None if i == 7 else 100 - i, f"{own} {line} {head}{own} {line if i % 5 == 0 else ''}"))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    assert rows(suffix_automaton.remove_repeats(df, broadcast=broadcast), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(given)
    assert rows(run_length_index.remove_earlier(df, broadcast=broadcast), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(given)


# op5


def test_edits(docs, no_docs):
    got = [r for r in sketch.fingerprint_edits(docs).collect()]
    given = sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for (i, t), (_, x) in zip(given, given[1:] + given[:1]):
        t, x = t or "", x or ""
        h = len(t) // 2
        want[(i, len(t), sha(t[: len(t) - h] + x[:h]))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next", "contained"))
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert sketch.fingerprint_edits(no_docs).count() == 0


def brute_sketch(text):
    """The least 128 hashes, each as XXH64 with the hash before as its seed."""
    words = split(text)
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    spans = [hashes[i : i + 5] for i in range(len(hashes) - 4)] or ([hashes] if hashes else [])
    found = set()
    for span in spans:
        h = 42
        for x in span:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
        found.add(h - (h >> 63 << 64))
    return sorted(found)[:128]


def brute_likeness(a, b):
    union = sorted(set(a) | set(b))[:128]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


@pytest.mark.parametrize("table", ["docs", "real"])
def test_sketches_and_likenesses(docs, spark, table):
    frame = docs if table == "docs" else spark.read.parquet(f"{SF}/documents.parquet")
    given = sorted(texts(frame), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    spelled = lambda s: "".join(f"{h % 2**64:016x}" for h in s)
    for (i, t), (_, x) in zip(given, given[1:] + given[:1]):
        t, x = t or "", x or ""
        h = len(t) // 2
        own, edited, other = brute_sketch(t), brute_sketch(t[: len(t) - h] + x[:h]), brute_sketch(x)
        want[(i, spelled(own), spelled(edited), round(brute_likeness(own, edited), 9), round(brute_likeness(own, other), 9))] += 1
    for size in (16_000_000, 2_000):  # one range, and many with cuts between equal ids
        near = sketch.with_next(frame, sketch.sketch, range_bytes=size)
        assert Counter((r["doc_id"], r["text"], r["next_text"]) for r in near.collect()) == Counter((i, t or "", x or "") for (i, t), (_, x) in zip(given, given[1:] + given[:1]))
    got = sketch.fingerprint_edits(frame).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


def test_sketch_estimates(spark):
    rng = np.random.default_rng(0)
    a = [str(x) for x in rng.integers(0, 10**9, 3000)]
    b = a[:2000] + [str(x) for x in rng.integers(0, 10**9, 1000)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[:3]))], "g int, t string").withColumn("sketch", sketch.sketch(F.col("t")))
    s = {r["g"]: r["sketch"] for r in df.collect()}
    assert len(s[1]) == 128 and s[1] == sorted(s[1]) and len(s[3]) == 1
    one = spark.createDataFrame([(s[1], s[2])], "a array<bigint>, b array<bigint>").select(sketch.resemblance(F.col("a"), F.col("b")), sketch.containment(F.col("a"), F.col("b")), sketch.distinct_shingles(F.col("a"))).first()
    assert abs(one[0] - 0.5) < 0.15 and abs(one[1] - 0.67) < 0.2 and abs(one[2] - 2996) < 900
    whole = sketch.merge_sketches(df.filter("g < 3").withColumn("k", F.lit(1)), "k").first()["sketch"]
    assert whole == sorted(set(s[1]) | set(s[2]))[:128]


# op7, op8, op10


def test_bpe(docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for i, t in texts(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert rows(bpe.encode_decode(docs, BYTES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_decode(no_docs, BYTES).count() == 0


def test_long_words_take_the_same_merges():
    ours, library = tokens.byte_bpe(BYTES), Tokenizer.from_file(BYTES)
    for text in ("aaaa" * 500, "thethethe" * 60, "é" * 999, "\n\n  a \n b\t\tc  ", "x  y", " lead", "it's 12.5%", "ab" * 63, "İΣ ½ ²"):
        assert ours.encode(text) == ours.batch([text]).ids.tolist() == library.encode(text, add_special_tokens=False).ids


def word_pieces(given, end, size=None):
    library = Tokenizer.from_file(WORDS)
    for i, t in given:
        ids = library.encode(t or "", add_special_tokens=False).ids + [end]
        size_ = size or len(ids)
        for k, s in enumerate(range(0, len(ids), size_)):
            yield i, k, s, ids[s : s + size_]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing(docs, no_docs, spark):
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.pack_documents(frame, WORDS).collect()
        want = Counter((i, k, s, len(p), crc(p)) for i, k, s, p in word_pieces(texts(frame), 0, 2048))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in bins.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= 2048
        assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) * 1.02 + 1
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_best_two_fit_improves_on_greedy():
    plans = packing.best_two_fit({7: 1, 2: 1, 1: 0, 3: 0}, 10)
    assert sum(n for _, n in plans) == 1
    rng = np.random.default_rng(4)
    counts = Counter(rng.integers(1, 101, 2000).tolist())
    plans = packing.best_two_fit(counts, 100)
    used = Counter()
    for lengths, n in plans:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in plans) <= sum(k * v for k, v in counts.items()) / 100 * 1.02 + 1


def test_token_files(docs, no_docs, spark, tmp_path):
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        given = sorted(texts(frame), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, start = Counter(), 0
        for i, _, _, ids in word_pieces(given, 2):
            want[(i, start, len(ids), crc(ids))] += 1
            start += len(ids)
        assert rows(token_files.round_trip(frame, WORDS, files=3, frame_tokens=400), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files.round_trip(no_docs, WORDS).count() == 0


def test_only_needed_frames_are_read(spark):
    rng = np.random.default_rng(12)
    given = [(None if i % 97 == 0 else i // 3 * 7, f"text {i} " + "word " * int(rng.integers(0, 40))) for i in range(900)]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    folder = common.new_folder(spark, "tokens")
    manifest = token_files.write_tokens(df, folder, WORDS, files=4, frame_tokens=300)
    every = Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in token_files.read_tokens(spark, folder, manifest, with_ids=True).collect())
    ids = [0, 7, 7 * 100, 7 * 299, 5, None]  # 5 is in no document
    wanted = spark.createDataFrame([(i,) for i in ids + [7]], "doc_id long")
    got = token_files.read_documents(spark, folder, manifest, wanted).collect()
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in got) == Counter({k: n for k, n in every.items() if k[0] in ids})
    assert all(r["frames_read"] <= r["frames"] / 2 for r in got) and sum({(r["start"], r["frames"]): 1 for r in got}.values()) > 0
    store, _ = token_files.open_store(folder)
    with store.open_input_file(manifest[-1][1]) as file:
        reader = token_files.FrameReader(file)
        assert len(reader) > 10 and [i for i, _, _ in reader.find([7 * 299])] == [7 * 299] * 3 and reader.read <= 2
    assert token_files.read_documents(spark, folder, manifest, wanted.filter("doc_id = 5")).count() == 0


def test_frames_are_independent(tmp_path):
    import pyarrow.fs as pafs
    import zstandard

    path = str(tmp_path / "x.zst")
    with open(path, "wb") as f:
        writer = token_files.FrameWriter(f)
        for k in range(3):
            writer.frame(token_files.frame_bytes([k, None], np.arange(5, dtype=np.uint32) + k, [2, 3]))
        writer.close()
    with pafs.LocalFileSystem().open_input_file(path) as f:
        reader = token_files.FrameReader(f)
        assert [(i, p.tolist()) for i, p in reader.documents(1)] == [(1, [1, 2]), (None, [3, 4, 5])]
    data = bytearray(open(path, "rb").read())
    assert zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read(10**6)
    data[reader.at[1] - 1] ^= 1
    open(path, "wb").write(bytes(data))
    with pafs.LocalFileSystem().open_input_file(path) as f, pytest.raises(Exception):
        token_files.FrameReader(f).raw(0)


# op9


def test_language(docs, no_docs, spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit(9))
    learned = language.train(real.filter(~language.held_out()))
    got = language.predict(real, learned)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    held = got.filter(language.held_out())
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    odd = {r["doc_id"]: r for r in language.predict(docs.select("doc_id", "text"), learned).collect()}
    assert odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[6]["lang_pred"] == "und" and odd[4]["score"] == 0
    assert language.predict(no_docs, learned).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def test_language_against_brute_force(spark):
    """Prototypes, predictions and scores computed one trigram at a time."""
    real = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000 or text is null").select("doc_id", "text", "lang")
    given = real.collect()

    def grams(text):
        letters = ""
        for c in f" {text or ''} ":
            low = c.lower() if len(c.lower()) == 1 else c
            letters += low if regex.match(r"\p{L}", c) else " "
        letters = regex.sub(" +", " ", letters)
        return Counter(g for g in (letters[i : i + 3] for i in range(len(letters) - 2)) if g.strip() and not (g[1] == " " and " " in (g[0], g[2])))

    def vector(counts):
        out = np.zeros(language.DIMENSIONS)
        for g, n in counts.items():
            a, b, c = (language.letter_vector(ord(x), language.DIMENSIONS) for x in g)
            out += n * (np.roll(a, 2) * np.roll(b, 1) * c).astype(float)
        return out

    sums = {}
    for r in given:
        if r["text"] and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            sums[r["lang"]] = sums.get(r["lang"], Counter()) + grams(r["text"])
    protos = {k: vector(v) for k, v in sums.items()}
    protos = {k: v / np.linalg.norm(v) for k, v in protos.items()}
    found = {r["doc_id"]: r for r in language.predict(real, language.train(real.filter(~language.held_out()))).collect()}
    for r in given:
        counts = grams(r["text"])
        v = vector(counts)
        cos = {k: float(p @ v) / np.linalg.norm(v) if counts else 0.0 for k, p in protos.items()}
        best = max(sorted(cos), key=cos.get)
        got = found[r["doc_id"]]
        assert abs(got["score"] - min(1, max(0, cos[best]))) < 1e-4
        assert got["lang_pred"] == best if counts else got["lang_pred"] == "und"


def test_language_stage_rejects_junk(spark):
    import corpus_pipeline

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(13)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    junk = [(10**9 + i, "".join(rng.choice(letters, n)), None, "junk", n) for i, n in enumerate([40, 80, 200, 400, 1000, 3000] * 10)]
    junk += [(2 * 10**9, "12 34 -- 56", None, "junk", 11), (2 * 10**9 + 1, "Это русский текст о погоде", None, "junk", 26), (2 * 10**9 + 2, None, None, "junk", 0)]
    clean = real.filter("lang is not null and length(text) > 200")
    label = real.filter("lang = 'fr' and length(text) > 500").limit(1).select(F.lit(3 * 10**9).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    kept = corpus_pipeline.known_language(spark, clean.unionByName(spark.createDataFrame(junk, clean.schema)).unionByName(label), SF).collect()
    ids = {r["doc_id"] for r in kept}
    assert len([j for j in junk if j[0] in ids]) <= 0.02 * len(junk)
    assert sum(r["doc_id"] < 10**9 for r in kept) >= 0.999 * clean.count()
    assert {r["lang"] for r in kept if r["doc_id"] == 3 * 10**9} == {"fr"}


def test_trigrams():
    of, keys, counts = language.trigrams(["Ab-ab!", None, "", "é"])
    spelled = sorted((int(o), "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)), int(c)) for o, k, c in zip(of, keys.tolist(), counts))
    assert spelled == [(0, " ab", 2), (0, "ab ", 2), (0, "b a", 1), (3, " é ", 1)]


# pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r["doc_id"] for r in now.collect()}
    assert 4 not in ids and 2 not in ids and {1, 7, 9} <= ids
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["op1_perspective_rotation", "op4_suffix_automata", "op6_run_length_bwt"])
def test_query_against_sql(spark, name):
    import duckdb

    from tradeloom.llm import queries

    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"create view {file[:-8]} as select * from '{SF}/{file}'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())
    assert set(queries.SQL) == {"op1_perspective_rotation", "op4_suffix_automata", "op6_run_length_bwt"}
