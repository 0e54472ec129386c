"""Exact repeated passages of a whole corpus, found through content-chosen anchors.

A window is L symbols (words or bytes) of one document. The least hash of its k-symbol grams is its anchor, so all
occurrences of a window have the same anchor at the same place. A window can only repeat if its anchor does. So:

1. anchors: every document gives its anchors (about 2 in L - k + 2 symbols); those that occur twice are kept,
2. passages: the windows of a kept anchor lie in one run, a passage; its text moves once a block, its places beside it,
3. an index over the passages of a shard of anchors decides which windows repeat (the operators' own methods):
   each different passage streams against it, and what its matching statistics say holds for all its places,
4. spans: each document gets its repeated windows back.

Anchors only choose what is compared: grams with equal hashes cost time, not correctness, and no window is judged by
them. Passages that many documents share would meet in one task, so the most frequent ones (HOT_PASSAGES at most, of
HOT_BYTES bytes at most each, so their index has a size bound) are found on the way in step 1, and an index of them is
broadcast: documents stream against it in step 2, and the windows it decides are told at once, without moving.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, chunks, cut, key_of, parts, trim

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = 600_000  # characters that a task works on at once, at some 100 bytes each
FLUSH_ANCHORS = 500_000
FLUSH_BYTES = 12_000_000
OFTEN = 3  # equal passages in a chunk that may be among the most frequent ones
HOT_PASSAGES = 1000
HOT_BYTES = 2000
NOWHERE = 2**63 - 1
KNOWN = np.uint32(1 << 31)

_POWERS: list[np.ndarray] = []


def _powers(n: int):
    if not _POWERS or len(_POWERS[0]) < n:
        steps = [np.full(max(n, 1 << 20), x, dtype=np.uint64) for x in (BASE, BASE_INVERSE)]
        for s in steps:
            s[0] = 1
        _POWERS[:] = [np.cumprod(s) for s in steps]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k symbols in a row."""
    up, down = _powers(len(x))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up)])
    return _mix((sums[k:] - sums[:-k]) * down[: len(x) - k + 1])


def anchor_runs(x: np.ndarray, doc: np.ndarray, length: int, k: int):
    """(anchor position, its hash, first and last start of the windows it stands for), for windows within a document."""
    n = len(x) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, np.zeros(0, np.uint64), none, none
    h = gram_hashes(x, k)
    least = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    w, size = length - k + 1, 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: size - w], least[w - size :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.flatnonzero(doc[:n] == doc[length - 1 :])
    if not len(ok):
        return none, np.zeros(0, np.uint64), none, none
    at = at[ok]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(ok)]]) - 1
    return at[new], h[at[new]], ok[new], ok[last]


_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Bytes:
    """The texts' UTF-8 bytes as symbols."""

    def __init__(self, texts):
        raw = [(t or "").encode() for t in texts]
        self.data = b"".join(raw)
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes  # the first symbol of each document
        self.doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        self.codes = _BYTE_CODES[np.frombuffer(self.data, np.uint8)]

    def spans(self, a, b):
        """Byte ranges of symbols a to b, both included."""
        return a, b + 1


class Words:
    """The texts' words, split at ASCII white space, as symbols; their bytes are joined by one space."""

    def __init__(self, texts):
        lines = [b" ".join((t or "").encode().split()) for t in texts]
        self.data = b"\n".join(lines)
        raw = np.frombuffer(self.data, np.uint8)
        gap = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        self.a, self.b = edge[0::2], edge[1::2]
        ends = np.cumsum([len(line) + 1 for line in lines])
        self.doc = np.searchsorted(ends, self.a, side="right").astype(np.int32)
        self.first = np.searchsorted(self.doc, np.arange(len(lines)))
        up, down = _powers(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODES[raw] * up[: len(raw)])])
        self.codes = _mix((sums[self.b] - sums[self.a]) * down[self.a] + (self.b - self.a).astype(np.uint64))

    def spans(self, a, b):
        return self.a[a], self.b[b]


def _groups(sorted_values: np.ndarray):
    """Bounds of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def shards(h, sizes: np.ndarray, most: int):
    """(lo, hi, first, end): an index over the passages lo to hi - 1 is for the passages first to end - 1.

    Passages stand together by anchor (h). A shard is of whole anchors, of `most` symbols or little more; one anchor
    with more than that has several, and all its passages are read against each.
    """
    edges, lo, size = _groups(np.asarray(h)).tolist(), 0, 0
    for a, b in zip(edges[:-1], edges[1:]):
        own = int(sizes[a:b].sum())
        if size and size + own > most:
            yield lo, a, lo, a
            lo, size = a, 0
        if own > most:
            at = a
            while at < b:
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:b]), most, side="right")))
                yield at, min(to, b), a, b
                at = to
            lo, size = b, 0
        else:
            size += own
    if size:
        yield lo, edges[-1], lo, edges[-1]


def _reply(schema, homes: int, did: np.ndarray, *data: np.ndarray, tag: np.ndarray | None = None) -> pa.RecordBatch:
    """What belongs to documents, as a block for each home (a hash of the doc_id); data: arrays that go side by side."""
    home = _home(did, homes)
    order = np.lexsort((did, home))
    home, did = home[order], did[order]
    bounds = _groups(home)
    block = np.stack([d[order] for d in data], axis=1).astype(np.uint32)
    cols = {"home": pa.array(home[bounds[:-1]].astype(np.int32)), "did": blobs(_steps(did, bounds), bounds), "at": blobs(block.reshape(-1), bounds * len(data))}
    if tag is not None:
        cols["tag"] = blobs(tag[order], bounds)
    if "bucket" in schema:
        cols["bucket"] = cols["home"]
    return _record(schema, cols, len(bounds) - 1)


def _home(did: np.ndarray, homes: int) -> np.ndarray:
    return (_mix(did.astype(np.uint64) * BASE) >> np.uint64(8)) % np.uint64(homes)


def _steps(did: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Differences, each block from its own first: small numbers, which compress well."""
    steps = np.diff(did, prepend=0)
    steps[bounds[:-1]] = did[bounds[:-1]]
    return steps


def _stepped(column) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(b, "<i8")) for b in column.to_pylist()])


def _gather(width: int):
    """For a home: a row for each document (and text tag, where there is one) with all that belongs to it."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("home")[0].as_py() == HOT:  # the most frequent passages, without a document
            best = _hottest(zip(table.column("at").to_pylist(), table.column("did").to_pylist()))
            rows = [struct.pack("<qqQ", *f) + t for t, f in best.items()]
            return pa.table({"doc_id": pa.nulls(len(rows), pa.int64()), "at": pa.array(rows, pa.binary())})
        did = _stepped(table.column("did"))
        data = np.frombuffer(b"".join(table.column("at").to_pylist()), "<u4").reshape(-1, width)
        tagged = "tag" in table.column_names
        tag = np.frombuffer(b"".join(table.column("tag").to_pylist()), "<i8") if tagged else np.zeros(len(did), np.int64)
        order = np.lexsort((tag, did))
        did, tag, data = did[order], tag[order], data[order]
        bounds = np.unique(np.concatenate([_groups(did), _groups(tag)]))
        cols = {"doc_id": pa.array(did[bounds[:-1]]), "tag": pa.array(tag[bounds[:-1]]), "at": blobs(data.reshape(-1), bounds * width)}
        return pa.table({c: cols[c] for c in (["doc_id", "tag", "at"] if tagged else ["doc_id", "at"])})

    return run


def _record(schema: dict[str, pa.DataType], cols: dict, n: int) -> pa.RecordBatch:
    arrays = [cols[c] if cols.get(c) is not None else pa.nulls(n, t) for c, t in schema.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def _ddl(schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{c} {names[t]}" for c, t in schema.items())


ANCHOR = {"bucket": pa.int32(), "home": pa.int32(), "did": pa.binary(), "at": pa.binary(), "h": pa.binary()}
FOUND = {"home": pa.int32(), "did": pa.binary(), "at": pa.binary()}
PASSAGE = {"bucket": pa.int32(), "home": pa.int32(), "did": pa.binary(), "tag": pa.binary(), "at": pa.binary(), "facts": pa.binary(), "data": pa.binary()}
SPAN = {"home": pa.int32(), "did": pa.binary(), "tag": pa.binary(), "at": pa.binary()}
FACTS = [("h", "<u8"), ("did", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("windows", "<u4"), ("size", "<u4")]  # size 0: the text of the passage before
HOT = -1  # the home of frequent passages


def _packed(facts: np.ndarray) -> bytes:
    """Column by column, which compresses well."""
    raw = b"".join(np.ascontiguousarray(facts[c]).tobytes() for c, _ in FACTS)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(blocks) -> np.ndarray:
    out = []
    for b in blocks:
        raw, at = zstandard.ZstdDecompressor().decompress(b), 0
        n = len(raw) // np.dtype(FACTS).itemsize
        part = np.empty(n, FACTS)
        for c, t in FACTS:
            part[c] = np.frombuffer(raw, t, n, at)
            at += n * np.dtype(t).itemsize
        out.append(part)
    return np.concatenate(out)


def _frequent(found: dict, s, p, h, j0, j1, length, dids) -> None:
    """Count the passages that stand OFTEN times or more in this chunk: text to (times, least document, anchor's hash)."""
    order = np.argsort(h, kind="stable")
    bounds = _groups(h[order])
    for g in np.flatnonzero(np.diff(bounds) >= OFTEN).tolist():
        mine = order[bounds[g] : bounds[g + 1]]
        x, y = s.spans(j0[mine], j1[mine] + length - 1)
        here: dict[bytes, list[int]] = {}
        for u, v, i in zip(x.tolist(), y.tolist(), mine.tolist()):
            if v - u <= HOT_BYTES:
                here.setdefault(s.data[u:v], []).append(i)
        for t, places in here.items():
            if len(places) >= OFTEN:
                n, least, _ = found.get(t, (0, NOWHERE, 0))
                found[t] = (n + len(places), min(least, min(dids[s.doc[p[i]]] for i in places)), int(h[mine[0]]))
    if len(found) > 4 * HOT_PASSAGES:
        for t in sorted(found, key=lambda t: (-found[t][0], t))[2 * HOT_PASSAGES :]:
            del found[t]


def _told_hot(found: dict, buckets: int) -> pa.RecordBatch:
    best = sorted(found, key=lambda t: (-found[t][0], t))[:HOT_PASSAGES]
    bucket = pa.array([xxhash.xxh64_intdigest(t) % buckets for t in best], pa.int32())
    facts = [struct.pack("<qqQ", *found[t]) for t in best]
    return _record(ANCHOR, {"bucket": bucket, "home": pa.array([HOT] * len(best), pa.int32()), "did": pa.array(facts, pa.binary()), "h": pa.array(best, pa.binary())}, len(best))


def _hottest(rows, most: int = HOT_PASSAGES) -> dict:
    """Sums of the counts of (text, facts) rows; the most frequent texts."""
    found: dict = {}
    for t, f in rows:
        n, least, h = struct.unpack("<qqQ", f)
        m, other, _ = found.get(t, (0, NOWHERE, 0))
        found[t] = (n + m, min(least, other), h)
    return {t: found[t] for t in sorted(found, key=lambda t: (-found[t][0], t))[:most]}


def _find(kind, length, k, buckets, homes):
    """Task of step 1: its anchors, each hash once, by bucket; where one occurs twice here, its documents are told at once."""

    def run(batches):
        held, n, hot = [], 0, {}

        def flush():
            nonlocal held, n
            if not n:
                return
            h, did, pos = (np.concatenate(x) for x in zip(*held))
            held, n = [], 0
            order = np.argsort(h, kind="stable")
            h, did, pos = h[order], did[order], pos[order]
            bounds = _groups(h)
            many = np.diff(bounds) > 1
            known = np.repeat(many, np.diff(bounds))
            if known.any():
                yield _reply(ANCHOR, homes, did[known], pos[known])
            first = bounds[:-1]
            h, did, pos = h[first], did[first], pos[first] | np.where(many, KNOWN, np.uint32(0))
            bucket = ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((did, bucket))
            h, did, pos, bucket = h[order], did[order], pos[order], bucket[order]
            bounds = _groups(bucket)
            yield _record(ANCHOR, {"bucket": pa.array(bucket[bounds[:-1]]), "at": blobs(pos, bounds), "h": blobs(h, bounds), "did": blobs(_steps(did, bounds), bounds)}, len(bounds) - 1)

        for ids, texts in chunks(batches, ["doc_id", "text"], CHUNK):
            s = kind(texts)
            p, h, j0, j1 = anchor_runs(s.codes, s.doc, length, k)
            of = s.doc[p]
            _frequent(hot, s, p, h, j0, j1, length, ids)
            held.append((h, np.array(ids, dtype=np.int64)[of], (p - s.first[of]).astype(np.uint32)))
            n += len(p)
            if n >= FLUSH_ANCHORS:
                yield from flush()
        yield from flush()
        if hot:
            yield _told_hot(hot, buckets)
        s = None
        trim()

    return run


def _match(homes, hot_share):
    """Step 1 for a bucket: documents and places of the anchors that occur twice, and its hot_share most frequent passages."""

    def run(table: pa.Table) -> pa.Table:
        told = table.filter(pa.compute.greater_equal(table.column("home"), 0)).select(list(FOUND))
        hot = table.filter(pa.compute.less(table.column("home"), 0))
        blocks = table.filter(pa.compute.is_null(table.column("home")))
        out = [told]
        if hot.num_rows:
            best = _hottest(zip(hot.column("h").to_pylist(), hot.column("did").to_pylist()), hot_share)
            cols = {"home": pa.array([HOT] * len(best), pa.int32()), "did": pa.array([struct.pack("<qqQ", *f) for f in best.values()], pa.binary()), "at": pa.array(list(best), pa.binary())}
            out.append(pa.Table.from_batches([_record(FOUND, cols, len(best))]))
        if blocks.num_rows:
            h = np.frombuffer(b"".join(blocks.column("h").to_pylist()), "<u8")
            did = _stepped(blocks.column("did"))
            pos = np.frombuffer(b"".join(blocks.column("at").to_pylist()), "<u4")
            order = np.argsort(h, kind="stable")
            h, did, pos = h[order], did[order], pos[order]
            bounds = _groups(h)
            sizes = np.diff(bounds)
            marked = np.add.reduceat((pos & KNOWN) > 0, bounds[:-1])
            take = np.repeat((sizes > 1) | (marked > 0), sizes) & ((pos & KNOWN) == 0)
            if take.any():
                out.append(pa.Table.from_batches([_reply(FOUND, homes, did[take], pos[take])]))
        return pa.concat_tables([t.cast(pa.schema(list(FOUND.items()))) for t in out])

    return run


def _places(blob, width=1) -> np.ndarray:
    """The blob of one document as an array of rows."""
    return np.frombuffer(blob, "<u4").reshape(-1, width).astype(np.int64)


class Hot:
    """The most frequent passages, and by whom; the index of them that decide() makes is what is broadcast."""

    def __init__(self, rows, make):
        found = _hottest((r[24:], r[:24]) for r in rows)
        texts = sorted(found, key=lambda t: (found[t][2], t))
        self.anchors = np.unique(np.array([found[t][2] for t in texts], np.uint64))
        self.judge = make(texts, np.array([found[t][1] for t in texts], np.int64), np.array([found[t][0] for t in texts])) if texts else None


def _marked(least: np.ndarray, windows: np.ndarray, did: np.ndarray, across: bool):
    """(place, first window, windows) of the repeated windows; least: for each place and window, by whom it is held elsewhere."""
    bound = did[:, None] if across else NOWHERE
    return windows_to_runs((least < bound) & (np.arange(least.shape[1]) < windows[:, None]))


def _passages(kind, length, k, buckets, homes, across, hot):
    """Task of step 2: the passages of kept anchors by bucket; those that the broadcast index decides whole are told at once."""

    def run(batches):
        held: list = []
        size = 0

        def flush():
            nonlocal held, size
            if not held:
                return
            facts = np.concatenate([f for f, _ in held])
            texts = [t for _, ts in held for t in ts]
            held, size = [], 0
            number: dict[bytes, int] = {}
            of = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
            bucket = ((facts["h"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
            if hot is not None:
                facts, of, bucket, told = settle(facts, of, bucket, list(number))
                if told is not None:
                    yield told
            order = np.lexsort((facts["did"], of, facts["h"], bucket))
            facts, of, bucket = facts[order], of[order], bucket[order]
            bounds = _groups(bucket)
            facts["size"][1:][(of[1:] == of[:-1]) & (bucket[1:] == bucket[:-1])] = 0
            names = list(number)
            pack = zstandard.ZstdCompressor(level=3).compress
            blocks = list(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if len(facts) else []
            joined = [pack(b"".join([names[i] for i in of[a:b][facts["size"][a:b] > 0].tolist()])) for a, b in blocks]
            yield _record(PASSAGE, {"bucket": pa.array([bucket[a] for a, _ in blocks], pa.int32()), "facts": pa.array([_packed(facts[a:b]) for a, b in blocks], pa.binary()), "data": pa.array(joined, pa.binary())}, len(blocks))

        def settle(facts, of, bucket, names):
            """What the broadcast index says of the passages with its anchors; those with an open window go on."""
            warm = np.flatnonzero(np.isin(facts["h"], hot.value.anchors))
            if not len(warm):
                return facts, of, bucket, None
            which, back = np.unique(of[warm], return_inverse=True)
            least = hot.value.judge([names[i] for i in which.tolist()])[back]
            place, first, count = _marked(least, facts["windows"][warm], facts["did"][warm], across)
            f = facts[warm[place]]
            told = _reply(PASSAGE, homes, f["did"], f["start"] + first, count, tag=f["tag"]) if len(place) else None
            done = np.zeros(len(facts), bool)
            done[warm[np.bincount(place, count, len(warm)) == facts["windows"][warm]]] = True
            # one place of each passage stays, for what else holds its windows; across: the first document's
            order = np.lexsort((facts["did"], of))
            done[order[_groups(of[order])[:-1]]] = False
            return facts[~done], of[~done], bucket[~done], told

        for ids, tags, at, texts in chunks(batches, ["doc_id", "tag", "at", "text"], CHUNK):
            s = kind(texts)
            p, h, j0, j1 = anchor_runs(s.codes, s.doc, length, k)
            of = s.doc[p].astype(np.int64)
            wanted = [_places(a)[:, 0] + (i << 32) for i, a in enumerate(at)]
            keep = np.isin((of << 32) + p - s.first[of], np.concatenate(wanted))
            of, h, j0, j1 = of[keep], h[keep], j0[keep], j1[keep]
            a, b = s.spans(j0, j1 + length - 1)
            facts = np.zeros(len(h), FACTS)
            facts["h"], facts["did"], facts["tag"] = h, np.array(ids, np.int64)[of], np.array(tags, np.int64)[of]
            facts["start"], facts["windows"], facts["size"] = j0 - s.first[of], j1 - j0 + 1, b - a
            held.append((facts, [s.data[x:y] for x, y in zip(a.tolist(), b.tolist())]))
            size += int((b - a).sum()) + 100 * len(h)
            if size >= FLUSH_BYTES:
                yield from flush()
        yield from flush()
        s = None
        trim()

    return run


def _judge(decide, across, homes):
    """Step 3 for a bucket: decide(passages, anchors, owners, places) gives the least holder of each window of each different passage."""

    def run(table: pa.Table) -> pa.Table:
        told = table.filter(pa.compute.is_valid(table.column("home"))).select(list(SPAN))
        blocks = table.filter(pa.compute.is_null(table.column("home")))
        out = [told.cast(pa.schema(list(SPAN.items())))]
        if blocks.num_rows:
            facts = _unpacked(blocks.column("facts").to_pylist())
            data = b"".join(map(zstandard.ZstdDecompressor().decompress, blocks.column("data").to_pylist()))
            own = np.flatnonzero(facts["size"])
            ends = np.cumsum(facts["size"][own].astype(np.int64))
            number: dict[bytes, int] = {}
            of = np.fromiter((number.setdefault(data[b - n : b], len(number)) for b, n in zip(ends.tolist(), facts["size"][own].tolist())), np.int64, len(own))
            del data
            of = np.repeat(of, np.diff(np.append(own, len(facts))))
            order = np.lexsort((facts["did"], of))
            bounds = _groups(of[order])
            lead = order[bounds[:-1]]  # of each different passage, the place in the first document
            places = np.diff(bounds)
            turn = np.argsort(facts["h"][lead], kind="stable")
            names = list(number)
            least = decide([names[i] for i in turn.tolist()], facts["h"][lead[turn]], facts["did"][lead[turn]], places[turn])
            del names, number
            trim()
            at = np.empty(len(lead), np.int64)
            at[turn] = np.arange(len(turn))
            for a in range(0, len(facts), 100_000):
                some = facts[a : a + 100_000]
                place, first, count = _marked(least[at[of[a : a + 100_000]]], some["windows"], some["did"], across)
                if len(place):
                    f = some[place]
                    out.append(pa.Table.from_batches([_reply(SPAN, homes, f["did"], f["start"] + first, count, tag=f["tag"])]))
        return pa.concat_tables(out)

    return run


def windows_to_runs(marks: np.ndarray):
    """(row, first column, columns) of the runs of true values in a matrix, by row."""
    edges = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    return row, first, end - first


def keep_mask(n: int, lists, length: int) -> np.ndarray:
    """Which of n symbols no repeated window covers."""
    change = np.zeros(n + 1, dtype=np.int64)
    if lists:
        spans = _places(lists, 2)
        np.add.at(change, spans[:, 0], 1)
        np.add.at(change, spans[:, 0] + spans[:, 1] + length - 1, -1)
    return np.cumsum(change[:-1]) == 0


def repeated_windows(docs: DataFrame, kind, length: int, k: int, decide, make, across: bool, broadcast: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, tag, id, text) and, for those with any, (doc_id, tag, at): blobs of (start, windows) pairs.

    doc_id is a key without nulls and tag a hash of the text: rows with equal ids and texts share their spans.
    make(passages, owners, places) is the index of the most frequent passages, which is broadcast; without it all windows
    are decided in step 3, with the same result.
    """
    spark = docs.sparkSession
    buckets, homes = 2 * parts(spark), parts(spark)
    texts = docs.withColumn("id", F.col("doc_id")).withColumn("doc_id", key_of()).withColumn("tag", F.xxhash64("text"))
    anchors = texts.select("doc_id", "text").mapInArrow(_find(kind, length, k, buckets, homes), _ddl(ANCHOR))
    matched = anchors.groupBy("bucket").applyInArrow(_match(homes, max(8, 4 * HOT_PASSAGES // buckets)), _ddl(FOUND))
    kept = cut(matched.groupBy("home").applyInArrow(_gather(1), "doc_id long, at binary"))
    hot = None
    if broadcast:
        rows = kept.filter("doc_id is null").limit(HOT_PASSAGES).collect()  # as many at most, of HOT_BYTES and 24 bytes each
        found = Hot([bytes(r["at"]) for r in rows], make)
        hot = spark.sparkContext.broadcast(found) if found.judge else None
    chosen = texts.select("doc_id", "tag", "text").join(kept.filter("doc_id is not null"), "doc_id").select("doc_id", "tag", "at", "text")
    passages = chosen.mapInArrow(_passages(kind, length, k, buckets, homes, across, hot), _ddl(PASSAGE))
    judged = passages.groupBy("bucket").applyInArrow(_judge(decide, across, homes), _ddl(SPAN))
    return texts, cut(judged.groupBy("home").applyInArrow(_gather(2), "doc_id long, tag long, at binary"))
