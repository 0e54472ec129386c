"""Suffix-array dedup of bytes by a run-length compressed Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, documents
from .repeats import NOWHERE, Bytes, keep_mask, repeated_windows, shards

WINDOW = 50
GRAM = 24
SHARD_BYTES = 250_000
SEPARATOR = 0xFF  # no byte of UTF-8


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 on; equal keys rank equal."""
    order = np.argsort(keys)
    new = np.empty(len(keys), np.int64)
    now = keys[order]
    new[order] = np.cumsum(np.concatenate([[0], now[1:] != now[:-1]]))
    return new


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of passages, with suffix positions sampled at both ends of each run.

    Passages are laid end to end, each with a separator behind it. A suffix reaches to its passage's separator; equal
    ones stand in the order of their passages. Of the rows that agree in their first `length` bytes, a class, the
    least owner is kept. Ranks of the suffixes by their first 8, 24, 72, ... bytes tell how far two places agree.
    """

    def __init__(self, passages: list[bytes], owners: np.ndarray, length: int):
        end = bytes([SEPARATOR])
        text = np.frombuffer(end.join(passages) + end, np.uint8)
        sizes = np.array([len(p) + 1 for p in passages])
        n, self.length, self.n = len(text), length, len(text)
        stop = np.repeat(np.cumsum(sizes), sizes)  # behind the separator
        room = stop - np.arange(n)
        key = np.zeros(n, np.uint64)
        padded = np.concatenate([text, np.full(8, SEPARATOR, np.uint8)]).astype(np.uint64)
        for i in range(8):
            key |= np.where(room > i, padded[i : n + i], np.uint64(SEPARATOR)) << np.uint64(8 * (7 - i))
        self.key = key
        self.levels = [(8, _ranks(key))]
        wide = 3 if n < 1 << 20 else 2


        def joined(have, rank, steps):
            joint = rank
            for step in range(1, steps):
                later = np.zeros(n, np.int64)
                later[: max(0, n - have * step)] = rank[have * step :] + 1
                later[room <= have * step] = 0
                joint = joint * (n + 1) + later
            return joint

        while 2 * (have := self.levels[-1][0]) < sizes.max():
            self.levels.append((have * wide, _ranks(joined(*self.levels[-1], wide))))
        last = joined(*self.levels[-1], 2)
        order = np.argsort((last if wide == 3 else _ranks(last)) * n + np.arange(n))
        bwt = text[order - 1]  # before a passage stands a separator
        change = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        new = np.flatnonzero(change)
        last = np.append(new[1:], n) - 1
        self.starts, self.ends, self.heads = new, last, bwt[new].astype(np.int64)
        self.run = np.cumsum(change, dtype=np.int32) - 1  # of each row
        self.first_sample, self.last_sample = order[new], order[last]
        turn = np.argsort(bwt[new], kind="stable")
        self.by_head = self.heads[turn] * len(new) + turn  # runs by their byte
        lengths = last - new + 1
        before = np.cumsum(lengths[turn]) - lengths[turn]
        jump = np.empty(len(new), np.int64)
        jump[turn] = before  # all smaller bytes, then this byte's earlier runs: where the run's rows go to
        self.shift = jump - new
        # classes of rows with equal first `length` bytes
        edge = np.concatenate([[True], ~self._agree(order[1:], order[:-1])])
        edges = np.flatnonzero(edge)
        self.least = np.repeat(np.minimum.reduceat(np.repeat(owners, sizes)[order], edges), np.diff(np.append(edges, n)))  # of each row's class

    def _agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the suffixes at i and j agree in their first `length` bytes."""
        same, at = np.ones(len(i), bool), 0
        for have, rank in reversed(self.levels):
            while at + have <= self.length:
                a, b = np.minimum(i + at, self.n - 1), np.minimum(j + at, self.n - 1)
                same &= rank[a] == rank[b]
                at += have
        if rest := self.length - at:
            a, b = np.minimum(i + at, self.n - 1), np.minimum(j + at, self.n - 1)
            same &= (self.key[a] ^ self.key[b]) >> np.uint64(8 * (8 - rest)) == 0
        return same

    def agreement(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at i and j have in common, or some number of `length` or more if it is so many."""
        i, j, most = i.copy(), j.copy(), self.n - 1
        total, live = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for have, rank in reversed(self.levels):
            if have > self.length:
                continue
            for _ in range(3):
                same = live & (total < self.length) & (rank[np.minimum(i + total, most)] == rank[np.minimum(j + total, most)])
                if not same.any():
                    break
                total[same] += have
        apart = self.key[np.minimum(i + total, most)] ^ self.key[np.minimum(j + total, most)]
        few = np.zeros(len(i), np.int64)
        for b in range(1, 8):
            few += apart >> np.uint64(8 * (8 - b)) == 0
        return total + few

    def stream(self, passages: list[bytes]):
        """Matching statistics: (step, passages still running, match length, row), reading all passages from their ends.

        After a step a passage's match length is that of its longest start, from the place reached on, that the index
        holds; the row is one of its places. Where the row's run is not of the next byte, the nearest runs of it on
        both sides are the candidates, and their end samples say which of them agrees further.
        """
        sizes = np.array([len(p) for p in passages])
        data = np.frombuffer(b"".join(passages), np.uint8).astype(np.int64)
        tails = np.cumsum(sizes)
        order = np.argsort(-sizes, kind="stable")
        sizes, tails, widths = sizes[order], tails[order], np.sort(sizes)
        row = np.zeros(len(order), np.int64)
        at = np.full(len(order), self.first_sample[0])
        length = np.zeros(len(order), np.int64)
        runs = len(self.starts)
        for step in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            live = len(order) - int(np.searchsorted(widths, step))
            row, at, length = row[:live], at[:live], length[:live]
            symbol = data[tails[:live] - step]
            run = self.run[row]
            off = np.flatnonzero(self.heads[run] != symbol)
            if len(off):
                c, place = symbol[off], length[off]
                k = np.searchsorted(self.by_head, c * runs + run[off])
                up, down = np.maximum(k - 1, 0), np.minimum(k, runs - 1)
                up_run, down_run = self.by_head[up], self.by_head[down]
                has_up, has_down = (k > 0) & (up_run // runs == c), (k < runs) & (down_run // runs == c)
                up_run, down_run = up_run % runs, down_run % runs
                here = at[off]
                near_up = np.where(has_up, np.minimum(place, self.agreement(here, self.last_sample[up_run])), -1)
                near_down = np.where(has_down, np.minimum(place, self.agreement(here, self.first_sample[down_run])), -1)
                upward = near_up >= near_down
                best = np.where(upward, near_up, near_down)
                got = best >= 0
                run[off] = np.where(got, np.where(upward, up_run, down_run), run[off])
                row[off] = np.where(got, np.where(upward, self.ends[up_run], self.starts[down_run]), row[off])
                at[off] = np.where(got, np.where(upward, self.last_sample[up_run], self.first_sample[down_run]), here)
                length[off] = best
            move = length >= 0
            row, at, length = np.where(move, row + self.shift[run], row), np.where(move, at - 1, at), length + 1
            yield step, order[:live], length, row, at

    def least_owners(self, passages: list[bytes]) -> np.ndarray:
        """For each passage and window of it, the least owner of its `length` bytes in the index, else NOWHERE."""
        widest = max(map(len, passages))
        out = np.full((len(passages), max(0, widest - self.length) + 1), NOWHERE)
        sizes = np.array([len(p) for p in passages])
        for step, who, length, row, _ in self.stream(passages):
            if step >= self.length:
                hit = np.flatnonzero(length >= self.length)
                out[who[hit], sizes[who[hit]] - step] = self.least[row[hit]]
        return out


def least_owners(passages: list[bytes], h, owners, weight, length: int = WINDOW, shard: int = SHARD_BYTES) -> np.ndarray:
    """For each passage and window, the least document among the passages of its anchor that holds the window."""
    out = np.full((len(passages), max(map(len, passages)) - length + 1), NOWHERE)
    for lo, hi, first, end in shards(h, np.array([len(p) for p in passages]), shard):
        index = RunLengthIndex(passages[lo:hi], owners[lo:hi], length)
        got = index.least_owners(passages[first:end])
        part = out[first:end, : got.shape[1]]
        np.minimum(part, got, out=part)
    return out


def _make(length: int):
    """The index that is broadcast, of one shard."""

    def make(passages, owners, places):
        return RunLengthIndex(passages, owners, length).least_owners

    return make


def remove_earlier(docs: DataFrame, doc_id="doc_id", text="text", length: int = WINDOW, with_text=False, carry=(), broadcast=True) -> DataFrame:
    """Every byte covered by a string of `length` bytes that also starts in a document of a smaller doc_id is removed.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes left, for every document;
    with_text adds them as kept, without the parts of a letter that a cut may leave; columns in carry pass through. Null and empty texts have no bytes;
    a null doc_id comes before all others; rows of one doc_id remove nothing from each other; a text of any length
    is whole and no match crosses documents. An empty table gives no row. Strings are judged on the input. The id
    -2**63 stands for null: a document with it counts as one without an id. broadcast: whether documents stream
    against an index of the most frequent passages first; the rows are the same.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    texts, spans = repeated_windows(plain, Bytes, length, min(GRAM, length), lambda *x: least_owners(*x, length), _make(length), True, broadcast)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "carry"]
    carried = to_arrow_type(plain.schema["carry"].dataType)

    def finish(batches):
        for ids, at, with_, rows in chunks(batches, ["id", "at", "carry", "text"]):
            out = []
            for i, lists, w, t in zip(ids, at, with_, rows):
                raw = (t or "").encode()
                gone, runs, kept = 0, 0, raw
                if lists:
                    keep = keep_mask(len(raw), lists, length)
                    gone = int((~keep).sum())
                    runs = int((np.diff(np.concatenate([[True], keep]).astype(np.int8)) == -1).sum())
                    kept = np.frombuffer(raw, np.uint8)[keep].tobytes()
                out.append((i, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None, w))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), carried]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    joined = texts.join(spans, texts.doc_id.eqNullSafe(spans.doc_id) & texts.tag.eqNullSafe(spans.tag), "left")
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, carry {plain.schema['carry'].dataType.simpleString()}"
    done = joined.select("id", "at", "carry", "text").mapInArrow(finish, schema)
    return done.select(*names[:5], *["kept"] * with_text, *[f"carry.{c}" for c in carry])


def op6_run_length_bwt(spark, sf_dir) -> DataFrame:
    return remove_earlier(documents(spark, sf_dir))


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - {WINDOW} + 1, 0))) AS i FROM d),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 2 * {WINDOW})) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first_id FROM s GROUP BY h),
r AS (SELECT s.doc_id, s.i FROM s JOIN f ON s.h = f.h WHERE f.first_id < s.doc_id),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM r),
w AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM g GROUP BY doc_id, island),
m AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM w),
n AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS grp FROM m),
spans AS (SELECT doc_id, grp, min(a) AS a, max(b) AS b FROM n GROUP BY doc_id, grp),
keeps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS u, a AS v FROM spans
  UNION ALL SELECT s.doc_id, max(s.b), any_value(length(d.x)) // 2 FROM spans s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id),
k AS (
  SELECT keeps.doc_id, string_agg(substr(x, 2 * u + 1, 2 * (v - u)), '' ORDER BY u) AS kept
  FROM keeps JOIN d ON keeps.doc_id = d.doc_id GROUP BY keeps.doc_id),
t AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
