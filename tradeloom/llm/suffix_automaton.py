"""Substring dedup of words by suffix automata of reference shards and matching statistics."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents
from .repeats import NOWHERE, Words, keep_mask, repeated_windows, shards

WINDOW = 35
GRAM = 8
SHARD_WORDS = 150_000


class SuffixAutomaton:
    """A suffix automaton of several sequences of numbers. `seen` marks the states whose strings of `most` symbols were met by a stream."""

    def __init__(self, most: int):
        self.most = most
        self.next: list[dict] = [{}]
        self.link, self.length, self.seen = [-1], [0], bytearray(1)

    def _split(self, p, q, symbol):
        moves, link = self.next, self.link
        new = len(moves)
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        moves.append(moves[q].copy())
        self.seen.append(self.seen[q])  # the string of `most` symbols may be in either state now
        link[q] = new
        while p >= 0 and moves[p].get(symbol) == q:
            moves[p][symbol] = new
            p = link[p]
        return new

    def add(self, symbols) -> None:
        last, moves, link, length, seen = 0, self.next, self.link, self.length, self.seen
        for s in symbols:
            q = moves[last].get(s)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, s)
                continue
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            seen.append(0)
            p = last
            while p >= 0 and s not in moves[p]:
                moves[p][s] = new
                p = link[p]
            if p >= 0:
                q = moves[p][s]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, s)
            last = new

    def stream(self, symbols):
        """Matching statistics: (length, state) at each symbol, of the longest suffix so far, cut at `most`, that the sequences hold."""
        at = n = 0
        moves, link, length, most = self.next, self.link, self.length, self.most
        out = []
        for s in symbols:
            to = moves[at].get(s)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = moves[at].get(s)
            if to is None:
                n = 0
            else:
                at, n = to, n + 1
                if n > most:
                    n = most
                while at and length[link[at]] >= most:
                    at = link[at]
            out.append((n, at))
        return out

    def windows(self, symbols, mark: bool = False, seen: bool = False) -> list[int]:
        """Where the windows of `most` symbols begin that the sequences hold (seen: and a stream has met); mark: they are met now."""
        most, flags, out = self.most, self.seen, []
        for end, (n, at) in enumerate(self.stream(symbols), 1):
            if n >= most and (not seen or flags[at]):
                out.append(end - most)
                if mark:
                    flags[at] = 1
        return out


def _numbers(passages: list[bytes], known: dict[bytes, int]) -> list[list[int]]:
    return [[known.setdefault(w, len(known)) for w in p.split(b" ")] for p in passages]


def held_elsewhere(passages: list[bytes], h, owners, places, length: int = WINDOW, shard: int = SHARD_WORDS) -> np.ndarray:
    """For each passage and window, -1 if the window stands in another place too, else NOWHERE; passages of one anchor stand together.

    A shard's automaton is built passage by passage. Each is first streamed against the automaton of those before it,
    and once more if it has several places itself, as those hold it too; what reaches `length` is held elsewhere, and the
    state remembers it. At the end the automaton is complete, and a second stream finds the windows' first places by those states.
    """
    known: dict[bytes, int] = {}
    rows = _numbers(passages, known)
    sizes = np.array([len(r) for r in rows])
    out = np.full((len(rows), int(sizes.max()) - length + 1), NOWHERE)
    for lo, hi, first, end in shards(h, sizes, shard):
        automaton = SuffixAutomaton(length)
        for i in range(lo, hi):
            out[i, automaton.windows(rows[i], mark=True)] = -1
            automaton.add(rows[i])
            if places[i] > 1:
                out[i, automaton.windows(rows[i], mark=True)] = -1
        for i in range(first, end):
            if not lo <= i < hi:  # one anchor of several shards
                out[i, automaton.windows(rows[i], mark=True)] = -1
        for i in range(lo, hi):
            if places[i] == 1:
                out[i, automaton.windows(rows[i], seen=True)] = -1
    return out


class _Frequent:
    """The automaton that is broadcast: of passages with several places each, so all their windows are repeated."""

    def __init__(self, passages, length):
        self.known: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton(length)
        for row in _numbers(passages, self.known):
            self.automaton.add(row)

    def __call__(self, passages: list[bytes]) -> np.ndarray:
        rows = [[self.known.get(w, -1) for w in p.split(b" ")] for p in passages]
        out = np.full((len(rows), max(map(len, rows)) - self.automaton.most + 1), NOWHERE)
        for i, row in enumerate(rows):
            out[i, self.automaton.windows(row)] = -1
        return out


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text", length: int = WINDOW, with_text=False, broadcast=True) -> DataFrame:
    """Every word covered by a window of `length` words that also starts elsewhere in the corpus is removed.

    doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) for every document; with_text
    adds those words as kept. Words are split at ASCII white space and compared unchanged. Null and empty texts have no
    words; a text of any length is whole; repeated rows and rows with equal or null ids are different documents,
    so a whole repeated row of `length` words or more is removed in all its places. An empty table gives no row.
    Windows are judged on the input, not on what is left. The id -2**63 stands for null. broadcast: whether documents
    stream against the broadcast automaton of the most frequent passages first; the rows are the same.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts, spans = repeated_windows(plain, Words, length, min(GRAM, length), lambda *x: held_elsewhere(*x, length), lambda passages, *_: _Frequent(passages, length), False, broadcast)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def finish(batches):
        for ids, at, rows in chunks(batches, ["id", "at", "text"]):
            out = []
            for i, lists, t in zip(ids, at, rows):
                words = (t or "").encode().split()
                keep = keep_mask(len(words), lists, length)
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k] if lists else words)
                out.append((i, len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    joined = texts.join(spans, texts.doc_id.eqNullSafe(spans.doc_id) & texts.tag.eqNullSafe(spans.tag), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return joined.select("id", "at", "text").mapInArrow(finish, schema)


def op4_suffix_automata(spark, sf_dir) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 2, 1))) AS i FROM w),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW} - 1], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM r, (SELECT unnest(range(0, {WINDOW})) AS j)),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (
  SELECT k.doc_id, count(c.pos) AS gone, string_agg(ws[k.pos], ' ' ORDER BY k.pos) FILTER (WHERE c.pos IS NULL) AS kept
  FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.pos = c.pos GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
