"""Token ids by public vocabularies: a cached front to the tokenizers library, and a BPE of our own."""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
KEEP = 300_000  # chunks in a generation of a process's cache
_ODD = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")  # what the quick paths leave to the general ones
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_WIDE = re.compile(r" \s|\s ")


class _Flat:
    """Ids of many texts end to end: text i has ids[bounds[i]:bounds[i + 1]]."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    def __iter__(self):
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            yield self.ids[a:b]


def _flat(pieces: list[bytes]) -> _Flat:
    return _Flat(np.frombuffer(b"".join(pieces), dtype="<u4"), np.cumsum([0, *(len(p) // 4 for p in pieces)]))


class _Cache(dict):
    """Filled on demand, with two generations: what was used since the last turn outlives the next one."""

    def __init__(self, fill):
        self.fill, self.old = fill, {}

    def __missing__(self, chunk):
        if len(self) >= KEEP:
            self.old = dict(self)
            self.clear()
        out = self.old.get(chunk)
        if out is None:
            out = self.fill(chunk)
        self[chunk] = out
        return out


def _packed(fill):
    """A cache of ids as little-endian unsigned 32-bit integers."""
    return _Cache(lambda chunk: array("I", fill(chunk)).tobytes())


class WordIds:
    """ids of whole texts as the tokenizers library gives them for a lower-casing vocabulary with word ends.

    Words never cross white space there, so a text of plain letters is looked up chunk by chunk and only chunks
    not met before go to the library's model; any other text goes to the library as a whole. Null is empty.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.bytes = byte_letters()
        self.known = _packed(lambda c: self._word(c) if c.isalpha() else [i for w in _WORD.findall(c) for i in self._word(w)])

    def _word(self, word: str) -> list[int]:
        spelled = word if word.isascii() else "".join([self.bytes[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(spelled)]

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or _ODD.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def batch(self, texts) -> _Flat:
        return _flat(list(map(self._one, texts)))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBPE:
    """Byte-level BPE by a contiguous rank array.

    A word keeps its part ids and the rank of each adjacent pair side by side; the least rank (the first of equal
    ones) names the boundary to delete, then the two neighbouring ranks are looked up again. A word of over
    `short` bytes takes the same merges from a heap instead, since scanning would be quadratic.
    """

    def __init__(self, path: str, short: int = 128):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.spelled: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.spelled[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.single = [vocab[c] for c in byte_letters()]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.words = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.table = pa.array(self.spelled, type=pa.large_binary())
        self.digits = pa.array([b"%d," % i for i in range(len(self.spelled))], type=pa.large_binary())
        self.short = short
        self.piece = _Cache(lambda x: self.word(x.encode()))
        self.first = _packed(self.encode)
        self.rest = _packed(lambda c: self.encode(" " + c))

    def word(self, word: bytes) -> list[int]:
        ids = [self.single[b] for b in word]
        if len(ids) > self.short:
            return self._heap(ids)
        none, find = (1 << 60, 0), self.merge.get
        ranks = [find(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least is none:
                break
            i = ranks.index(least)
            ids[i] = least[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n, find = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := find((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := find((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := find((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> list[int]:
        """ids of a whole text; the strings of special tokens become those tokens. Null is empty."""
        out: list[int] = []
        for piece in self.split_special.split(text or "") if text and "<|" in text else [text or ""]:
            if piece in self.special:
                out.append(self.special[piece])
            else:
                for x in self.words.findall(piece):
                    out += self.piece[x]
        return out

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or _ODD.search(text) or _WIDE.search(text):
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))

    def batch(self, texts) -> _Flat:
        """ids of many texts. A space between two other letters always begins a word, so such texts are cut there first."""
        return _flat(list(map(self._one, texts)))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, special ones included."""
        return b"".join(map(self.spelled.__getitem__, ids))

    @staticmethod
    def spell(table: pa.Array, flat: _Flat) -> list[memoryview]:
        """For each text, its ids' entries of the table end to end: their bytes, or their digits and commas."""
        if not len(flat.ids):
            return [memoryview(b"")] * (len(flat.bounds) - 1)
        taken = table.take(pa.array(flat.ids))
        at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[flat.bounds].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(at, at[1:])]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each process, so that its cache outlives a task."""
    return WordIds(path)


@functools.cache
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
