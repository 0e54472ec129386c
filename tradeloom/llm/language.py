"""Language ID by hyperdimensional letter profiles."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents, trim

DIMENSIONS = 1024
UNDETERMINED = "und"
TRAIN_ROWS = 50_000
REJECT_BELOW = 0.12  # cosines of random letters stay below 0.1 nearly always: their deviation is 1 / sqrt(DIMENSIONS) = 0.03


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The random vector of +1 and -1 of a code point, the same everywhere."""
    return np.random.default_rng([code, 7919]).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


class Letters:
    """Trigrams of letters to their vectors: each letter's vector, permuted by its place, bound by multiplication."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d, self.single, self.grams = dimensions, {}, {}

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.single:
            self.single[code] = letter_vector(code, self.d)
        return self.single[code]

    def gram(self, key: int) -> np.ndarray:
        got = self.grams.get(key)
        if got is None:
            if len(self.grams) >= 100_000:
                self.grams.clear()
            a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
            got = self.grams[key] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return got

    def bundle(self, keys, counts) -> np.ndarray:
        """The sum of the trigrams' vectors, each as often as it occurs."""
        rows = np.array([self.gram(k) for k in keys], dtype=np.float32)
        return np.asarray(counts, dtype=np.float32) @ rows


#: For each code point: the lower-case letter it counts as, or a space.
_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    if not _TABLE:
        table = np.full(0x110000, 32, dtype=np.int64)
        for code in range(0x110000):
            if not 0xD800 <= code < 0xE000 and unicodedata.category(c := chr(code))[0] == "L":
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _TABLE.append(table)
    return _TABLE[0]


def trigrams(texts: list[str | None]):
    """(text number, trigram, count), by text: three letters or word ends in a row; runs of other characters are one end."""
    joined = "\0".join([f" {t or ''} " for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    of = np.cumsum(codes == 0) if len(texts) > 1 else np.zeros(len(codes), dtype=np.int64)
    if "\0" in "".join(t or "" for t in texts):  # such a text is taken without its zeros
        return trigrams([(t or "").replace("\0", " ") for t in texts])
    low = _table()[codes]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (of[1:] != of[:-1])
    low, of = low[keep], of[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = (of[2:] == of[:-2]) & ((low[1:-1] != 32) | ((low[:-2] != 32) & (low[2:] != 32)))
    names, dense = np.unique(low, return_inverse=True)
    n = len(names)
    if n**3 * len(texts) < 2**62:
        key = ((of[2:] * n + dense[:-2]) * n + dense[1:-1]) * n + dense[2:]
        got, count = np.unique(key[ok], return_counts=True)
        of_text, gram = got // n**3, got % n**3
        return of_text, (names[gram // n**2] << 42) | (names[gram // n % n] << 21) | names[gram % n], count
    parts = [trigrams([t]) for t in texts]
    return tuple(np.concatenate(x) for x in ([p[0] + i for i, p in enumerate(parts)], [p[1] for p in parts], [p[2] for p in parts]))


def train(labelled: DataFrame, text="text", lang="lang", dimensions: int = DIMENSIONS, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Language to prototype: the bundle of the trigrams of its texts.

    Fits on `rows` labelled rows or so, taken by a hash of the text where there are more; rows without label or text
    teach nothing. Trigrams are counted by language before anything moves, and the driver gets a vector per language.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1_000_000)) < F.lit(int(1_000_000 * rows / n)))

    def run(batches):
        letters, sums = Letters(dimensions), {}
        for langs, texts in chunks(batches, ["lang", "text"]):
            of, keys, counts = trigrams(texts)
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])[of] if len(of) else of
            for k, name in enumerate(names):
                mine = which == k
                got, back = np.unique(keys[mine], return_inverse=True)
                if len(got):
                    sums[name] = sums.get(name, 0) + letters.bundle(got.tolist(), np.bincount(back, counts[mine])).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    sums = known.mapInArrow(run, "lang string, v array<double>")
    folded = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for name, i, x in folded.collect():
        out.setdefault(name, np.zeros(dimensions))[i] = x
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id="doc_id", text="text", dimensions: int = DIMENSIONS) -> DataFrame:
    """The columns of docs with lang_pred and score, the cosine of the document's bundle and the nearest prototype (0 to 1).

    A null text, or one without a letter, is `und` with score 0, and so is every text when no language was learned.
    Equal scores go to the first language by name. Any column but the text passes through unread, but a column of docs that
    is itself named lang_pred or score is replaced.
    """
    names = sorted(prototypes)
    protos = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names], dtype=np.float32).reshape(len(names), dimensions)

    def run(batches):
        letters = Letters(dimensions)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            preds, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            start = size = 0
            for end in range(len(texts)):
                size += len(texts[end] or "")
                if size < 1_000_000 and end + 1 < len(texts):
                    continue
                of, keys, counts = trigrams(texts[start : end + 1])
                if len(of) and names:
                    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
                    got, back = np.unique(keys, return_inverse=True)
                    table = np.array([letters.gram(k) for k in got.tolist()], dtype=np.float32)
                    weights = counts.astype(np.float32)
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        v = weights[a:b] @ table[back[a:b]]
                        cos = protos @ v / max(float(np.linalg.norm(v)), 1e-12)
                        best = int(cos.argmax())
                        row = start + int(of[a])
                        preds[row], scores[row] = names[best], min(1.0, max(0.0, float(cos[best])))
                start, size = end + 1, 0
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(preds), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])
        letters = batch = texts = kept = table = None
        trim()

    clash = [c for c in ("lang_pred", "score") if c in docs.columns]
    schema = docs.drop(*clash).schema.add("lang_pred", "string").add("score", "double")
    return docs.drop(*clash).mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """Whether a document teaches nothing: crc32 of its doc_id as text, modulo 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op9_hyperdimensional(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = train(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
