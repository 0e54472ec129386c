"""Best-two-fit packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, documents
from .tokens import word_ids

SEQUENCE = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) for a multiset of lengths given as counts.

    A sequence is filled greedily: the longest length left, then again and again the longest that fits its gap.
    If a gap remains, its smallest length is taken out and the two lengths left that together fit the widened gap
    most tightly take its place, where that is tighter. Equal sequences are made at once, so the work depends on
    the number of different lengths (`size` at most) and not on the number of documents.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(size + 1)
    plans = []
    while left.any():
        used: dict[int, int] = {}
        bin_: list[int] = []
        gap = size

        def free():
            have = left > 0
            for k, n in used.items():
                have[k] = left[k] > n
            have[0] = False
            return have

        top = np.maximum.accumulate(np.where(free(), lengths, 0))  # longest free length up to each
        while gap and (x := int(top[gap])):
            take = min(int(left[x]) - used.get(x, 0), gap // x)
            bin_ += [x] * take
            used[x] = used.get(x, 0) + take
            gap -= take * x
            if used[x] == left[x]:
                top = np.maximum.accumulate(np.where(free(), lengths, 0))
        if gap and bin_:
            small = bin_[-1]
            room = gap + small
            used[small] -= 1
            top = np.maximum.accumulate(np.where(free(), lengths, 0))
            first = lengths[1:room][top[1:room] == lengths[1:room]]
            second = np.minimum(top[room - first], first)  # pairs in order, the longer first
            lone = (second == first) & np.array([left[k] - used.get(int(k), 0) < 2 for k in first], dtype=bool)
            if lone.any():
                second = np.where(lone, np.where(first > 0, top[np.minimum(room - first, first - 1)], 0), second)
            both = np.where(second > 0, first + second, 0)
            best = int(both.argmax()) if len(both) else -1
            if best >= 0 and both[best] > small:
                bin_ = bin_[:-1] + [int(first[best]), int(second[best])]
                for k in bin_[-2:]:
                    used[k] = used.get(k, 0) + 1
            else:
                used[small] += 1
        need = {k: n for k, n in used.items() if n}
        times = min(int(left[k]) // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
        plans.append((bin_, times))
    return plans


def slots(plans) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: ranks where a run of places begins, the first sequence of the run, places a sequence, offset of each."""
    runs: dict[int, list] = {}
    seq, given = 0, {}
    for bin_, times in plans:
        at: dict[int, list[int]] = {}
        offset = 0
        for x in bin_:
            at.setdefault(x, []).append(offset)
            offset += x
        for x, offsets in at.items():
            runs.setdefault(x, []).append((given.get(x, 0), seq, offsets))
            given[x] = given.get(x, 0) + times * len(offsets)
        seq += times
    return {x: (np.array([r[0] for r in rs]), [r[1:] for r in rs]) for x, rs in runs.items()}


def pieces(docs: DataFrame, path: str, doc_id="doc_id", text="text", size: int = SEQUENCE, end: int = END, with_ids=False) -> DataFrame:
    """Token pieces of every document: its ids and an end id, cut only where longer than `size`."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        words = word_ids(path)
        tail = np.array([end], dtype="<u4")
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            rows = []
            for i, got in zip(ids, words.batch(texts)):
                got = np.concatenate([got, tail])
                for k, start in enumerate(range(0, len(got), size)):
                    part = got[start : start + size]
                    rows.append((i, k, start, len(part), zlib.crc32(part.tobytes())) + ((part.tolist(),) if with_ids else ()))
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(parts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset: best-two-fit over the whole table.

    Only the histogram of lengths (`size` numbers) goes to the driver, and the plan made from it depends on that
    alone. Every piece then finds its place by its rank among the pieces of its length, counted within the
    partitions of the pieces first, so a length that many pieces share is never in one task. An empty table gives
    no row; pieces with equal columns have their own places.
    """
    kept = cut(parts).withColumn("_in", F.spark_partition_id())
    plan = slots(best_two_fit({r[0]: r[1] for r in kept.groupBy("length").count().collect()}, size))
    counted = kept.groupBy("_in", "length").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1))
    based = counted.select("_in", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("_in", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = kept.withColumn("_rank", F.row_number().over(order) - 1).join(based, ["_in", "length"])
    names = parts.columns

    def place(batches):
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            rank = np.asarray(batch.column(batch.schema.get_field_index("_at")))
            seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                begins, runs = plan[x]
                which = np.searchsorted(begins, rank[rows], side="right") - 1
                for w in np.unique(which).tolist():
                    of = rows[which == w]
                    first, offsets = runs[w]
                    k = rank[of] - begins[w]
                    seq[of] = first + k // len(offsets)
                    off[of] = np.array(offsets)[k % len(offsets)]
            kept_cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept_cols, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, (F.col("_rank") + F.col("_before")).cast("long").alias("_at")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE, end: int = END, with_ids=False, **columns) -> DataFrame:
    """pieces() and pack(). A null text is empty and so has its end id alone; null doc_ids and repeated rows keep their
    own pieces; a text of any length is cut into full pieces and one rest; other columns are not read."""
    return pack(pieces(docs, path, size=size, end=end, with_ids=with_ids, **columns), size)


def op8_best_two_fit(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
