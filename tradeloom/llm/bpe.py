"""BPE encoding and decoding of a column of texts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents
from .tokens import byte_bpe

VOCABULARY = "byte_bpe_50k.json"


def encode_decode(docs: DataFrame, path: str, doc_id="doc_id", text="text", with_ids=False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and decoded for every text: its ids by the contiguous rank array, then back.

    path: a byte-level BPE file of the tokenizers library. Strings of special tokens become those tokens, as there,
    and are written out again. A null or empty text has no ids; texts of any length are whole. Each row is for
    itself: repeated rows and null doc_ids give their own rows, an empty table none; other columns are not read.
    with_ids adds the ids and the decoded bytes.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids

    def run(batches):
        bpe = byte_bpe(path)
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            flat = bpe.batch(texts)
            digits, back = bpe.spell(bpe.digits, flat), bpe.spell(bpe.table, flat)
            cols = [
                pa.array(ids, pa.int64()),
                pa.array([b - a for a, b in zip(flat.bounds[:-1].tolist(), flat.bounds[1:].tolist())], pa.int64()),
                pa.array([hashlib.sha256(d[:-1]).hexdigest() for d in digits]),
                pa.array([hashlib.sha256(d).hexdigest() for d in back]),
            ]
            if with_ids:
                cols += [pa.array([x.tolist() for x in flat], pa.list_(pa.int32())), pa.array([bytes(d) for d in back], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op7_rank_array_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
