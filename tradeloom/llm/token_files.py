"""Token-id files: independent zstandard frames, a trailing seek table, and a checksum of each frame.

Before the seek table stands a skippable frame of our own: for each frame, in order, its documents, tokens, first and
last doc_id. Documents are in ascending order, so it names the frames that can hold a document, and only those are decompressed.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, documents, new_folder
from .tokens import word_ids

# Fixed values of the seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

SKIPPABLE_INDEX = 0x184D2A5D
INDEX_ROW = struct.Struct("<IQqq")

END = 2
VOCABULARY = "word_bpe_49k.json"
FRAME_TOKENS = 1 << 18
NULL_ID = -(2**63)


def frame_bytes(doc_ids, flat_ids: np.ndarray, lengths) -> bytes:
    """Before compression: document count, doc_ids, lengths, ids; all little-endian. A null doc_id is the least long."""
    ids = np.array([NULL_ID if i is None else i for i in doc_ids], dtype="<i8")
    return struct.pack("<I", len(ids)) + ids.tobytes() + np.asarray(lengths, dtype="<u4").tobytes() + flat_ids.astype("<u4").tobytes()


class FrameWriter:
    def __init__(self, out, level: int = 1):
        self.out, self.level, self.table, self.index = out, level, [], []

    def frame(self, raw: bytes) -> None:
        """A frame of frame_bytes()."""
        packed = zstandard.ZstdCompressor(level=self.level).compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        (n,) = struct.unpack_from("<I", raw)
        self.index.append(INDEX_ROW.pack(n, (len(raw) - 4) // 4 - 3 * n, *struct.unpack_from("<q", raw, 4), *struct.unpack_from("<q", raw, 8 * n - 4)))
        self.out.write(packed)

    def close(self) -> None:
        rows = b"".join(self.index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(rows)) + rows)
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads the seek table of a random-access file, then only the frames that are asked for."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        file.seek(end - 9 - 12 * n)
        self.table = list(struct.iter_unpack("<III", file.read(12 * n)))
        self.at = np.cumsum([0, *(row[0] for row in self.table)]).tolist()
        self.read = 0  # frames decompressed so far

    def __len__(self):
        return len(self.table)

    def raw(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        self.read += 1
        self.file.seek(self.at[k])
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, k: int):
        """(doc_id, ids) of each document of frame k."""
        raw = self.raw(k)
        (n,) = struct.unpack_from("<I", raw)
        ids = np.frombuffer(raw, "<i8", n, 4).tolist()
        lengths = np.frombuffer(raw, "<u4", n, 4 + 8 * n)
        tokens = np.frombuffer(raw, "<u4", -1, 4 + 12 * n)
        for i, part in zip(ids, np.split(tokens, np.cumsum(lengths)[:-1])):
            yield (None if i == NULL_ID else i), part


    def index(self) -> list[tuple[int, int, int, int]]:
        """(documents, tokens, first, last doc_id) of each frame, from the frame before the seek table."""
        self.file.seek(self.at[-1])
        magic, size = struct.unpack("<II", self.file.read(8))
        if magic != SKIPPABLE_INDEX or size != INDEX_ROW.size * len(self):
            raise ValueError("no index of documents")
        return list(INDEX_ROW.iter_unpack(self.file.read(size)))

    def find(self, wanted):
        """(doc_id, tokens of the file before it, ids) of the documents with the ids wanted (null too); decompresses only frames that can hold one."""
        keys = np.unique(np.array([NULL_ID if i is None else i for i in wanted], dtype=np.int64))
        before = 0
        for k, (_, tokens, first, last) in enumerate(self.index()):
            if np.searchsorted(keys, first) < np.searchsorted(keys, last, side="right"):
                at = before
                for i, ids in self.documents(k):
                    key = NULL_ID if i is None else i
                    spot = int(np.searchsorted(keys, key))
                    if spot < len(keys) and keys[spot] == key:
                        yield i, at, ids
                    at += len(ids)
            before += tokens


def open_store(folder: str):
    """A file system and a path in it for a folder given as path or URI."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), folder


def write_tokens(docs: DataFrame, folder: str, path: str, files: int, doc_id="doc_id", text="text", end: int = END, frame_tokens: int = FRAME_TOKENS) -> list[tuple]:
    """Write all documents in ascending doc_id order; (number, path, documents, tokens, first, last doc_id) of each file, in order.

    Documents go to files by ranges of (doc_id, start of the text), so equal ids may be in several files, and within a
    file by (doc_id, text); null doc_ids come first, as NULL_ID, which a real id of that value can't be told from. A file
    is written under a name of its own attempt and becomes part of the result only by the row its task returns, so
    a task that runs again does no harm. The driver gets one row for each file.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(NULL_ID).cast("long"))  # Spark samples these keys for the ranges: an id and a few characters a row
    ordered = base.repartitionByRange(files, order, F.substring("text", 1, 24)).sortWithinPartitions(order, "text")

    def run(batches):
        words, done = word_ids(path), []
        store, root = open_store(folder)
        tail = np.array([end], dtype="<u4")
        number = TaskContext.get().partitionId()  # ranges are in order
        name = f"{root}/tokens-{number:06d}-{uuid.uuid4().hex}.zst"
        out = writer = first = last = None
        held: list = []
        n_held = docs_in = tokens_in = 0

        def flush():
            nonlocal held, n_held
            if held:
                writer.frame(frame_bytes([h[0] for h in held], np.concatenate([h[1] for h in held]), [len(h[1]) for h in held]))
            held, n_held = [], 0

        for ids, texts in chunks(batches, ["doc_id", "text"]):
            if writer is None:
                out = store.open_output_stream(name, compression=None)
                writer, first = FrameWriter(out), ids[0]
            last = ids[-1]
            for i, got in zip(ids, words.batch(texts)):
                got = np.concatenate([got, tail])
                held.append((i, got))
                n_held += len(got)
                docs_in += 1
                tokens_in += len(got)
                if n_held >= frame_tokens:
                    flush()
        if writer is not None:
            flush()
            writer.close()
            out.close()
            done = [(number, name, docs_in, tokens_in, first, last)]
        cols = list(zip(*done)) or [()] * 6
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["file", "path", "docs", "tokens", "first", "last"])

    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    rows = ordered.mapInArrow(run, "file int, path string, docs long, tokens long, first long, last long").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def read_tokens(spark, folder: str, manifest: list[tuple], with_ids=False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; a task reads a file, frame by frame."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    starts = np.cumsum([0, *(m[3] for m in manifest)]).tolist()
    rows = [(m[1], s) for m, s in zip(manifest, starts)]

    def run(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(path) as file:
                    reader = FrameReader(file)
                    for k in range(len(reader)):
                        out = []
                        for i, ids in reader.documents(k):
                            out.append((i, start, len(ids), zlib.crc32(ids.tobytes())) + ((ids.tolist(),) if with_ids else ()))
                            start += len(ids)
                        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.split()[0] for f in schema.split(", ")])

    listed = spark.createDataFrame(rows, "path string, start long")
    return listed.repartitionByRange(max(1, len(rows)), "start").mapInArrow(run, schema)


def read_documents(spark, folder: str, manifest: list[tuple], wanted: DataFrame, doc_id="doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of the documents whose doc_id is in `wanted` (null ones by a null there).

    Requests go to the files whose range of doc_ids holds them, a task opens a file and decompresses only the frames
    that can hold one; frames_read is how many of frames that were. Equal requests are one; ids that no
    document has give no row, and rows of equal doc_ids are all found.
    """
    starts = np.cumsum([0, *(m[3] for m in manifest)]).tolist()
    files = spark.createDataFrame([(m[1], s, NULL_ID if m[4] is None else m[4], NULL_ID if m[5] is None else m[5]) for m, s in zip(manifest, starts)], "path string, start long, first long, last long")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID).cast("long"))
    asked = wanted.select(key.alias("doc_id")).distinct()
    dealt = asked.join(F.broadcast(files), (F.col("doc_id") >= F.col("first")) & (F.col("doc_id") <= F.col("last")))  # a row for each file of the manifest
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>, frames_read int, frames int"

    def run(table: pa.Table) -> pa.Table:
        store, _ = open_store(folder)
        start, out = table.column("start")[0].as_py(), []
        with store.open_input_file(table.column("path")[0].as_py()) as file:
            reader = FrameReader(file)
            for i, at, ids in reader.find(table.column("doc_id").to_pylist()):
                out.append((i, start + at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
            many = (reader.read, len(reader))
        cols = list(zip(*out)) or [()] * 5
        types = [pa.int64()] * 4 + [pa.list_(pa.int32())] + [pa.int32()] * 2
        return pa.table([pa.array(c, t) for c, t in zip([*cols, *([x] * len(out) for x in many)], types)], names=[f.split()[0] for f in schema.split(", ")])

    return dealt.groupBy("path").applyInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, files: int | None = None, with_ids=False, **options) -> DataFrame:
    """write_tokens() into the shared folder, then read_tokens().

    A null or empty text has the end id alone; texts of any length are whole. Rows with equal doc_ids follow each
    other by text, and null doc_ids come first. An empty table has no files and gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    files = files or max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_tokens(spark, folder, write_tokens(docs, folder, path, files, **options), with_ids)


def op10_seekable_zstd(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
