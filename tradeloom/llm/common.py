"""What the operators share: durable cuts of the lineage, and Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)  # stands in for a null doc_id where ids are compared or joined
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where none is set, a local session gets a temporary
    folder of its own; on a cluster, whose executors could not read that, this is an error."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:
        if not context.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tradeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder that nothing else uses. What is written there goes when the application ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there: lost executors cost nothing that is done.

    The shuffle files of the plan go as soon as its rows are written, so that a job of several steps holds the disk of
    one of them. Spark does this itself for an execution that began under CLEAN.
    """
    spark = df.sparkSession
    path, before = f"{new_folder(spark, 'cut')}/rows", spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trim() -> None:
    """Give freed memory back to the system. Python workers outlive their tasks, and what their allocators keep for
    later (measured: some 150 MB a worker) counts against the executor all the while."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        give(0)


def chunks(batches, columns, limit=2_000_000):
    """Python lists of the columns, in runs of rows whose last column (text) has about `limit` characters at most."""
    batch = cols = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        start = size = 0
        for i, text in enumerate(cols[-1]):
            size += len(text) if text else 0
            if size >= limit:
                yield [c[start : i + 1] for c in cols]
                start, size = i + 1, 0
        if start < len(cols[-1]):
            yield [c[start:] for c in cols]
    del batch, cols
    trim()


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose i-th value is data[bounds[i]:bounds[i + 1]]."""
    data = np.ascontiguousarray(data)
    offsets = (np.asarray(bounds, dtype=np.int64) * data.itemsize).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return array.cast(pa.binary())


def key_of(doc_id="doc_id"):
    """doc_id as a join key that is never null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID).cast("long"))
