"""What the operators of this subpackage share: tables, scratch space, word interning."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python-side working blocks hold about this many bytes of text.
BLOCK_BYTES = 4 << 20
#: Stored bytes that a task of a shuffle of texts gets, about.
TASK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that extra columns never travel or clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and one machine does all."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts(df: DataFrame, size: int = TASK_BYTES) -> int:
    """Tasks for a shuffle of df: spark.sql.shuffle.partitions, or more where what df is read from has over size bytes (as stored) for each."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    stored = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(width(df.sparkSession), -(-sum(b for b in stored if b < 1 << 60) // size))  # beyond, Spark doesn't know


def give_back() -> None:
    """Returns memory that this process no longer needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def freed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow; the worker, which lives on, gives its memory back when a task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m: the fold rule."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def py_crc_mod(doc_id: int | None, m: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


class Interner(dict):
    """Gives each distinct key the next integer, in order of first sight."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n

    def codes(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows cut so that each piece holds about size bytes of text; a longer single text is a piece by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_ends(batch.column(column))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_ends(column: pa.Array) -> np.ndarray:
    """Running sum of byte lengths; null counts as empty."""
    lengths = pc.binary_length(column).fill_null(0)
    return np.cumsum(np.asarray(lengths, dtype=np.int64))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and each text's start in them with the total last; null is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return body, at - at[0]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values in each [starts[i], starts[i + 1])."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]
