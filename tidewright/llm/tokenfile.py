"""Token ids in Arrow stream files of fixed-size lists.

Each range of doc_id is one file. Its ids, end ids included, are laid end to end and cut into
rows of equal length: a list column of ids and one of mask bits, which are 0 only after the last
id. Every batch but the last has the same number of rows, so a mapped file gives any row without
copying. A second stream file beside it, the index, has each document's id, first position and
number of ids.

Rows are ordered by doc_id, nulls first, then by text. Null and empty texts are the end id alone.
Repeated rows are written as often as they occur. An empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tidewright.llm import common
from tidewright.llm.segments import WordTable, byte_letters

LENGTH, BATCH_ROWS = 2048, 256
MANIFEST = "first long, file string, n_docs long, n_ids long, part long"


@lru_cache(2)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def table(path: str) -> WordTable:
    """Each word goes once through the library's model; texts with a special string go through the whole library."""
    tok = library(path)
    model, shown = tok.model, byte_letters()

    def encode(word: str) -> list[int]:
        if word.isascii() and word[1:].isalpha() and word[0] == " ":  # such bytes but the space are written as they are
            return [t.id for t in model.tokenize(shown[32] + word[1:])]
        return [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(shown))]

    def whole(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    return WordTable(encode, regex.compile(PATTERN).findall, whole, np.uint16 if tok.get_vocab_size() <= 65536 else np.uint32)


class Writer:
    """Packs ids into rows of one stream file."""

    def __init__(self, sink, dtype, length: int = LENGTH, rows: int = BATCH_ROWS):
        self.length, self.rows = length, rows
        self.item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.rest, self.n = pa.ipc.new_stream(sink, self.schema), np.empty(0, dtype), 0

    def write(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        step, at = self.length * self.rows, 0
        while len(self.rest) - at >= step:
            self.batch(self.rest[at : at + step], step)
            at += step
        self.rest = self.rest[at:].copy()

    def batch(self, ids: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < valid)
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids, self.item), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            short = -len(self.rest) % self.length
            self.batch(np.concatenate([self.rest, np.zeros(short, self.rest.dtype)]), len(self.rest))
        self.out.close()


class Reader:
    """Zero-copy access to the rows of a stream file: mapped where the file system allows, else read once."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = np.concatenate([[0], np.cumsum([b.num_rows for b in self.batches])])
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def row(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i."""
        k = int(np.searchsorted(self.rows, i, "right")) - 1
        at = (i - self.rows[k]) * self.length
        ids, mask = self.batches[k].columns
        return ids.values.slice(at, self.length).to_numpy(), mask.values.slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a position in the file on; a view unless they lie in several batches."""
        got = []
        while n > 0:
            k = int(np.searchsorted(self.rows, start // self.length, "right")) - 1
            body = self.batches[k].column(0).values
            at = start - int(self.rows[k]) * self.length
            take = min(n, len(body) - at)
            got.append(body.slice(at, take).to_numpy())
            start, n = start + take, n - take
        return got[0] if len(got) == 1 else np.concatenate(got)


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> list[dict]:
    """Writes the files and returns their manifest in order of doc_id: a row for each file. Runs a job."""
    spark = docs.sparkSession
    folder = folder or f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = common.blocks(batches, size=8 << 20)
        head = next(parts, None)
        if head is None:
            return
        words = table(path)
        task = TaskContext.get()
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.arrows"  # an attempt that is lost leaves a file that no manifest has
        places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())])
        n_docs = 0
        with where.open_output_stream(f"{base}/{name}") as sink, where.open_output_stream(f"{base}/{name}.index") as side:
            rows, index = Writer(sink, words.dtype), pa.ipc.new_stream(side, places)
            for part in chain([head], parts):
                ids, starts = words.ids(part.column("text"))
                ids = np.insert(ids, starts[1:], end_id)
                starts = starts + np.arange(len(starts))
                index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows.n + starts[:-1]), pa.array(np.diff(starts))], schema=places))
                rows.write(ids)
                n_docs += part.num_rows
            rows.close()
            index.close()
        yield pa.RecordBatch.from_arrays([head.column("doc_id").slice(0, 1), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([rows.n]), pa.array([task.partitionId()])], ["first", "file", "n_docs", "n_ids", "part"])

    ordered = common.texts_of(docs).repartitionByRange(common.parts(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    found = ordered.mapInArrow(common.freed(scan), MANIFEST).collect()  # a row for each file
    return [r.asDict() for r in sorted(found, key=lambda r: r.part)]


TOKENS = "doc_id long, start long, n_tokens long"


def documents(spark: SparkSession, manifest: list[dict], make: Callable[[np.ndarray, np.ndarray], pa.Array], column: str) -> DataFrame:
    """doc_id, start among all ids, n_tokens and one column more of every document, from the files; a task for each file. make gets the ids of some documents end to end and where each document's begin."""
    before = np.concatenate([[0], np.cumsum([m["n_ids"] for m in manifest])]).tolist()
    files = [(m["file"], b) for m, b in zip(manifest, before, strict=False)]
    names = ["doc_id", "start", "n_tokens", column.split()[0]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = Reader(uri)
                where, at = fs.FileSystem.from_uri(f"{uri}.index")
                for index in pa.ipc.open_stream(where.open_input_stream(at)):
                    start, n = index.column("start").to_numpy(), index.column("n_ids").to_numpy()
                    for k in range(0, len(n), 512):  # a few hundred documents at a time
                        stop = min(k + 512, len(n))
                        made = make(reader.ids(int(start[k]), int(n[k:stop].sum())), np.concatenate([[0], np.cumsum(n[k:stop])]))
                        yield pa.RecordBatch.from_arrays([index.column("doc_id").slice(k, stop - k), pa.array(base + start[k:stop]), pa.array(n[k:stop]), made], names)

    listed = spark.createDataFrame(files or [("", 0)], "file string, base long").limit(len(files)) if not files else spark.createDataFrame(spark.sparkContext.parallelize(files, len(files)), "file string, base long")
    return listed.mapInArrow(common.freed(scan), f"{TOKENS}, {column}")


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start among all ids, n_tokens and ids of every document, from the files."""
    return documents(spark, manifest, lambda ids, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), "ids array<int>")


def checksums(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    body = ids.astype("<u4")
    return pa.array([zlib.crc32(body[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())


def read_digests(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """What digests() has of read_tokens(), without ids on the way."""
    return documents(spark, manifest, checksums, "ids_crc32 long")


def digests(tokens: DataFrame) -> DataFrame:
    """The checksum of each document's ids in place of the ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], checksums(lists.values.to_numpy(), lists.offsets.to_numpy())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(common.freed(scan), f"{TOKENS}, ids_crc32 long")
