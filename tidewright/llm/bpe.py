"""Byte-level BPE by a shuffle of distinct words.

encode: documents are dealt into groups by a hash of the row. A group cuts its texts into words (pre-tokens), whose
numbers stand for them at their positions, and sends each distinct one once, in packed buckets of the word's hash, so a word that fills a
third of the corpus travels once for each group. A bucket encodes each word it meets once (again only when more than MAX_WORDS others came
in between) and answers every group with the ids. The answers are joined with their group's documents,
where each position takes its word's ids. The exchange of documents serves both branches.

Rows of single words and positions would take some 20 bytes for each of the corpus's words, more than its texts: hence groups and packing.

decode: each id is looked up in the token-byte table (as large as the vocabulary, a fixed bound)
and the bytes are laid end to end.

Null and empty texts have no ids. Repeated rows, repeated ids and null doc_ids are kept as they
are. Texts of any length are whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import common
from tidewright.llm.segments import Ragged, WordTable, gather

#: Words a bucket's cache holds before it begins anew.
MAX_WORDS = 300_000
#: Stored bytes of a group of documents, about.
GROUP_BYTES = 6 << 20
FIND = regex.compile(PATTERN).findall


@lru_cache(2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(2)
def token_bytes(path: str) -> Ragged:
    """The token-byte table, by id."""
    table, ranks = Ragged(np.uint8), ranks_of(path)
    by_id = {i: w for w, i in ranks.items()}
    words = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    table.add(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
    return table


def pack(words: list[bytes]) -> bytes:
    size = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + size.tobytes() + b"".join(words), 1)


def unpack(blob: bytes) -> list[bytes]:
    body = zstandard.decompress(blob)
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(body, np.uint32, n, 4)) + 4 + 4 * n).tolist()
    return [body[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def texts_in(body: bytes) -> pa.Array:
    """What pack() packed, as strings."""
    raw = zstandard.decompress(body)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint32, n, 4))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw)[4 + 4 * n :]])


def labels(spark: SparkSession, n: int, each: int) -> list[int]:
    """n x each integers that Spark's hash deals evenly into n partitions, in turn."""
    found: list[list[int]] = [[] for _ in range(n)]
    start = 0
    while min(map(len, found)) < each:
        stop = start + 4 * n * each + 1000
        for r in spark.range(start, stop, 1, 1).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).toLocalIterator():
            if len(found[r.p]) < each:
                found[r.p].append(r.id)
        start = stop
    return [found[p][k] for k in range(each) for p in range(n)]


def encode(docs: DataFrame, path: str, group_docs: int = 2500) -> DataFrame:
    """doc_id and ids (array<int>) of every row. group_docs: about how many rows a group of documents has; it sets only the packing."""
    spark = docs.sparkSession
    n = common.parts(docs)
    base = common.texts_of(docs)
    n_groups = max(n, -(-docs.count() // group_docs), common.parts(docs, GROUP_BYTES))
    label = labels(spark, n, round(n_groups / n))
    n_groups = len(label)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").fill_null("").to_pylist()
            held: dict[int, list] = {}
            for i, text in zip(ids, texts, strict=True):
                body = text.encode()
                held.setdefault(label[zlib.crc32(body, 0 if i is None else i & 0xFFFFFFFF) % n_groups], []).append((i, body))
            rows = [(g, [i for i, _ in rows], pack([t for _, t in rows])) for g, rows in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())], ["g", "ids", "body"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, words, held = None, WordTable(None, FIND), []

        def learn():
            if held:
                words.numbers(pa.concat_arrays(held))
                held.clear()

        def send():
            out: dict[int, list[bytes]] = {}
            for w in words.words:
                raw = w.encode()
                out.setdefault(zlib.crc32(raw) % n, []).append(raw)
            return pa.RecordBatch.from_arrays([pa.array([label[k] for k in out], pa.int32()), pa.array([group] * len(out), pa.int32()), pa.array([pack(sorted(x)) for x in out.values()], pa.binary())], ["bucket", "g", "words"])

        for batch in batches:
            for g, body in zip(batch.column("g").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if g != group:
                    learn()
                    if words.words:
                        yield send()
                    group, words = g, WordTable(None, FIND)
                held.append(texts_in(body))
                if sum(t.nbytes for t in held) > common.BLOCK_BYTES:
                    learn()
        learn()
        if words.words:
            yield send()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), {}
        for batch in batches:
            for g, words in zip(batch.column("g").to_pylist(), batch.column("words").to_pylist(), strict=True):
                asked, out = unpack(words), []
                for w in asked:
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array(enc.encode_ordinary(w.decode()), np.int32).tobytes()
                    out.append(ids)
                if len(known) > MAX_WORDS:
                    known.clear()
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([words], pa.binary()), pa.array([pack(out)], pa.binary())], ["g", "words", "found"])

    def rejoin(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(None, FIND)
        for batch in right:
            for words, found in zip(batch.column("words").to_pylist(), batch.column("found").to_pylist(), strict=True):
                ids = unpack(found)
                table.words.codes([w.decode() for w in unpack(words)])
                table.word_ids.add(np.frombuffer(b"".join(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
        of, held = [], []

        def laid() -> pa.RecordBatch:
            flat, starts = table.looked_up(*table.numbers(pa.concat_arrays(held)))
            out = pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))], ["doc_id", "ids"])
            of.clear()
            held.clear()
            return out

        for batch in left:
            for ids, body in zip(batch.column("ids").to_pylist(), batch.column("body").to_pylist(), strict=True):
                of += ids
                held.append(texts_in(body))
                if sum(t.nbytes for t in held) > common.BLOCK_BYTES:
                    yield laid()
        if held:
            yield laid()

    docs_by_group = base.mapInArrow(common.freed(squeeze), "g int, ids array<long>, body binary").repartition(n, "g").sortWithinPartitions("g")
    asked = docs_by_group.mapInArrow(common.freed(explode), "bucket int, g int, words binary").repartition(n, "bucket")
    answers = asked.mapInArrow(common.freed(answer), "g int, words binary, found binary").repartition(n, "g")

    def whole(key, left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(rejoin(left.to_batches(), right.to_batches()))
        return pa.Table.from_batches(got, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return docs_by_group.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(whole, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encoded with the bytes that ids stand for, as column decoded."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                lists = part.column("ids")
                n = np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)
                flat, starts = gather(table.flat, table.ends, lists.flatten().to_numpy().astype(np.int64), n)
                body = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(starts), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*part.columns, body.cast(pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(common.freed(scan), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the two hashes of decoded rows."""
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
