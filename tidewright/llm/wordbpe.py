"""BPE by one table of distinct words, and decoding by a join of ids with pieces.

encode: texts are split into words (pre-tokens) in blocks of documents. A block keeps the numbers of its words, at their positions, and lists each of its
words once. The lists are dealt by a hash of the word, so that a task meets a word of all blocks; its part of the table of distinct words encodes the word once. The ids
return to their blocks, where each position takes its word's ids. A word that fills a third of the corpus is listed once a block. Lists travel packed, for each block and
part of the table. Blocks are dealt once, and both ways read this exchange. A block's key holds a hash of what is in it: should a lost task, when it
runs again, get its rows in another order, its words don't meet other numbers, but an error is raised.

A task holds its part of the table: the distinct words over the number of parts, which grows with the stored input up to PARTS.

decode: rows of about CHUNK_IDS ids list their distinct ids; these are joined with the table of pieces, a row for each id of the vocabulary. The table is
broadcast: it is as large as the vocabulary, at most MAX_PIECES, whatever the corpus. The join keeps rows in their places, so no shuffle is needed to lay
pieces at the ids' positions; a chunk that isn't complete raises an error.

Null and empty texts have no ids and decode to the empty text. Special strings in a text are their own ids, as the library has it. Ids outside the
vocabulary decode to nothing. Repeated rows and null doc_ids stay as they are; texts of any length are whole; an empty table gives no rows; columns beside
doc_id and text are left aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import common, tokenfile
from tidewright.llm.bpe import pack, unpack
from tidewright.llm.segments import Ragged, WordTable, byte_letters, gather, spread

#: Bytes of text of a block; a longer text is a block by itself.
BLOCK_BYTES = 8 << 20
#: Parts of the table of distinct words, at most: more would leave a list of a few words for each block and part.
PARTS = 16_384
LISTS = pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary()), ("no", pa.binary())]))
#: Ids of a chunk in decoding, about.
CHUNK_IDS = 1 << 19
#: Largest vocabulary whose pieces are broadcast.
MAX_PIECES = 2_000_000


@lru_cache(2)
def special(path: str) -> tuple[str, ...]:
    """The strings that the library takes out of a text before it splits it."""
    added = tokenfile.library(path).get_added_tokens_decoder().values()
    for t in added:
        if t.lstrip or t.rstrip or t.single_word or t.normalized:
            raise ValueError(f"{path}: special strings that take in what is beside them aren't supported")
    return tuple(sorted((t.content for t in added), key=len, reverse=True))


def splitter(path: str) -> Callable[[str], list[str]]:
    """A text's words and special strings, in order."""
    find = regex.compile(PATTERN).findall
    if not (strings := special(path)):
        return find
    cut = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")").split
    starts = {s[0] for s in strings}

    def words(text: str) -> list[str]:
        if not any(c in text for c in starts):
            return find(text)
        out = []
        for k, part in enumerate(cut(text)):
            out += [part] if k % 2 else find(part)
        return out

    return words


def placed(docs: DataFrame, path: str, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: its documents, how many words each has, the words' numbers by position, and for each part of the table the block's words, in order, and their numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, find = TaskContext.get().partitionId(), splitter(path)
        for k, part in enumerate(common.blocks(batches, size=block_bytes)):
            table = WordTable(None, find)
            words, size, code, n = table.numbers(part.column("text"))
            flat, starts = gather(words, np.concatenate([[0], np.cumsum(size)]), code, n)
            order = np.argsort(-np.bincount(flat, minlength=len(table.words)), kind="stable")
            rank = np.empty(len(order), np.uint32)  # frequent words get small numbers
            rank[order] = np.arange(len(order))
            held: dict[int, list] = {}
            for w, no in zip((w.encode() for w in table.words), rank.tolist(), strict=True):
                held.setdefault(zlib.crc32(w) % parts, []).append((w, no))
            lists = []
            for p, own in held.items():
                own.sort()
                lists.append({"part": p, "words": pack([w for w, _ in own]), "no": zstandard.compress(np.array([no for _, no in own], np.uint32).tobytes(), 1)})
            numbers, sizes = zstandard.compress(planes(rank[flat]), 1), np.diff(starts).tobytes()
            key = xxhash.xxh64_intdigest(b"".join([np.array([task, k]).tobytes(), sizes, numbers, *(x["words"] for x in lists)])) - (1 << 63)
            cells = [pa.array([key], pa.int64()), pa.array([part.column("doc_id")], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([numbers], pa.binary()), pa.array([lists], LISTS)]
            yield pa.RecordBatch.from_arrays(cells, ["block", "doc_ids", "sizes", "numbers", "lists"])

    return common.texts_of(docs).mapInArrow(common.freed(scan), "block long, doc_ids array<long>, sizes binary, numbers binary, lists array<struct<part int, words binary, no binary>>")


def planes(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on: these compress better."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each list of a block: block, part, words."""
    for batch in batches:
        for k in range(batch.num_rows):
            lists = batch.column("lists").slice(k, 1).flatten()
            key = np.full(len(lists), batch.column("block")[k].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), lists.field("part"), lists.field("words")], ["block", "part", "words"])


def encoded_lists(lists: DataFrame, path: str) -> DataFrame:
    """block, part and words, dealt by part, to block, part and the ids of these words. A task encodes a distinct word once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, strings = tokenfile.table(path), {s.encode() for s in special(path)}
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for words in batch.column("words").to_pylist():
                words = unpack(words)
                for w in words:
                    if w not in known:
                        text = w.decode()
                        known[w] = np.array(table.whole(text) if w in strings else table.encode(text), table.dtype).tobytes()
                out.append(pack(list(map(known.__getitem__, words))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(out, pa.binary())], ["block", "part", "ids"])

    return lists.mapInArrow(common.freed(scan), "block long, part int, ids binary")


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    n = common.parts(docs)
    parts = min(n, PARTS)
    blocks = placed(docs, path, parts, block_bytes).repartition(n, "block")
    lists = blocks.mapInArrow(listed, "block long, part int, words binary").repartition(parts, "part")
    found = encoded_lists(lists, path).groupBy("block").agg(F.collect_list(F.struct("part", "ids")).alias("found"))  # a row for each of the block's lists

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokenfile.table(path).dtype
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                got = {x["part"]: x["ids"] for x in row.column("found")[0].as_py() or ()}
                lists = row.column("lists")[0].as_py()
                if len(got) != len(lists):
                    raise RuntimeError("a block doesn't meet its words: its rows came in another order when a task ran again")
                no, many, flat = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], [np.empty(0, dtype)]
                for x in lists:
                    body = zstandard.decompress(got[x["part"]])
                    n = int(np.frombuffer(body, np.uint32, 1)[0])
                    no.append(np.frombuffer(zstandard.decompress(x["no"]), np.uint32))
                    many.append(np.frombuffer(body, np.uint32, n, 4).astype(np.int64) // dtype().itemsize)
                    flat.append(np.frombuffer(body, dtype, offset=4 + 4 * n))
                no, many, flat = np.concatenate(no), np.concatenate(many), np.concatenate(flat)
                order, ends, table = np.argsort(no), np.concatenate([[0], np.cumsum(many)]), Ragged(np.int32)
                table.add(flat[spread(ends[order], many[order])], many[order])
                sizes = np.frombuffer(row.column("sizes")[0].as_py(), np.int64)
                numbers = from_planes(zstandard.decompress(row.column("numbers")[0].as_py()))
                out, starts = gather(table.flat, table.ends, numbers, sizes)
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))], ["doc_id", "ids"])

    # lay takes all columns, so that none is pruned below and both ways have one exchange
    return blocks.join(found, "block", "left").mapInArrow(common.freed(lay), "doc_id long, ids array<int>")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id and the bytes it stands for, a row for each id of the vocabulary."""
    vocabulary, strings = tokenfile.library(path).get_vocab(with_added_tokens=True), set(special(path))
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
    byte = {c: b for b, c in byte_letters().items()}

    def plain(piece: str) -> bytes:
        return bytes(map(byte.__getitem__, piece)) if piece not in strings and all(c in byte for c in piece) else piece.encode()

    rows = pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(map(plain, vocabulary), pa.binary())})
    return spark.createDataFrame(rows)


def decode(encoded: DataFrame, path: str, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """doc_id, ids, id_bytes (the ids as little-endian unsigned 32-bit integers) and decoded of rows of doc_id and ids; null ids are none."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            ids = batch.column("ids").fill_null([])
            sizes = np.asarray(pc.list_value_length(ids)).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + chunk_ids, "right")))
                flat = ids.slice(at, to - at).flatten().to_numpy()
                distinct = pc.unique(pa.array(flat)).to_numpy()
                order = np.argsort(distinct)
                codes = order[np.searchsorted(distinct, flat, sorter=order)] if len(flat) else flat
                head = [[seq], [batch.column("doc_id").slice(at, to - at)], [sizes[at:to].tobytes()], [codes.astype(np.uint32).tobytes()], [len(distinct)]]
                n = len(distinct)
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
                cells = [pa.concat_arrays([pa.array(v, t), pa.array([seq] * n, t) if k == 0 else pa.nulls(n, t)]) for k, (v, t) in enumerate(zip(head, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([*cells, pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(distinct, pa.int32())])], ["seq", "doc_ids", "sizes", "codes", "n", "id"])
                seq, at = seq + 1, to

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, got, ids = None, [], []

        def done() -> pa.RecordBatch:
            distinct, piece = np.concatenate(ids), pa.concat_arrays(got).fill_null(b"")
            if len(distinct) != head["n"]:
                raise RuntimeError(f"{len(distinct)} of {head['n']} pieces of a chunk came together")
            sizes, codes = np.frombuffer(head["sizes"], np.int64), np.frombuffer(head["codes"], np.uint32).astype(np.int64)
            body, at = common.raw(piece)
            flat, starts = gather(body, at, codes, sizes)
            raw, cut = flat.tobytes(), starts.tolist()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
            whole = distinct[codes].astype(np.int32)
            stops = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(whole))
            raws = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * stops).astype(np.int32)), pa.py_buffer(whole.astype("<i4"))])
            return pa.RecordBatch.from_arrays([pa.array(head["doc_ids"], pa.int64()), lists, raws, pa.array(texts, pa.string())], ["doc_id", "ids", "id_bytes", "decoded"])

        for batch in batches:
            heads = np.flatnonzero(np.asarray(batch.column("n").is_valid())).tolist()
            for a, b in zip([0, *heads], [*heads, batch.num_rows], strict=True):
                if a in heads and (a or b):
                    if head is not None:
                        yield done()
                    row = batch.slice(a, 1)
                    head, got, ids = {c: row.column(c)[0].as_py() for c in ("doc_ids", "sizes", "codes", "n")}, [pa.array([], pa.binary())], [np.empty(0, np.int64)]
                    a += 1
                if b > a:
                    if head is None:
                        raise RuntimeError("pieces came before their chunk")
                    part = batch.slice(a, b - a)
                    got.append(part.column("piece"))
                    ids.append(part.column("id").to_numpy().astype(np.int64))
        if head is not None:
            yield done()

    rows = encoded.select("doc_id", "ids").mapInArrow(chunks, "seq long, doc_ids array<long>, sizes binary, codes binary, n long, id int")
    joined = rows.join(F.broadcast(pieces(encoded.sparkSession, path)), "id", "left").select("doc_ids", "sizes", "codes", "n", "id", "piece")
    return joined.mapInArrow(common.freed(lay), "doc_id long, ids array<int>, id_bytes binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the two hashes of decoded rows."""
    return decoded.select("doc_id", (F.length("id_bytes") / 4).cast("long").alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
