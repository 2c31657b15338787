"""Words encoded once against the library, and decoding by pieces."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidewright.llm import queries, wordbpe

JSON = P.path("byte_bpe_50k.json")
PARTS = ["a", "the", "'s", "'", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!", "...", "　", "ing", "<|endoftext|>", "<|", "<", "|>", "😀", "\r\n", "_", " un", "ti", "-", "\x85", "\xa0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def matches(got, rows, library):
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=str) == want


def check(spark, rows, library, block_bytes=wordbpe.BLOCK_BYTES, chunk_ids=wordbpe.CHUNK_IDS):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, block string")  # extra columns clash with results
    got = wordbpe.decode(wordbpe.encode(docs, JSON, block_bytes), JSON, chunk_ids).collect()
    matches(got, rows, library)
    for r in got:
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False) and r.id_bytes == np.array(r.ids, "<u4").tobytes()
    return got


def test_against_the_library(spark, library):
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", "a" * 5000, "word " * 3000, *("".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(400)), "same text", "same text", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>"]
    rows = [(None if k % 50 == 3 else k // 2, t) for k, t in enumerate(texts)]
    check(spark, rows, library)


@pytest.mark.parametrize(("block_bytes", "chunk_ids", "rows_a_batch"), [(3000, 40, 10_000), (1 << 20, 1 << 19, 64), (50_000, 5000, 1)])
def test_long_texts_many_blocks_and_chunks(spark, library, block_bytes, chunk_ids, rows_a_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))
    try:
        check(spark, [(k, t) for k, t in enumerate([long, None, "x", long, *(f"text {k} the" for k in range(200))])], library, block_bytes, chunk_ids)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_more_than_65536_words_in_a_block(spark, library):
    check(spark, [(1, " ".join(f"q{k}z" for k in range(70_000))), (2, "q1z q2z")], library)


def test_no_words_at_all(spark, library):
    check(spark, [(1, None), (2, ""), (None, None)], library)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wordbpe.digests(wordbpe.decode(wordbpe.encode(none, JSON), JSON)).count() == 0


def test_ids_outside_the_vocabulary_and_broken_characters(spark, library):
    cut = library.encode("😀", add_special_tokens=False).ids[:1]
    rows = [(1, [15, 999_999, 16]), (2, cut), (3, None), (4, [])]
    got = {r.doc_id: r.decoded for r in wordbpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), JSON).collect()}
    assert got == {1: library.decode([15, 16], skip_special_tokens=False), 2: library.decode(cut, skip_special_tokens=False), 3: "", 4: ""}


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op11_word_bpe"](spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want
