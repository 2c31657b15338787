"""Token files, byte-level BPE and token counts against their libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidewright.llm import bpe, queries, segments, tokencount, tokenfile

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "the", "'s", "'re", "'", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!", "...", " ", "　", "ing", "'ll", "<|endoftext|>", "😀", "'S", "\r\n", "_", " un", "ti", "-"]


def texts(n=300):
    rng = random.Random(3)
    return [None, "", " ", "\n\n", "a" * 5000, "word " * 3000, *("".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)), "same text", "same text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * i % 1000, t, "x", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")  # extra columns clash with results


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_counts(docs, library):
    got = {r.doc_id: r for r in tokencount.token_counts(docs, JSON, 50).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 50), r.text


def test_chunk_maps_compose():
    """A pre-token far longer than a chunk gives chunks whose maps aren't constant."""
    machine, lib = tokencount.transducer(JSON), Tokenizer.from_file(JSON)
    for t in ("x" * 3000, "abcdefg" * 700 + "!" * 900, "thing" * 400 + " " + "1234" * 300):
        data = np.frombuffer(t.encode(), np.uint8)
        assert machine.counts(data, np.array([0, len(data)]))[0] == len(lib.encode(t, add_special_tokens=False).ids)


def test_token_file(spark, docs, library):
    manifest = tokenfile.write_tokens(docs, JSON)
    got = tokenfile.digests(tokenfile.read_tokens(spark, manifest)).orderBy("start").collect()
    at = 0
    for r, row in zip(got, docs.orderBy("doc_id", "text").collect(), strict=True):
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    reader = tokenfile.Reader(manifest[0]["file"])
    ids, mask = reader.row(0)
    assert len(ids) == len(mask) == tokenfile.LENGTH and not ids.flags.owndata  # a view of the file
    last, mask = reader.row(int(reader.rows[-1]) - 1)
    assert sum(mask.to_pylist()) == (manifest[0]["n_ids"] - 1) % tokenfile.LENGTH + 1


def test_bpe_round_trip(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs, RANKS, 50), RANKS)).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids), r.text
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert tokencount.token_counts(none, JSON).count() == 0
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0
    assert tokenfile.digests(tokenfile.read_tokens(spark, tokenfile.write_tokens(none, JSON))).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (3, "c")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in tokencount.token_counts(df, JSON).collect()) == [0, 1, 2]
    assert sorted(len(r.ids) for r in bpe.encode(df, RANKS).collect()) == [0, 1, 2]
    got = tokenfile.read_tokens(spark, tokenfile.write_tokens(df, JSON)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(None, 1), (None, 3), (3, 2)]


def test_white_space_and_tables_begun_anew(library, monkeypatch):
    """Spaces beside any white space, and a table of words that overflows again and again."""
    monkeypatch.setattr(segments, "MAX_WORDS", 40)
    rng, table = random.Random(1), tokenfile.table(JSON)
    white = ["\n", " ", "\t", "\u3000", "\xa0", "\x1c", "\x85", "a", "!", "1", "'s", ",", ".", "é", "<|endoftext|>", " the"]
    for _ in range(40):
        some = ["".join(rng.choices(white, k=rng.randint(0, 9))) + f" w{rng.random()}," for _ in range(30)] + [None, "", " \xa0 \xa0"]
        ids, at = table.ids(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_digests_as_read(spark, docs):
    manifest = tokenfile.write_tokens(docs, JSON)
    assert sorted(tokenfile.read_digests(spark, manifest).collect()) == sorted(tokenfile.digests(tokenfile.read_tokens(spark, manifest)).collect())


def test_queries_cover_the_table(spark):
    d = "/root/testdata/sf0.001"
    for name in ("op4_token_file", "op5_byte_bpe", "op9_token_counts"):
        assert queries.QUERIES[name](spark, d).count() == 200
