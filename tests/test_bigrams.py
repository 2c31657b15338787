"""Bigrams: one shuffle of what follows a word in a block of texts, and each text's words found once."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewright.functions.strings import TOKEN
from tidewright.operators import language as L
from tidewright.plans import language

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bigram_model", "dialogue_bigrams"])
def test_one_shuffle_and_words_found_once(spark, name):
    plan = getattr(language, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "regexp_extract_all" not in plan


def brute(texts):
    n = Counter(p for w in texts if w is not None for p in zip(w, w[1:]) if p[0] is not None)
    total = Counter()
    for (a, _), k in n.items():
        total[a] += k
    return {(a, b, k, total[a]) for (a, b), k in n.items()}


@pytest.mark.parametrize("block", [1, 7, 1000])
@pytest.mark.parametrize("text", [True, False])
def test_blocks_add_up(monkeypatch, block, text):
    """Texts without words, of one word, null texts and words, and a word that many blocks have."""
    monkeypatch.setattr(L, "BLOCK_WORDS", block)
    monkeypatch.setattr(L, "BLOCK_ROWS", 3)
    deal = random.Random(block)
    texts = [None, [], ["a"], ["a", "a"], [], *([deal.choice("aaaabcdя9") for _ in range(deal.randrange(12))] for _ in range(60)), []]
    if not text:
        texts += [["a", None, "b", None, None], [None], [None, "a"]]
    kind = pa.string() if text else pa.list_(pa.string())
    rows = [None if w is None else "- " + ", ".join(w) + "!" if text else w for w in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + 5], kind)], ["w"]) for k in range(0, len(rows), 5)]
    packed = [r for b in L.counted_pairs(iter(batches)) for r in b.to_pylist()]
    packed.sort(key=lambda r: r["w1"])
    schema = pa.schema({"w1": pa.string(), "w2": pa.list_(pa.string()), "n": pa.list_(pa.int64())})
    dealt = [pa.RecordBatch.from_pylist(packed[k : k + 4], schema) for k in range(0, len(packed), 4)]
    got = [tuple(r.values()) for b in L.summed_pairs(iter(dealt)) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == brute(texts)


def test_blocks_of_columns_without_nulls(monkeypatch):
    """As a join with asked words leaves them."""
    monkeypatch.setattr(L, "BLOCK_WORDS", 2)
    items = lambda kind: pa.list_(pa.field("element", kind))
    schema = pa.schema([pa.field("w1", pa.string(), False), ("w2", items(pa.string())), ("n", items(pa.int64()))])
    rows = [{"w1": w, "w2": ["x", "y"], "n": [1, 2]} for w in "aaabbc"]
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 1], schema) for k in range(6)]
    got = {tuple(r.values()) for b in L.summed_pairs(iter(batches)) for r in b.to_pylist()}
    assert got == {(w, x, times * n, times * 3) for w, times in (("a", 3), ("b", 2), ("c", 1)) for x, n in (("x", 1), ("y", 2))}


def test_nothing_gives_nothing():
    empty = pa.RecordBatch.from_arrays([pa.array(["", None, "?"])], ["w"])
    assert not sum(len(b) for b in L.counted_pairs(iter([empty]))) and not list(L.counted_pairs(iter([]))) and not list(L.summed_pairs(iter([])))


def test_words_are_those_of_the_token_function(spark):
    odd = ["", None, "one", "Ёлка ЁЖ жук", "KKelvin İst ΑΣ ß", "a\x00b a😀".encode("utf-16", "surrogatepass").decode("utf-16"), "x_y x-y 1٣2", "Слово слово СЛОВО́ дом"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    lists = df.select(language.S.tokens(df.text).alias("w"))
    texts = df.select(language.lowered(df.text))
    want = brute([r.w for r in lists.collect()])
    for words in (lists, texts):
        got = {(r.w1, r.w2, r.n): r.cost for r in L.bigrams(words).collect()}
        assert got == {(a, b, n): pytest.approx(np.log(t) - np.log(n)) for a, b, n, t in want}
    assert re.fullmatch(TOKEN, "дом")


def test_asked_first_words_alone(spark):
    words = spark.createDataFrame([(["a", "b", "a", "c"],), (["b", "c"],)], "w array<string>")
    got = {(r.w1, r.w2, r.n) for r in L.bigrams(words, spark.createDataFrame([("a",), ("z",)], "w1 string")).collect()}
    assert got == {("a", "b", 1), ("a", "c", 1)}
