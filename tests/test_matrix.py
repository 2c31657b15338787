"""Block products against dense ones, and generation against a plain loop."""

import hashlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tidewright.operators import language as L
from tidewright.operators import matrix as M


def table(spark, a):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(a)], "row long, values array<double>")


def dense(blocks, shape, size):
    out = np.zeros(shape)
    for r in M.cells(blocks, size).collect():
        if r.r < shape[0] and r.c < shape[1]:
            out[r.r, r.c] = r.v
        else:
            assert r.v == 0
    return out


@pytest.mark.parametrize(("n", "k", "m", "size"), [(7, 5, 6, 3), (4, 4, 4, 4), (1, 9, 1, 2), (30, 3, 8, 2)])
def test_product(spark, monkeypatch, n, k, m, size):
    monkeypatch.setattr(M, "HELD", 2)
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    left, right = M.blocked(table(spark, a), size), M.blocked(table(spark, b), size)
    assert np.array_equal(dense(left, a.shape, size), a) and np.array_equal(dense(M.transposed(left, size), a.T.shape, size), a.T)
    assert np.allclose(dense(M.product(left, right, size), (n, m), size), a @ b)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (1, None), (2, [])], "row long, values array<double>")
    assert np.array_equal(dense(M.blocked(df, 2), (1, 2), 2), [[1.0, 0.0]])
    assert M.product(M.blocked(df.limit(0), 2), M.blocked(df, 2), 2).count() == 0


def test_shares_of_variance(spark):
    from tidewright.plans import numeric

    d = "/root/testdata/sf0.001"
    x = np.array([r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()], float)
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    got = numeric.explained_shares(spark, d).orderBy("k").collect()
    assert np.allclose([r.share for r in got], values / values.sum(), atol=2e-6) and np.allclose([r.running for r in got], np.cumsum(values) / values.sum(), atol=2e-6)


def test_generation(spark):
    texts = ["a b c a b d", "b c b c b", "e", "d a"]
    words = spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "key long, w array<string>")
    starts = [(k, t) for k, t in enumerate(["a", "b", "e", "zz", None, "d"] * 5)]
    n = Counter(p for t in texts for p in pairwise(t.split()))
    want = []
    for key, term in starts:
        for pos in range(9):
            want.append((key, pos, term))
            after = sorted(((c, w2) for (w1, w2), c in n.items() if w1 == term), key=lambda x: (-x[0], x[1]))
            if not after or pos == 8:
                break
            at = int(hashlib.md5(f"3:{key}:{pos}".encode()).hexdigest()[:8], 16) % sum(c for c, _ in after)
            for c, w2 in after:
                if at < c:
                    term = w2
                    break
                at -= c
    got = L.generated(spark.createDataFrame(starts, "key long, term string"), words, 8, 3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
