"""Exact k-means against a plain loop, and its bounds against exact distances."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidewright.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, cluster string, v int"  # extra columns clash with results


def brute(rows, k, rounds, seed, size, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e)]
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(by[n]) for x in zip(*by[n], strict=True)] if n in by else c for n, c in enumerate(cents)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {}
    for _, n, d in found:
        total[n] = total.get(n, 0) + d
    return [(i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, n, d in found]


def rows_of(seed, n, size):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1, 0, 0.5, 1]) + rng.gauss(0, 0.1) for _ in range(size)], "x", 1) for i in range(n)]
    rows += rows[:7]  # repeated rows
    rows += [(n + k, rows[0][1], "x", 1) for k in range(20)]  # ties
    return [*rows, (None, rows[3][1], "x", 1), (900, None, "x", 1), (901, [], "x", 1), (902, [1.0] * (size + 1), "x", 1), (903, [None] + [1.0] * (size - 1), "x", 1), (904, [float("nan")] * size, "x", 1), (905, [float("inf")] * size, "x", 1)]


@pytest.mark.parametrize(("seed", "n", "size", "k"), [(1, 200, 8, 9), (2, 150, 64, 12), (3, 5, 3, 40)])
def test_against_a_plain_loop(spark, seed, n, size, k):
    rows = rows_of(seed, n, size)
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k, 4, 2, size, 256)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, k, 4, 2, size, 256), key=str)


def test_bounds_hold_and_screen():
    rng = np.random.default_rng(4)
    middle = rng.integers(-200, 200, (40, 64))
    v = (middle[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 64))).astype(np.int64)
    v[:50] = v[0]
    exact = ((v[:, None] - middle[None]) ** 2).sum(axis=2)
    short, small = centroids.compressed(v), centroids.compressed(middle)
    assert (((short[:, None] - small[None]) ** 2).sum(axis=2) <= exact * (1 + 1e-9) + 1e-6).all()
    at, d, done = centroids.nearest(v, short, middle)
    assert (at == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    assert done < 0.2 * exact.size


@pytest.mark.parametrize("spread", [1, 1 << 25])
def test_ties_go_to_the_smaller_number(spread):
    middle = np.array([[spread, 0, 0], [-spread, 0, 0], [spread, 0, 0]], np.int64)
    v = np.array([[0, 5, 0], [spread, 0, 0], [0, 0, 0]], np.int64)
    at, d, _ = centroids.nearest(v, centroids.compressed(v), middle)
    assert at.tolist() == [0, 0, 0] and d.tolist() == [spread**2 + 25, 0, spread**2]


def test_empty_and_too_large(spark):
    assert centroids.cluster(spark.createDataFrame([(1, [1.0], "", 1)], SCHEMA), 3, 2, 2).count() == 0
    with pytest.raises(PySparkException):
        centroids.cluster(spark.createDataFrame([(1, [1e9], "", 1)], SCHEMA), 1, 1, 2, 1).collect()


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = con.execute(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({queries.ORACLES['op12_centroids']}) order by all").fetchall()
    assert sorted(map(tuple, queries.QUERIES["op12_centroids"](spark, d).collect())) == want
