"""Data-parallel training against a run over the same batches in one process, row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import training as T

NETS = {"a": [("dense", 5), "tanh", ("dense", 3)], "b": [("dense", 4), "relu", ("dense", 4), "elu", ("dense", 3)], "c": [("dense", 3)], "d": [("dense", 4), "sigmoid", ("dense", 3)]}
SCHEMA = "key long, x array<float>, y int, step string"


def sample(n=240, size=6, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(3, size)) * 2
    y = rng.integers(0, 3, n)
    return [(int(k), [float(v) for v in np.float32(middle[c] + rng.normal(size=size))], int(c), "") for k, c in enumerate(y)]


@pytest.mark.parametrize("name", sorted(NETS))
def test_slopes(name):
    x, y = np.random.default_rng(1).normal(size=(7, 6)), np.array([0, 1, 2, 0, 1, 2, 0])
    weights = T.started(NETS[name], 6, 3)
    _, _, slopes = T.gradients(NETS[name], weights, x, y)
    for w, s in zip(weights, slopes, strict=True):
        for at in np.ndindex(w.shape):
            old, loss = w[at], []
            for e in (1e-6, -1e-6):
                w[at] = old + e
                loss.append(T.gradients(NETS[name], weights, x, y)[0])
            w[at] = old
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(s[at], abs=1e-5)


def plain(batches, test, epochs, rate, seed, size):
    """Net c: one dense layer, by loops over rows, with momentum."""
    w, b = (v.copy() for v in T.started(NETS["c"], size, seed))
    vw, vb, out = np.zeros_like(w), np.zeros_like(b), []

    def shares(x):
        z = [sum(x[i] * w[i, o] for i in range(size)) + b[o] for o in range(3)]
        total = sum(math.exp(v - max(z)) for v in z)
        return [math.exp(v - max(z)) / total for v in z]

    for epoch in range(1, epochs + 1):
        met = []
        for k in np.random.default_rng([seed, epoch]).permutation(len(batches)).tolist():
            gw, gb, loss, right = np.zeros_like(w), np.zeros_like(b), 0.0, 0
            for x, y in batches[k]:
                p = shares(x)
                loss -= math.log(p[y])
                right += max(range(3), key=p.__getitem__) == y
                for o in range(3):
                    d = p[o] - (o == y)
                    gb[o] += d
                    for i in range(size):
                        gw[i, o] += x[i] * d
            n = len(batches[k])
            met.append((loss / n, right / n))
            vw, vb = 0.9 * vw + gw / n, 0.9 * vb + gb / n
            w, b = w - rate * vw, b - rate * vb
        found = [(-math.log(shares(x)[y]), max(range(3), key=shares(x).__getitem__) == y) for x, y in test]
        out.append((*np.mean(met, axis=0), *np.mean(found, axis=0)))
    return w, b, out


def test_against_loops_over_the_same_batches(spark, monkeypatch):
    monkeypatch.setattr(T, "FAN", 2)  # sums meet in a tree
    rows, test = sample(), sample(60, seed=5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    weights, curves = T.train(df, spark.createDataFrame(test, SCHEMA), {"c": NETS["c"]}, 6, 3, 4, 0.1, "momentum", seed=7)
    step = {r.key: r.s for r in df.select("key", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(4)).alias("s")).collect()}
    batches = [[(x, y) for k, x, y, _ in rows if step[k] == s] for s in range(4)]
    w, b, out = plain(batches, [(x, y) for _, x, y, _ in test], 3, 0.1, 7, 6)
    assert np.allclose(weights["c"][0], w, atol=1e-9) and np.allclose(weights["c"][1], b, atol=1e-9)
    assert [c[:2] for c in curves] == [("c", 1), ("c", 2), ("c", 3)]
    assert np.allclose([c[2:] for c in curves], out, atol=1e-9)


def test_nets_side_by_side_are_as_alone_and_learn(spark):
    rows, test = spark.createDataFrame(sample(600), SCHEMA), spark.createDataFrame(sample(600)[:200], SCHEMA)
    both, curves = T.train(rows, test, {"a": NETS["a"], "b": NETS["b"]}, 6, 2, 2, 0.05, seed=2)
    alone, _ = T.train(rows, test, {"b": NETS["b"]}, 6, 2, 2, 0.05, seed=2)
    assert all(np.allclose(v, w, atol=1e-9) for v, w in zip(both["b"], alone["b"], strict=True))
    assert all(c[5] > {1: 0.4, 2: 0.6}[c[1]] for c in curves)
    found = T.predicted(test, NETS["b"], both["b"], 6)
    assert found.where("predicted = y").count() / 200 == pytest.approx(next(c[5] for c in curves if c[:2] == ("b", 2)))


def test_rows_that_cannot_be_used(spark):
    rows = [(1, [1.0, 2.0], 0, ""), (None, [1.0, 2.0], 1, ""), (2, None, 0, ""), (3, [1.0], 0, ""), (4, [None, 1.0], 0, ""), (5, [1.0, 1.0], None, ""), (6, [1.0, 1.0], 9, ""), (7, [float("inf"), 1.0], 0, ""), (8, [float("nan"), 1.0], 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    net = {"n": [("dense", 2)]}
    assert T.usable(df, 2, 2).count() == 2
    weights, curves = T.train(df, df.limit(0), net, 2, 1, 3, 0.1)
    assert np.isfinite(weights["n"][0]).all() and math.isnan(curves[0][4])
    weights, curves = T.train(df.limit(0), df, net, 2, 1, 2, 0.1)
    assert np.array_equal(weights["n"][0], T.started(net["n"], 2, 0)[0]) and math.isnan(curves[0][2]) and curves[0][5] >= 0


def test_batches_are_read_from_their_folders_alone(spark, tmp_path):
    spark.createDataFrame([(1.0, k) for k in range(4)], "x double, step int").write.partitionBy("step").parquet(f"file://{tmp_path}/rows")
    plan = spark.read.parquet(f"file://{tmp_path}/rows").where("step = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(step" in plan
