"""Boosted trees against a plain loop over rows, and what they learn."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import boosting as B
from tidewright.sources import tables

SCHEMA = "key long, features array<double>, label int, score string"


def plain(rows, trees, depth, rate, l2, least_weight, edges):
    """The same by trying every split for the rows of each node."""
    margin, out = [0.0] * len(rows), []
    for tree in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - r[1] for a, r in zip(p, rows, strict=True)], [a * (1 - a) for a in p]

        def grow(node, own, level):
            G, H = sum(g[i] for i in own), sum(h[i] for i in own)
            best = (1e-9, None)
            for f in range(len(edges)) if level < depth else ():
                for e in edges[f]:
                    left = [i for i in own if rows[i][0][f] < e]
                    GL, HL = sum(g[i] for i in left), sum(h[i] for i in left)
                    if HL >= least_weight and H - HL >= least_weight:
                        gain = GL**2 / (HL + l2) + (G - GL) ** 2 / (H - HL + l2) - G**2 / (H + l2)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, e, left))
            if best[1] is None:
                value = -rate * G / (H + l2)
                out.append((tree, node, None, None, round(value, 9)))
                for i in own:
                    margin[i] += value
                return
            f, e, left = best[1]
            out.append((tree, node, f, e, None))
            grow(2 * node + 1, left, level + 1)
            grow(2 * node + 2, [i for i in own if i not in set(left)], level + 1)

        grow(0, list(range(len(rows))), 0)
    return sorted(out, key=str), [1 / (1 + math.exp(-m)) for m in margin]


@pytest.fixture
def rows():
    rng = random.Random(9)
    out = []
    for k in range(240):
        x = [rng.gauss(0, 1), float(rng.randrange(4)), rng.random(), 1.0]
        out.append((k, x, int(x[0] + (x[1] == 2) - x[2] + rng.gauss(0, 0.4) > 0), "s"))
    return out


@pytest.mark.parametrize("tasks", [1, 3])
def test_against_a_plain_loop(spark, monkeypatch, rows, tasks):
    monkeypatch.setattr(B, "TASK_ROWS", -(-len(rows) // tasks))
    df = spark.createDataFrame(rows, SCHEMA)
    edges = B.bin_edges(df, 4, 8)
    model = B.train(df, trees=3, depth=3, rate=0.3, bins=8)
    want, scores = plain([(x, y) for _, x, y, _ in rows], 3, 3, 0.3, 1.0, 1.0, edges)
    got = [(r.tree, r.node, r.feature, r.threshold, None if r.value is None else round(r.value, 9)) for r in model.collect()]
    assert sorted(got, key=str) == want
    again = {r.key: r.score for r in B.scored(df.drop("score"), model).collect()}
    assert all(again[k] == pytest.approx(s) for (k, *_), s in zip(rows, scores, strict=True))


def test_a_stored_model_scores_as_before(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).drop("score")
    model = B.train(df, trees=20)
    tables.write_model(model, str(tmp_path / "trees"))
    back = tables.read_model(spark, str(tmp_path / "trees"), B.MODEL)
    assert back.schema == model.schema
    assert sorted(B.scored(df, back).collect()) == sorted(B.scored(df, model).collect())


def test_learns_rows_it_never_saw(spark):
    rng = random.Random(2)
    rows = [(k, [rng.random(), rng.random(), rng.random()], None, "") for k in range(3000)]
    df = spark.createDataFrame([(k, x, int((x[0] > 0.5) != (x[1] > 0.3)), s) for k, x, _, s in rows], SCHEMA).drop("score")
    found = B.scored(df.where("key % 3 = 0"), B.train(df.where("key % 3 > 0"), trees=100))
    assert found.where("prediction = label").count() > 0.97 * found.count()


def test_more_rows_than_the_bound_and_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).drop("score")
    assert B.train(df, trees=3, most_rows=50).count() > 3
    odd = spark.createDataFrame([(1, [None, float("nan")], 1), (2, [5.0, 1.0], 0), (3, None, 1), (4, [1.0, 2.0], None), (5, [2.0], 1), (6, [], 0)], "key long, features array<double>, label int")
    model = B.train(odd, trees=2)
    assert {r.key: r.prediction for r in B.scored(odd, model).collect()}.keys() == {1, 2, 3, 4, 5, 6}
    assert [r.score for r in B.scored(odd, B.train(odd.limit(0))).collect()] == [0.5] * 6
    assert B.scored(odd.limit(0), model).count() == 0


def test_junk_pages(spark):
    from tidewright.plans import pages

    known, new = pages.spam_split(spark, "/root/testdata/sf0.01")
    assert known.count() + new.count() == 250 and known.select("page_id").intersect(new.select("page_id")).count() == 0
    assert 0.02 < known.agg({"label": "avg"}).first()[0] < 0.9
    q = pages.page_spam_quality(spark, "/root/testdata/sf0.01").first()
    assert q.n == new.count() and q.accuracy > 0.85 and q.f1 > 0.5


def test_a_page_is_read_once(spark):
    from tidewright.plans import pages

    for df in (pages.marked(spark, "/root/testdata/sf0.001"), pages.page_features(spark, "/root/testdata/sf0.001")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("<head") == 1


def test_pages_of_six_gigabytes_need_no_exchange():
    assert B.tasks_of(520_000, 12) == 1


def test_features_with_one_bin(spark, rows):
    def model(rows, shift):
        found = B.train(spark.createDataFrame(rows, SCHEMA), trees=3).collect()
        return [(r.tree, r.node, None if r.feature is None else r.feature - shift, r.threshold, None if r.value is None else round(r.value, 9)) for r in found]

    assert model([(k, [0.0, *x, 7.0], y, s) for k, x, y, s in rows], 1) == model(rows, 0)


def test_all_rows_train(spark):
    """More than the 4 000 000 that were the bound."""
    n = 4_100_000
    rows = spark.range(n).select(F.col("id").alias("key"), F.array(F.lit(1.0)).alias("features"), F.lit(0).alias("label"))
    leaf = B.train(rows, trees=1, depth=1).first()
    assert leaf.value == pytest.approx(-0.1 * (n / 2) / (n / 4 + 1), rel=1e-12)


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [([rng.choice((0.0, 1.5, 7.0)), rng.gauss(0, 1), None if rng.random() < 0.5 else rng.random(), None, 3.0],) for _ in range(700)]
    df = spark.createDataFrame([*rows, ([2.0],), (None,), ([],)], "features array<double>")
    shares = [k / 32 for k in range(1, 32)]
    want = df.agg(*(F.percentile(F.get("features", F.lit(k)), shares) for k in range(5))).first()
    assert B.quantiles(df, 5, shares) == [list(w or []) for w in want]
    assert B.quantiles(df.limit(0), 2, shares) == [[], []]
