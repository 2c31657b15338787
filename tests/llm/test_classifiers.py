"""Quality, toxicity and language against held-out labels."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import common, langid, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"


def test_quality(spark):
    got = {r.doc_id: r for r in queries.op1_quality(spark, DATA).collect()}
    assert len(got) == 1000
    labels = {r.doc_id: r.quality for r in common.table(spark, DATA, "labels").collect()}
    good = [got[i].quality_keep for i, q in labels.items() if q == 1]
    junk = [got[i].quality_keep for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.2


def test_quality_of_labels_never_seen(spark):
    """Both views and their mean, fitted to half of the labels and held against the others."""
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    half = common.crc_mod(F.col("doc_id"), 2) == 0
    got = quality.score(docs, quality.train(docs, labels.where(half))).join(labels.where(~half), "doc_id").toPandas()
    for column in ("quality_text", "quality_meta", "quality_score"):
        keep = got[column] >= quality.KEEP
        assert keep[got.quality == 1].mean() > 0.97 and keep[got.quality == 0].mean() < 0.25, column


def test_columns_of_documents_stay(spark):
    docs = spark.createDataFrame([(1, "abc", 0.25, True), (2, "", 0.5, None)], "doc_id long, text string, quality_score double, quality_keep boolean")
    for model in (None, quality.train(common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels"))):
        got = quality.kept_rows(docs, model)
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {(1, "abc", 0.25, True)}


def test_letters_of_whole_texts():
    """The share of letters is of all characters, at any length."""
    for text in ("ab1 " * 300, "ab1 " * 999, "ab1 " * 1499 + "abc", "a" * 3999, "a1" * 2000, "1" * 5000 + "a" * 5000, "a1" * 9000, ""):
        assert quality.meta_view(text, None, None)[3] == sum(c.isalpha() for c in text) / max(1, len(text))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1.0), (2, "", "en", "s", 2.0), (3, "some text", None, "s", 3.0), (3, "some text", None, "s", 3.0), (None, "x" * 50000, "en", None, 4.0)], "doc_id long, text string, lang string, source string, quality_score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, none))
    assert {(r.doc_id, r.quality_keep) for r in got.collect()} == {(1, False), (2, False), (3, True), (None, True)}
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0), (9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 5
    assert quality.score(docs.limit(0), None).count() == 0
    wide = docs.drop("lang", "source")
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc "), 40)) for _ in range(30)] + ["".join(rng.choice(list("!?% "), 40)) for _ in range(30)]
    two = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(two, marks)
    assert all(r.quality_keep == (r.doc_id < 30) for r in quality.score(two, model).collect())
    assert quality.score(wide, model).count() == 5


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = np.tile([0.0, 1.0], 200).astype(np.float32)
    a = (y[:, None] * 2 - 1 + 0.5 * rng.standard_normal((400, 4))).astype(np.float32)
    b = (y[:, None] * 2 - 1 + 0.5 * rng.standard_normal((400, 4))).astype(np.float32)
    one, two = quality.cotrain((a[:20], b[:20]), y[:20], (a[20:300], b[20:300]))
    both = one.odds(a[300:]) + two.odds(b[300:])
    assert ((both > 0) == y[300:]).mean() > 0.97
    assert quality.cotrain((a[:20], b[:20]), np.ones(20, np.float32), (a[20:], b[20:])) is None


def test_toxicity(spark):
    """Fitted to the training folds of the larger tables, held against the other fold."""
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text, toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    sample = [r for r in train if r[2]][:400] + [r for r in train if not r[2]][:800]
    scorer = toxicity.Scorer(toxicity.fit([r[1] for r in sample], np.array([r[2] for r in sample])))
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1][:700]
    score = scorer.scores([r[1] for r in test])
    y = np.array([r[2] for r in test])
    assert (score[y == 1] >= 0.7).mean() > 0.85 and (score[y == 0] >= 0.7).mean() < 0.03
    assert scorer.scores(["", "!!", "a " * 5000]).shape == (3,)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(5, 7)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs = net.inputs([(-1,), (1, 2, 3), (0, 4), (5,), (2, 1, 7)])
    rows = rng.integers(1, 5, (6, toxicity.WINDOW))
    rows[0, 20:] = 0
    y, w = np.array([0, 1, 1, 0, 1, 0], float), np.ones(6)

    def loss():
        x = net.project(net.embed(*inputs))
        p = toxicity.sigmoid(net.logits(x, rows).astype(float))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.step(inputs, rows, y, w)
    for name in ("out", "att", "uf", "wb", "bf", "word", "gram"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4), name


def test_windows_cover_texts():
    code = np.arange(1, 101)
    rows, text = toxicity.windows(code, np.array([0, 100, 100]))
    assert set(rows[text == 0].ravel()) == set(range(1, 101)) and (rows[text == 1] == 0).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you loser"), (3, "you loser"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), {"constant": 1.0}).count() == 0


def test_toxicity_query(spark):
    """The query end to end: held-out rows by labels it never saw, extra columns that clash, null ids."""
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = common.table(spark, "/root/testdata/sf0.1", "labels").toPandas().set_index("doc_id")["toxic"]
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got[got.held_out & got.doc_id.isin(labels.index)]
    y = labels.loc[held.doc_id].to_numpy()
    order = held.score.rank().to_numpy()
    area = (order[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum()
    assert area > 0.95 and held.predicted[y == 1].mean() > 0.8 and held.predicted[y == 0].mean() < 0.03
    docs = spark.createDataFrame([(None, "x", 5.0, 9), (2, "you fool " * 20_000, 1.0, 9)], "doc_id long, text string, score double, predicted int")
    out = toxicity.score(docs, {"constant": 0.0})
    assert out.columns == ["doc_id", "score", "predicted"] and {tuple(r) for r in out.collect()} == {(None, 0.0, 0), (2, 0.0, 0)}


def test_language(spark):
    got = queries.op3_language(spark, DATA).collect()
    lang = {r.doc_id: r.lang for r in common.table(spark, DATA, "documents").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "the cat and dog", "en") for i in range(40)] + [(100 + i, "der Hund und die Katze", "de") for i in range(40)] + [(300, "x", None), (None, "the dog", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "THE DOG"), (5, "die Katze"), (5, "die Katze"), (6, "ж" * 50), (None, "und")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(asked, model).collect()]
    by = {i: (p, q) for i, p, q in got}
    assert len(got) == 8 and all(by[i] == ("und", True) for i in (1, 2, 3))
    assert by[4][0] == "en" and by[5][0] == "de" and by[None][0] == "de" and by[6][0] in ("de", "en")
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(asked, empty).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    words = ["abab", "abba", "ba", "cab"] * 3
    gram, _ = langid.grams(words)
    kind, n = np.unique(gram, return_counts=True)
    model = langid.KneserNey(kind, n, 4)
    context = kind[0] >> np.uint64(16)
    nexts = np.array([int(context) << 16 | ord(c) for c in "abc "], np.uint64)
    assert np.exp(-model.cost(nexts)).sum() == pytest.approx(1, abs=1e-6)


def brute_kneser_ney(words, order, alphabet):
    """p(character | context) by dictionaries, from the words' grams."""
    grams = [("  " + " " + w + " ")[k : k + order] for w in words for k in range(len(w) + 1)]
    levels = {order: {g: grams.count(g) for g in set(grams)}}
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1

    def p(gram):
        if not gram:
            return 1 / alphabet
        level, below = levels[len(gram)], p(gram[1:])
        ones, twos = (sum(n == k for n in level.values()) for k in (1, 2))
        cut = ones / (ones + 2 * twos) if ones and twos else 0.5
        nexts = {g: n for g, n in level.items() if g[:-1] == gram[:-1]}
        if not nexts:
            return below
        total = sum(nexts.values())
        return max(level.get(gram, 0) - cut, 0) / total + cut * len(nexts) / total * below

    return p


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    """Both ways of keeping the model, against one written with dictionaries; all grams count, however rare."""
    rng = np.random.default_rng(2)
    made = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(30))
    rows = [(i, made("abcdö"), "x") for i in range(12)] + [(20 + i, made("abxyz"), "y") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = [(1, "abc öx"), (2, "zzz yxa q"), (3, "Abba ба"), (4, ""), (5, None)]
    df = spark.createDataFrame(asked, "doc_id long, text string")
    got = []
    for most in (10_000, 0):
        monkeypatch.setattr(langid, "BROADCAST_GRAMS", most)
        model = langid.train(docs)
        got.append({r.doc_id: (r.entropy, r.n) for r in langid.entropies(df, model["models"]).collect()})
        assert model["langs"] == ["x", "y"]
    for k, lang in enumerate("xy"):
        words = [w for _, t, x in rows if x == lang for w in t.split()]
        p = brute_kneser_ney(words, 4, len(set("".join(words)) | {" "}))
        for i, text in asked:
            grams = [("   " + w + " ")[j : j + 4] for w in (text or "").lower().split() for j in range(len(w) + 1)]
            want = np.mean([-np.log(p(g)) for g in grams]) if grams else 0
            for one in got:
                assert one[i][1] == len(grams) and one[i][0][k] == pytest.approx(want), (lang, text)


def test_folds(spark):
    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
