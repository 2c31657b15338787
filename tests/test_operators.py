"""Operators on small fixtures with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import strings as S
from tidewright.operators import control, grids, keyed, language, metrics, numeric, pages, ranking, series


def commands(spark, *rows):
    return spark.createDataFrame([("k", i, op, body) for i, (op, body) in enumerate(rows)], "key string, seq long, op string, body string")


@pytest.mark.parametrize(
    ("log", "value", "replies"),
    [
        ([("set", "a"), ("set", "b")], "b", ["STORED", "STORED"]),
        ([("add", "a"), ("add", "b")], "a", ["STORED", "NOT_STORED"]),
        ([("append", "x"), ("set", "a"), ("append", "b")], "ab", ["NOT_STORED", "STORED", "STORED"]),
        ([("replace", "x"), ("set", "a"), ("replace", "b")], "b", ["NOT_STORED", "STORED", "STORED"]),
        ([("set", "a"), ("delete", ""), ("delete", ""), ("append", "b")], None, ["STORED", "DELETED", "NOT_FOUND", "NOT_STORED"]),
        ([("set", ""), ("get", ""), ("append", "c")], "c", ["STORED", "VALUE", "STORED"]),
        ([("get", "")], None, ["END"]),
    ],
)
def test_commands(spark, log, value, replies):
    df = commands(spark, *log)
    assert [r.reply for r in keyed.outcomes(df).orderBy("seq").collect()] == replies
    assert [r.value for r in keyed.final(df).collect()] == ([] if value is None else [value])


def test_multi_get_keeps_request_order(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "22")], "key string, value string")
    asked = spark.createDataFrame([(1, ["b", "x", "a"]), (2, ["x"])], "id int, keys array<string>")
    got = {r.id: r.reply for r in keyed.multi_get(asked, store).collect()}
    assert got == {1: "VALUE b 0 2\r\n22\r\nVALUE a 0 1\r\n1\r\nEND", 2: "END"}


def test_cache_evicts_oldest(spark):
    rows = [(0, i, "set", f"key{i:017d}", "v" * 20) for i in range(1100)]
    df = spark.createDataFrame(rows, "shard long, seq long, op string, key string, body string")
    held = {r.key for r in keyed.cache(df, 40_000).collect()}
    assert held == {f"key{i:017d}" for i in range(100, 1100)}
    uniform = keyed.uniform_cache(df.select("shard", "seq", "key"), 40, 40_000)
    assert {r.key for r in uniform.collect()} == held


def test_cache_recency_and_refusal(spark):
    rows = [("set", "a", "1" * 4), ("set", "b", "2" * 4), ("get", "a", ""), ("set", "c", "3" * 4), ("set", "d", "4" * 40), ("add", "a", "9"), ("append", "a", "5")]
    df = spark.createDataFrame([(0, i, op, k, b) for i, (op, k, b) in enumerate(rows)], "shard long, seq long, op string, key string, body string")
    got = [(r.key, r.value) for r in keyed.cache(df, 12).orderBy("place").collect()]
    assert got == [("a", "11115"), ("c", "3333")]


@pytest.mark.parametrize(
    ("line", "verb", "keys", "size", "error"),
    [
        ("set foo 0 0 3", "set", ["foo"], 3, None),
        ("add bar 10 -1 60", "add", ["bar"], 60, None),
        ("get a b c", "get", ["a", "b", "c"], None, None),
        ("stats", "stats", None, None, None),
        ("prepend a 0 0 1", "prepend", ["a"], 1, "Unsupported command"),
        ("fly away", "fly", None, None, "ERROR"),
    ],
)
def test_command_lines(spark, line, verb, keys, size, error):
    p = keyed.parsed(F.lit(line))
    r = spark.range(1).select(*(c.alias(k) for k, c in p.items())).first()
    assert (r.verb, r["keys"], r.bytes, r.error) == (verb, keys, size, error)


def test_layout(spark):
    r = spark.range(1).select(S.to_cyrillic(F.lit("ghbdtn")).alias("a"), S.to_latin(F.lit("привет")).alias("b")).first()
    assert (r.a, r.b) == ("привет", "ghbdtn")


def test_variants(spark):
    r = spark.range(1).select(S.split_variants(F.lit("abc")).alias("s"), S.join_variants(F.lit("a b c")).alias("j"), S.split_variants(F.lit("a")).alias("e")).first()
    assert (r.s, r.j, r.e) == (["a bc", "ab c"], ["ab c", "a bc"], [])


PAGE = "<html><head><title>Two words</title><script>x</script><style>p{}</style></head><body><h1>Big</h1><p>Some <b>text</b>.<script>a</script><script>b</script><a href='/x'>li<i>nk</i></a></body></html>"


def test_page(spark):
    f = pages.html_features(F.lit(PAGE), ["some", "none"])
    r = spark.range(1).select(*(c.alias(k) for k, c in f.items()), S.title_of(F.lit(PAGE)).alias("title"), S.headers_of(F.lit(PAGE)).alias("headers")).first()
    assert (r.scripts, r.title_words, r.images, r.anchor_chars, r.title, r.headers) == (3, 2, 0, 4, "Two words", "Big")
    assert r.frequent_cover == 0.5
    assert "a" not in pages.read_html("<script></script>")
    assert pages.read_html("<p>one  two<br>three<br/>four") == "one two \nthree \n\nfour"


def test_convolution_flips_the_kernel(spark):
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate([1.0, 2.0, 4.0, 8.0])], "k int, t long, v double")
    got = [r.c for r in series.convolved(df, ["k"], [1.0, 10.0, 100.0]).orderBy("t").collect()]
    assert got == [4 + 20 + 100, 8 + 40 + 200]


def test_windows_count(spark):
    df = spark.createDataFrame([(0, t, float(t)) for t in range(12)], "k int, t long, v double")
    got = series.windows(df, ["k"], 4, 3).orderBy("t").collect()
    assert len(got) == 12 - 4 - 1 - 3
    assert got[0].x == [0, 1, 2, 3] and got[0].y == [3, 4, 5, 6]


def test_lstm_runs(spark):
    df = spark.createDataFrame([(0, t, 0.5) for t in range(3)], "k int, t long, v double")
    r = series.lstm(df, ["k"], {"w": [0.1] * 8, "u": [[0.1] * 8] * 2, "b": [0.0] * 8}).first()
    h, c = 0.0, 0.0
    for _ in range(3):
        z = 0.05 + 2 * 0.1 * h
        g = 1 / (1 + math.exp(-z))
        c = c * g + g * math.tanh(z)
        h = g * math.tanh(c)
    assert r.h == pytest.approx([h, h])


def test_closed_form_values(spark):
    rows = [("x", 0, 1.0, "x", 1.0, False), ("x", 1, 1.0, "y", 0.0, False), ("y", 0, 1.0, "y", 3.0, False), ("y", 1, 1.0, "x", 0.0, True)]
    p = spark.createDataFrame(rows, "s string, a long, p double, s2 string, r double, done boolean")
    best = {r.s: r.a for r in control.improve(p, 0.5, 20).collect()}
    assert best == {"x": 1, "y": 0}
    policy = spark.createDataFrame([("x", 1), ("y", 0)], "s string, a long")
    v = {r.s: r.v for r in control.evaluate(p, policy, 0.5, 40).collect()}
    assert v["y"] == pytest.approx(6) and v["x"] == pytest.approx(3)


def test_alignment_and_errors(spark):
    assert language.aligned("helo", "hello").count(("l", "_")) == 1
    df = spark.createDataFrame([("ab", "ab"), ("ac", "ab"), (None, "x")], "original string, fixed string")
    got = {(r.fix, r.orig): r.cost for r in language.error_model(df).collect()}
    assert got[("a", "a")] == 0 and got[("b", "c")] == pytest.approx(math.log(2))
    assert ("^a", "^a") in {(r.fix, r.orig) for r in language.error_model(df, 2).collect()}


def test_weighted_neighbours(spark):
    words, terms = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for xs, n in ((["helo"], "word"), (["hello", "help", "yellow"], "term")))
    got = {(r.term, r.cost) for r in language.weighted_neighbours(words, terms, {("l", "_"): 0.25}, 1.0).collect()}
    assert got == {("hello", 0.25), ("help", 1.0)}


def test_shortlist_is_a_prefix(spark):
    rows = [("w", "a", 1.0, 0.0), ("w", "b", 2.0, 5.0), ("w", "c", 9.0, 1.0), ("w", "a", 3.0, 0.0)]
    df = spark.createDataFrame(rows, "word string, term string, lm double, err double")
    assert [r.term for r in language.shortlist(df).orderBy("rank").collect()] == ["a"]


def test_idf_floor(spark):
    occ = spark.createDataFrame([(i, "body", 0, t) for i in range(4) for t in (["the"] if i else ["the", "rare"])], "doc_id long, zone string, pos int, term string")
    lens = spark.createDataFrame([(i, "body", 1) for i in range(4)], "doc_id long, zone string, len int")
    got = {r.term: r.idf for r in ranking.idf(ranking.frequencies(occ), ranking.averages(lens)).collect()}
    raw = {"the": math.log(0.5) - math.log(4.5), "rare": math.log(3.5) - math.log(1.5)}
    assert got["rare"] == pytest.approx(raw["rare"])
    assert got["the"] == pytest.approx(0.25 * sum(raw.values()) / 2)


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([(0, 0.1)], "mark int, prediction double")
    r = metrics.sweep(df, 1).orderBy("threshold").collect()
    assert [x.macro_f1 for x in r] == [0.0, 0.5]


def test_gradients_agree(spark):
    for name, (f, g) in numeric.OBJECTIVES.items():
        x = F.lit(0.7)
        r = spark.range(1).select(numeric.numeric_gradient(lambda t, f=f: f(t, F.lit(0.0)), x).alias("n"), g(x).alias("g")).first()
        assert r.n == pytest.approx(r.g, abs=1e-6), name


def test_softmax_is_shifted(spark):
    a = F.array(F.lit(1000.0), F.lit(1001.0))
    r = spark.range(1).select(numeric.softmax(a).alias("p"), numeric.nll(a, F.lit(1)).alias("l"), numeric.argmax(F.array(F.lit(2.0), F.lit(2.0))).alias("m")).first()
    assert sum(r.p) == pytest.approx(1) and r.l == pytest.approx(math.log(1 + math.exp(-1))) and r.m == 0


def test_partial_tiles_are_dropped(spark):
    df = spark.createDataFrame([(0, y, x, float(5 * y + x)) for y in range(5) for x in range(5)], "k int, y long, x long, v double")
    got = grids.pooled(df, "k", 2, 5, 5, F.max("v").alias("m")).count()
    assert got == 4


def test_pages_that_are_rewritten(spark):
    html = "<!-- c --><p>one  two<br>three<br/>four &amp; <b>five</b> six<p><p>seven<pre> a\n b</pre>"
    want = "one two \nthree \n\nfour & five six \n\n\n\nseven a b"
    assert spark.range(1).select(pages.parsed_text(F.lit(html)).alias("t")).first().t == want == pages.read_html(html)


def test_lemmas(spark):
    words = spark.createDataFrame([("cats",), ("cat",), ("cats",), ("bus",), ("glass",)], "word string")
    got = pages.lemmatised(words, "word", pages.plurals(words)).collect()
    assert sorted((r.word, r.lemma) for r in got) == [("bus", "bus"), ("cat", "cat"), ("cats", "cat"), ("cats", "cat"), ("glass", "glass")]


def test_partial_reads_give_the_same_commands():
    from tidewright.streaming import commands as C

    log = "set a 0 0 5\r\nab\r\nc\r\nget a b\r\nfly\r\nadd b 0 0 0\r\n\r\nset c 0 0 x\r\nstats\r\n"
    whole, rest = C.complete(log + "get")
    assert rest == "get" and [(v, b, e) for v, _, b, e in whole] == [("set", "ab\r\nc", None), ("get", None, None), ("fly", None, "ERROR"), ("add", "", None), ("set", None, "CLIENT_ERROR"), ("stats", None, None)]
    for size in range(1, 12):
        held, out = "", []
        for k in range(0, len(log), size):
            found, held = C.complete(held + log[k : k + size])
            out += found
        assert out == whole and held == ""


def test_partial_reads_as_a_stream(spark, tmp_path):
    from tidewright.streaming import commands as C

    reads = [("x", 0, "set a 0 0 3\r\nab"), ("y", 0, "get q\r\nget r\r\n"), ("x", 1, "c\r\nget"), ("x", 2, " a\r\n")]
    for k, row in enumerate(reads):  # a batch each
        spark.createDataFrame([row], "conn string, seq long, data string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema("conn string, seq long, data string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    run = C.parsed_reads(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(C.COMMANDS).parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.conn, r.n, r.verb, r.body) for r in got) == [("x", 0, "set", "abc"), ("x", 1, "get", None), ("y", 0, "get", None), ("y", 1, "get", None)]


def test_chains_against_all_products(spark):
    """The cheapest chain with prices of its own, against every product of candidates."""
    from itertools import product

    uni = {"a": 1.0, "b": 2.0, "c": 0.5}
    big = {("a", "b"): 0.3, ("b", "c"): 0.1, ("a", "c"): 2.0, ("c", "c"): 0.2}
    lists = {1: [["a", "b"], ["b", "c"], ["c", "a"]], 2: [["b"]], 3: [["c", "x"], ["c"], ["c"], ["a", "b", "c"]]}
    err = {"a": 0.2, "b": 0.0, "c": 0.7, "x": 0.0}
    c = spark.createDataFrame([(k, p, t, err[t]) for k, ls in lists.items() for p, ts in enumerate(ls) for t in ts], "key long, pos int, term string, err double")
    got = language.best_chain(c, spark.createDataFrame(list(uni.items()), "term string, cost double"), spark.createDataFrame([(*k, v) for k, v in big.items()], "w1 string, w2 string, cost double"))
    price = lambda ws: uni.get(ws[0], 100.0) + sum(big.get(p, 100.0) for p in zip(ws, ws[1:], strict=False)) + sum(err[w] for w in ws)
    for r in got.collect():
        best = min(product(*lists[r.key]), key=lambda ws: (round(price(ws), 9), " ".join(ws)))
        assert (r.chain, r.cost) == (" ".join(best), pytest.approx(price(best)))


def test_edit_prices(spark):
    errors = spark.createDataFrame([("a", "a", 0.1), ("b", "b", 0.2), ("b", "_", 1.0), ("_", "c", 3.0), ("a", "b", 2.0)], "fix string, orig string, cost double")
    pairs = spark.createDataFrame([("aa", "aba"), ("abc", "ab"), ("bb", "ab"), ("ab", "ab"), ("zb", "ab")], "word string, term string")
    got = {(r.word, r.term): r.err for r in language.edit_prices(pairs, errors).collect()}
    assert got == pytest.approx({("aa", "aba"): 1.2, ("abc", "ab"): 3.3, ("bb", "ab"): 2.2, ("ab", "ab"): 0.3, ("zb", "ab"): 100.2})


def test_restored_vectors(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, e array<double>")
    for k in (2, 5):
        out, share = numeric.restored(df, "e", k)
        values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
        assert share.sum() == pytest.approx(values[:k].sum() / values.sum())
        assert np.mean([r.error for r in out.collect()]) == pytest.approx(values[k:].sum() / 300, abs=1e-12)
