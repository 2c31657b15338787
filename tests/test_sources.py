"""File formats, read and written."""

import base64
import gzip

import numpy as np
from pyspark.sql import functions as F

from tidewright.sources import tables as T
from tidewright.streaming import commands


def put(path, text):
    path.write_text(text)
    return str(path)


def test_text_formats(spark, tmp_path):
    assert [tuple(r) for r in T.judged_pairs(spark, put(tmp_path / "p.csv", "q,d\n1,2\n1,3\n")).collect()] == [(1, 2), (1, 3)]
    assert [tuple(r) for r in T.query_file(spark, put(tmp_path / "q.tsv", "1\thello\tmore\n2\tyou\n")).orderBy("query_id").collect()] == [(1, "hello"), (2, "you")]
    assert [tuple(r) for r in T.url_dictionary(spark, put(tmp_path / "u.tsv", "7\thttp://a\n")).collect()] == [(7, "http://a")]
    assert [r.quote for r in T.quotes(spark, put(tmp_path / "c.tsv", " hi \tx\n")).collect()] == ["hi"]
    assert [tuple(r) for r in T.query_log(spark, put(tmp_path / "l.tsv", "helo\thello\nfine\n")).orderBy("fixed").collect()] == [(None, "fine"), ("helo", "hello")]
    assert [r.word for r in T.frequent_words(spark, put(tmp_path / "f.txt", "the\nof\nthe\n")).collect()] == ["the", "of"]
    series = T.column_of(spark, put(tmp_path / "s.csv", "m;v\na;1\nb;2\nc;3\nfoot\n"), 1, ";", 1)
    assert [tuple(r) for r in series.orderBy("t").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]
    marks = T.landmarks(spark, put(tmp_path / "m.csv", "image_name,a,b,c,d\nx.jpg,1,2,3,4\n"), 2).first()
    assert marks.image == "x.jpg" and [tuple(p) for p in marks.pts] == [(1, 2), (3, 4)]


def test_crawl_and_zones(spark, tmp_path):
    (tmp_path / "d").mkdir()
    put(tmp_path / "d" / "doc.0001.dat", "http://a\n<p>x\n</p>")
    put(tmp_path / "d" / "doc.0002.dat", "http://b")
    got = {r.url: r.html for r in T.crawl(spark, [str(tmp_path / "d")]).collect()}
    assert got == {"http://a": "<p>x\n</p>", "http://b": ""}
    later = T.crawl(spark, [str(tmp_path / "d")], "d/doc.0002.dat")
    assert [r.url for r in later.collect()] == ["http://b"]
    docs = spark.createDataFrame([(1, "t", "h", "b")], "doc_id long, title string, headers string, body string")
    T.write_zones(docs, str(tmp_path / "z"))
    assert T.read_zones(spark, str(tmp_path / "z")).collect() == docs.collect()


def test_spam_pages(spark, tmp_path):
    page = base64.b64encode("<b>é</b>".encode()).decode()
    with gzip.open(tmp_path / "s.tsv.gz", "wt") as f:
        f.write(f"id\tmark\turl\tpage\n1\t0\thttp://x\t{page}\n")
    assert T.spam_pages(spark, str(tmp_path / "s.tsv.gz")).first().html == "<b>é</b>"


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "a.npz", np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([5, 6]))
    got = {(r.name, r.row): r["values"] for r in T.arrays(spark, str(tmp_path / "a.npz")).collect()}
    assert got[("arr_0", 1)] == [3.0, 4.0] and got[("arr_1", 0)] == [5.0]


def test_sinks(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 5, 2), (1, 9, 1)], "query_id int, doc_id int, rank int")
    T.write_ranking(ranked, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    assert text == "query_id,doc_id\n1,9\n1,5\n"
    T.write_predictions(spark.createDataFrame([(1, 0.5)], "id int, prediction double"), str(tmp_path / "o"))
    assert "Id,Prediction\n1,0.5\n" in [p.read_text() for p in (tmp_path / "o").glob("part-*")]
    model = spark.createDataFrame([("a", 1)], "term string, n int")
    T.write_model(model, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).collect() == model.collect()
    assert T.model_json(model).first().value == '{"term":"a","n":1}'


def test_batches_cover_rows(spark):
    got = T.batches(spark.range(100), 8, 1, "id")
    sizes = [r["count"] for r in got.groupBy("batch").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 8


def test_streamed_replies(spark, tmp_path):
    schema = "key string, seq long, op string, body string"
    spark.createDataFrame([("k", 1, "set", "a"), ("k", 2, "append", "b"), ("j", 3, "append", "x")], schema).write.parquet(str(tmp_path / "in"))
    run = commands.replies(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("replies").start()
    run.processAllAvailable()
    run.stop()
    got = {r.seq: (r.reply, r.value) for r in spark.sql("select * from replies").collect()}
    assert got == {1: ("STORED", "a"), 2: ("STORED", "ab"), 3: ("NOT_STORED", None)}


def test_streamed_lines(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    put(tmp_path / "lines" / "a.txt", "One\nTwo\n")
    run = commands.corrected(commands.file_lines(spark, str(tmp_path / "lines")), F.lower).writeStream.format("memory").queryName("lines").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.fixed for r in spark.sql("select * from lines").collect()) == ["one", "two"]


def test_crawled_days_are_resumed_by_folders(spark, tmp_path):
    rows = [(f"2019-04-0{k % 3 + 1}", f"doc.{k:04}.dat", f"http://{k}", f"<p>{k}") for k in range(12)]
    T.write_crawl_days(spark.createDataFrame(rows, "day string, file string, url string, html string"), str(tmp_path / "crawl"))
    whole = T.crawl_days(spark, str(tmp_path / "crawl"))
    assert sorted(map(tuple, whole.collect())) == sorted(rows)
    rest = T.crawl_days(spark, str(tmp_path / "crawl"), "2019-04-02", "doc.0004.dat")
    earlier = [r for r in rows if r[:2] <= ("2019-04-02", "doc.0004.dat")]
    assert sorted([*earlier, *map(tuple, rest.collect())]) == sorted(rows)
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day#" in plan.split("PartitionFilters", 1)[1]
    assert not any("day=2019-04-01" in f.f for f in rest.select(F.input_file_name().alias("f")).collect())


def test_models_stored_as_json(spark, tmp_path):
    import json

    (tmp_path / "lm.json").write_text(json.dumps(({"a": 1.5, "é": 2.0}, {"a": {"b": 0.5, "a": 1.0}}, 3, {"a": 2})))
    one, two = T.read_model_json(spark, str(tmp_path / "lm.json"), "language")
    assert sorted(map(tuple, one.collect())) == [("a", 1.5), ("é", 2.0)] and sorted(map(tuple, two.collect())) == [("a", "a", 1.0), ("a", "b", 0.5)]
    (tmp_path / "em.json").write_text(json.dumps(({"a": {"_": 0.25}}, {"ab": {"ba": 3.0}}, {"a": 4.0}, {"ab": 1.0})))
    one, two = T.read_model_json(spark, str(tmp_path / "em.json"), "errors")
    assert [*map(tuple, one.collect()), *map(tuple, two.collect())] == [("a", "_", 0.25), ("ab", "ba", 3.0)]


def test_a_fitted_model_comes_back(spark, tmp_path):
    from pyspark.ml.feature import PCA, PCAModel
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([([float(k), float(k * k), 1.0],) for k in range(9)], "x array<double>").select(array_to_vector("x").alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    T.saved(model, str(tmp_path / "pca"))
    assert T.loaded(PCAModel, str(tmp_path / "pca")).transform(rows).collect() == model.transform(rows).collect()
