"""Queries of classification metrics and distributions. Documents with labels; a document's prediction grows with its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import strings as S
from tidewright.operators import metrics as M
from tidewright.plans.registry import query
from tidewright.sources.tables import table

BASE = "WITH p AS (SELECT doc_id, quality AS mark, least(1.0::double, n_chars / 5000.0::double) AS prediction FROM documents JOIN labels USING (doc_id))"
PRF = "CASE WHEN {a} = 0 OR {b} = 0 THEN 0 ELSE {a}::double / {b} END"


def predictions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("mark")), "doc_id").select("doc_id", "mark", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("prediction"))


@query(BASE + " SELECT count(*) FILTER (prediction > 0.5 AND mark = 1) AS tp, count(*) FILTER (prediction > 0.5 AND mark = 0) AS fp, count(*) FILTER (prediction <= 0.5 AND mark = 0) AS tn, count(*) FILTER (prediction <= 0.5 AND mark = 1) AS fn FROM p")
def confusion(spark, d):
    return M.confusion(predictions(spark, d), 0.5)


SWEEP = BASE + """, t AS (SELECT i / 20.0::double AS threshold FROM range(0, 21) r(i)),
c AS (SELECT threshold, count(*) FILTER (prediction > threshold AND mark = 1) AS tp, count(*) FILTER (prediction > threshold AND mark = 0) AS fp, count(*) FILTER (prediction <= threshold AND mark = 0) AS tn, count(*) FILTER (prediction <= threshold AND mark = 1) AS fn FROM p, t GROUP BY threshold),
s AS (SELECT *, """ + ", ".join(f"{PRF.format(a=a, b=b)} AS {n}" for n, a, b in (("precision_1", "tp", "(tp + fp)"), ("recall_1", "tp", "(tp + fn)"), ("precision_0", "tn", "(tn + fn)"), ("recall_0", "tn", "(tn + fp)"))) + """ FROM c),
f AS (SELECT *, """ + ", ".join(f"CASE WHEN precision_{k} = 0 OR recall_{k} = 0 THEN 0 ELSE 2 * precision_{k} * recall_{k} / (precision_{k} + recall_{k}) END AS f1_{k}" for k in (0, 1)) + """ FROM s)
SELECT threshold, tp, fp, tn, fn, """ + ", ".join(f"round({n}, 6) AS {n}" for n in ("precision_1", "recall_1", "precision_0", "recall_0", "f1_0", "f1_1")) + ", round((f1_0 + f1_1) / 2, 6) AS macro_f1 FROM f"


@query(SWEEP)
def threshold_sweep(spark, d):
    return M.sweep(predictions(spark, d), 20)


@query(BASE + " SELECT round(avg(CAST(CAST(prediction > 0.5 AS INT) = mark AS INT)), 6) AS accuracy, round(stddev_samp(prediction), 6) AS spread, round(avg(prediction), 6) AS mean FROM p")
def accuracy(spark, d):
    p = predictions(spark, d)
    return p.agg(F.round(F.avg(((F.col("prediction") > 0.5).cast("int") == F.col("mark")).cast("int")), 6).alias("accuracy"), F.round(F.stddev_samp("prediction"), 6).alias("spread"), F.round(F.avg("prediction"), 6).alias("mean"))


@query(BASE + " SELECT doc_id, mark, round(prediction, 6) AS prediction FROM p WHERE CAST(prediction > 0.5 AS INT) <> mark")
def misclassified(spark, d):
    return predictions(spark, d).where((F.col("prediction") > 0.5).cast("int") != F.col("mark")).withColumn("prediction", F.round("prediction", 6))


@query(BASE + " SELECT doc_id, round(prediction, 6) AS prediction FROM p WHERE prediction > 0.9")
def above_threshold(spark, d):
    return predictions(spark, d).where("prediction > 0.9").select("doc_id", F.round("prediction", 6).alias("prediction"))


@query(BASE + " SELECT doc_id, round(prediction, 6) AS prediction FROM p ORDER BY p.prediction, doc_id LIMIT 21")
def worst_classified(spark, d):
    """The 21 least sure: a report."""
    return predictions(spark, d).orderBy("prediction", "doc_id").limit(21).select("doc_id", F.round("prediction", 6).alias("prediction"))


@query("WITH p AS (SELECT toxic AS class, n_chars AS v FROM documents JOIN labels USING (doc_id)), b AS (SELECT class, CAST(floor(v / 10.0) AS BIGINT) AS bin FROM p WHERE v >= 0 AND v < 3000) SELECT class, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY class) * 10.0::double), 9) AS density FROM b GROUP BY class, bin")
def class_histogram(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("toxic").alias("class"), F.col("n_chars").alias("v"))
    return M.histogram(p, "class", "v", 0, 3000, 10)


@query(r"WITH l AS (SELECT length(text)::double AS v FROM conversations), r AS (SELECT min(v) AS lo, max(v) AS hi FROM l) SELECT least(99, CAST(floor((v - lo) / ((hi - lo) / 100)) AS BIGINT)) AS bin, count(*) AS n FROM l, r GROUP BY bin")
def length_histogram(spark, d):
    return M.even_bins(table(spark, d, "conversations").select(F.length("text").cast("double").alias("v")), "v", 100)


@query("SELECT round(avg(m), 6) AS epoch_mean FROM (SELECT doc_id // 64 AS batch, avg(n_chars) AS m FROM documents GROUP BY batch)")
def epoch_mean(spark, d):
    """The mean of batch means, not of rows."""
    return table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 64)).agg(F.avg("n_chars").alias("m")).agg(F.round(F.avg("m"), 6).alias("epoch_mean"))


@query("SELECT user_id, round(min(value), 6) AS best, round(max(abs(value - 100)), 6) AS deviation FROM events GROUP BY user_id")
def best_of_runs(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.min("value"), 6).alias("best"), F.round(F.max(F.abs(F.col("value") - 100)), 6).alias("deviation"))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::double AS x, round(unnest(embedding)::double, 1) AS r FROM embeddings) SELECT round(1 - avg((x - r) * (x - r)) / avg(x * x), 6) AS quality FROM x")
def reconstruction(spark, d):
    x = table(spark, d, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("x")).withColumn("r", F.round("x", 1))
    return x.agg(F.round(1 - F.avg((F.col("x") - F.col("r")) * (F.col("x") - F.col("r"))) / F.avg(F.col("x") * F.col("x")), 6).alias("quality"))


@query("SELECT doc_id, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE round(a::double / b, 6) END AS ratio FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]')) AS a, length(text) AS b FROM documents)")
def digit_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.ratio(F.regexp_count("text", F.lit("[0-9]")), F.length("text")), 6).alias("ratio"))


@query("SELECT i AS step, round(i * 0.1::double, 6) AS value FROM range(0, 11) r(i)")
def inclusive_range(spark, d):
    return spark.range(0, 11).select(F.col("id").alias("step"), F.round(F.col("id") * 0.1, 6).alias("value"))
