"""Readers and writers of the file formats the engine takes. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame, size: int = 4 << 20) -> int:
    """Tasks for a shuffle of df's rows: spark.sql.shuffle.partitions, or more where what df is read from has over size bytes (as stored) for each."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    stored = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(b for b in stored if b < 1 << 60) // size))  # beyond, Spark doesn't know


def judged_pairs(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id from a CSV with a header."""
    return spark.read.schema("query_id int, doc_id int").option("header", True).csv(path)


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query: the first two tab-separated fields."""
    return spark.read.text(path).select(F.split("value", "\t").alias("f")).select(F.col("f")[0].cast("int").alias("query_id"), F.get("f", F.lit(1)).alias("query"))


def url_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url_id int, url string").option("sep", "\t").csv(path)


def crawl(spark: SparkSession, paths: list[str], first: str | None = None) -> DataFrame:
    """file, url and html of crawled files: the first line is the url. first: folder/file to resume from; files before it in that order are passed over."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    raw = raw.where(F.substring_index("file", "/", -2) >= first) if first else raw
    cut = F.instr("value", "\n")
    return raw.select("file", F.trim(F.substring_index("value", "\n", 1)).alias("url"), F.when(cut > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("").alias("html"))


def write_crawl_days(pages: DataFrame, path: str) -> None:
    """day, file, url and html as folders of days."""
    pages.select("day", "file", "url", "html").write.mode("append").partitionBy("day").parquet(path)


def crawl_days(spark: SparkSession, path: str, first_day: str | None = None, after: str = "") -> DataFrame:
    """day, file, url and html of crawled days, from first_day on, and of that day only files after the given one. Folders of earlier days aren't opened."""
    rows = spark.read.schema("file string, url string, html string, day string").parquet(path)
    if first_day is not None:
        rows = rows.where((F.col("day") >= first_day) & ((F.col("day") > first_day) | (F.col("file") > after)))
    return rows.select("day", "file", "url", "html")


def write_zones(docs: DataFrame, path: str) -> None:
    """The parsed-document store: doc_id, title, headers, body."""
    docs.select("doc_id", "title", "headers", "body").write.mode("overwrite").parquet(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, title string, headers string, body string").parquet(path)


def spam_pages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, mark, url, html of a (gzipped) TSV whose last field is a base64 page; bytes that aren't UTF-8 become U+FFFD."""
    rows = spark.read.schema("doc_id long, mark int, url string, page string").option("sep", "\t").option("header", True).csv(path)
    return rows.select("doc_id", "mark", "url", F.decode(F.unbase64("page"), "UTF-8").alias("html"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """original (null in one-field rows) and fixed: the last field is the query as it should be."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(F.when(F.size(f) > 1, f[0]).alias("original"), F.element_at(f, -1).alias("fixed"))


def write_model(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_model() stored: counts, costs or trees, with their schema."""
    return spark.read.schema(schema).parquet(path)


def read_model_json(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The two cost tables of a model stored as one JSON array of objects: of a language model (term, cost) and (w1, w2, cost), of an error model (fix, orig, cost) of characters and of pairs.
    kind: "language" or "errors". Such a file is one document, read by one task; Parquet (read_model) has no such bound."""
    if kind not in ("language", "errors"):
        raise ValueError(f"no kind of model: {kind}")
    parts = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("p"))

    def nested(k: int, outer: str, inner: str) -> DataFrame:
        each = parts.select(F.explode(F.from_json(F.get("p", F.lit(k)), "map<string,map<string,double>>")).alias(outer, "m"))
        return each.select(outer, F.explode("m").alias(inner, "cost"))

    if kind == "errors":
        return nested(0, "fix", "orig"), nested(1, "fix", "orig")
    return parts.select(F.explode(F.from_json(F.get("p", F.lit(0)), "map<string,double>")).alias("term", "cost")), nested(1, "w1", "w2")


def model_json(counts: DataFrame) -> DataFrame:
    """One JSON object for each row of a model, for interchange."""
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("value"))


def frequent_words(spark: SparkSession, path: str, n: int = 300) -> DataFrame:
    """The first n lines that differ, in the file's order."""
    lines = spark.read.text(path).select(F.trim("value").alias("word"), F.monotonically_increasing_id().alias("at"))
    return lines.groupBy("word").agg(F.min("at").alias("at")).orderBy("at").limit(n)


def column_of(spark: SparkSession, path: str, index: int, sep: str = ";", footer: int = 0) -> DataFrame:
    """t and v: one numeric column of a delimited file with a header, without its last footer rows. Meant for one small file: rows are numbered."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    n = lines.count()
    numbered = lines.select("value", (F.row_number().over(Window.orderBy("at")) - 1).alias("t"))
    return numbered.where((F.col("t") > 0) & (F.col("t") < n - footer)).select((F.col("t") - 1).alias("t"), F.split("value", sep)[index].cast("double").alias("v"))


def landmarks(spark: SparkSession, path: str, points: int = 68) -> DataFrame:
    """image and pts (array of x, y) of a CSV of an image name and 2 values a point."""
    f = F.split("value", ",")
    rows = spark.read.text(path).where(~F.col("value").startswith("image_name"))
    pts = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(F.get(f, 2 * i + 1).cast("double").alias("x"), F.get(f, 2 * i + 2).cast("double").alias("y")))
    return rows.select(f[0].alias("image"), pts.alias("pts"))


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """name, row and values (array of double) of the arrays in .npz files."""
    import io

    import numpy as np
    import pandas as pd

    def load(frames):
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content)) as z:
                    for name in z.files:
                        a = np.atleast_2d(z[name].T).T.astype(float)
                        yield pd.DataFrame({"name": name, "row": np.arange(len(a)), "values": [r.ravel().tolist() for r in a]})

    return images(spark, path).select("content").mapInPandas(load, "name string, row long, values array<double>")


def quotes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.get(F.split("value", "\t"), F.lit(0))).alias("quote"))


def write_ranking(ranked: DataFrame, path: str) -> None:
    """query_id, doc_id in rank order, one CSV with a header; a report, written by one task."""
    ranked.orderBy("query_id", "rank").select("query_id", "doc_id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    scored.select(F.col("id").alias("Id"), F.col("prediction").alias("Prediction")).write.mode("overwrite").option("header", True).csv(path)


def batches(df: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """df with batch, a number: rows in a seeded order of key, dealt by size. Rows are numbered within hash parts, so no task sees them all."""
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    part = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts))
    order = Window.partitionBy("_part").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)
    return df.withColumn("_part", part).withColumn("batch", F.concat_ws("-", "_part", F.floor((F.row_number().over(order) - 1) / size))).drop("_part")


def saved(model, path: str) -> None:
    model.write().overwrite().save(path)


def loaded(kind, path: str):
    """What saved() stored, by its class: a fitted model, or a pipeline of them."""
    return kind.load(path)
