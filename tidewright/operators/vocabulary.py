"""Character vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def characters(df: DataFrame, column: str) -> DataFrame:
    """c and id: distinct characters numbered in binary order. One task numbers them: there are no more than code points."""
    seen = df.select(F.explode(F.split(column, "")).alias("c")).where("c != ''").distinct()
    return seen.select("c", (F.row_number().over(Window.orderBy("c")) - 1).alias("id"))


def encode(df: DataFrame, key: str, column: str, alphabet: DataFrame) -> DataFrame:
    """key and codes (array) of each text."""
    exploded = df.select(key, F.posexplode(F.split(column, "")).alias("at", "c")).where("c != ''")
    joined = exploded.join(F.broadcast(alphabet), "c")  # at most as many rows as code points
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("x")).select(key, F.col("x.id").alias("codes"))


def decode(df: DataFrame, key: str, alphabet: DataFrame) -> DataFrame:
    """df with decoded, the text that codes stand for."""
    exploded = df.select(key, F.posexplode("codes").alias("at", "id")).join(F.broadcast(alphabet), "id")
    texts = exploded.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "c"))).getField("c"), "").alias("decoded"))
    return df.join(texts, key)
