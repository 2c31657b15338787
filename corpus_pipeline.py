"""The corpus pipeline: junk, near copies, repeated passages and benchmark items go; what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; it is written as
Parquet to the shared folder and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, common, decontam, quality, simhash, suffix


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.kept_rows(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by sets of five-word shingles with a Jaccard coefficient of 0.8 or more."""
    return simhash.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier."""
    return suffix.without_repeats(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the text that the ids decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.decode(bpe.encode(docs, path), path)
    return done.select("doc_id", F.decode("decoded", "UTF-8").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("repeats", remove_repeats),
    ("decontamination", keep_uncontaminated),
    ("encoding", encode),
]
#: The classifier, the removal of byte strings and byte-pair merges can't be written in SQL; tests hold each stage's operator against brute force, labels or
#: a library, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(spark)
    return docs
