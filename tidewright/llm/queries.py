"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, centroids, decontam, langid, parsing, quality, rolling, simhash, suffix, tokencount, tokenfile, toxicity, wordbpe
from tidewright.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "quality_text", "quality_meta", "quality_score", "quality_keep")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~out)
    return toxicity.score(docs, toxicity.train(docs.where(~out), labels)).withColumn("held_out", out)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    return langid.identify(docs, langid.train(docs.where(~out))).withColumn("held_out", out)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_digests(spark, manifest)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.removed(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compared(table(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return wordbpe.digests(wordbpe.decode(wordbpe.encode(table(spark, sf_dir, "documents"), path), path))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def op13_rolling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.distinct_users(table(spark, sf_dir, "clicks"), {"short": 15, "middle": 180, "long": 1440})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_toxicity, op3_language, op4_token_file, op5_byte_bpe, op6_simhash, op7_suffix_dedup, op8_decontamination, op9_token_counts, op10_fingerprints, op11_word_bpe, op12_centroids, op13_rolling_users)}
#: Queries that SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op12_centroids": centroids.cluster_sql(k=40, rounds=5, seed=2),
    "op13_rolling_users": """
        WITH one AS (SELECT DISTINCT click_id, kind, client_id, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) AS minute FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL),
        active AS (SELECT kind, client_id, minute, count(*) AS n FROM one WHERE client_id IS NOT NULL GROUP BY ALL),
        points AS (SELECT DISTINCT kind, minute FROM one),
        users AS (
            SELECT p.kind, p.minute, a.client_id, max(a.minute) AS latest, sum(a.n) AS n
            FROM points p JOIN active a ON a.kind = p.kind AND a.minute BETWEEN p.minute - 1439 AND p.minute GROUP BY ALL)
        SELECT p.kind, p.minute,
            count(u.client_id) FILTER (u.latest > p.minute - 15) AS users_short, count(u.client_id) FILTER (u.latest > p.minute - 180) AS users_middle,
            count(u.client_id) AS users_long, count(u.client_id) FILTER (u.n >= 2) AS hot_users
        FROM points p LEFT JOIN users u ON u.kind = p.kind AND u.minute = p.minute GROUP BY ALL""",
}
