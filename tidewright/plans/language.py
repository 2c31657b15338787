"""Queries of word n-gram models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import strings as S
from tidewright.operators import language as L
from tidewright.plans.registry import query
from tidewright.sources.tables import table

SQL = """
WITH toks AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+') AS w FROM {t}),
occ AS (SELECT key, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM toks),
uni AS (SELECT term, count(*) AS n, ln(sum(count(*)) OVER ()) - ln(count(*)) AS cost FROM occ GROUP BY term),
prs AS (SELECT term AS w1, lead(term) OVER (PARTITION BY key ORDER BY pos) AS w2 FROM occ),
big AS (SELECT w1, w2, count(*) AS n, ln(sum(count(*)) OVER (PARTITION BY w1)) - ln(count(*)) AS cost FROM prs WHERE w2 IS NOT NULL GROUP BY w1, w2)
"""
DOCS = SQL.format(t="documents")
TALK = SQL.format(t="(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")


def words(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), S.tokens(F.col("text")).alias("w"))


def lowered(text):
    """Texts whose words bigrams() finds itself, where nothing else needs them."""
    return F.lower(text).alias("w")


@query(DOCS + "SELECT term, n, round(cost, 6) + 0 AS cost FROM uni")
def unigram_model(spark, d):
    return L.unigrams(words(spark, d)).withColumn("cost", F.round("cost", 6) + 0)


@query(DOCS + "SELECT w1, w2, n, round(cost, 6) + 0 AS cost FROM big")
def bigram_model(spark, d):
    return L.bigrams(table(spark, d, "documents").select(lowered(F.col("text")))).withColumn("cost", F.round("cost", 6) + 0)


@query(TALK + "SELECT w1, w2, n, round(cost, 6) + 0 AS cost FROM big")
def dialogue_bigrams(spark, d):
    return L.bigrams(table(spark, d, "conversations").select(lowered(F.col("text")))).withColumn("cost", F.round("cost", 6) + 0)


@query(DOCS + """, q AS (SELECT item_id AS key, regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+') AS w FROM benchmark),
qo AS (SELECT key, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM q),
qp AS (SELECT key, pos, lag(term) OVER (PARTITION BY key ORDER BY pos) AS w1, term AS w2 FROM qo),
c AS (SELECT key, coalesce(CASE WHEN pos = 1 THEN uni.cost ELSE big.cost END, 100) AS cost FROM qp LEFT JOIN uni ON uni.term = qp.w2 LEFT JOIN big ON big.w1 = qp.w1 AND big.w2 = qp.w2)
SELECT key, round(sum(cost), 5) AS cost FROM c GROUP BY key""")
def query_cost(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), S.tokens(F.col("text")).alias("w"))
    known = words(spark, d)
    return L.query_cost(asked, *L.asked_models(asked, known)).withColumn("cost", F.round("cost", 5))


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+')) AS t FROM benchmark), e AS (SELECT substr(t, i, 1) AS fix, CASE WHEN i = 2 THEN '_' ELSE substr(t, i, 1) END AS orig FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM t)), n AS (SELECT fix, orig, count(*) AS n FROM e GROUP BY ALL)
SELECT fix, orig, n, round(ln(sum(n) OVER (PARTITION BY fix)) - ln(n), 6) + 0 AS cost FROM n""")
def error_model(spark, d):
    """Corrections are benchmark words with their second letter lost, against the words."""
    w = table(spark, d, "benchmark").select(F.explode(S.tokens(F.col("text"))).alias("fixed"))
    return L.error_model(w.select("fixed", F.concat(F.substring("fixed", 1, 1), F.expr("substring(fixed, 3)")).alias("original"))).withColumn("cost", F.round("cost", 6) + 0)


@query("""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+')) AS t FROM benchmark), g AS (SELECT t || '^' AS f, CASE WHEN length(t) = 1 THEN t || '^' WHEN substr(t, 1, 1) = substr(t, 2, 1) THEN '_' || substr(t, 2) || '^' ELSE left(t, 1) || '_' || substr(t, 3) || '^' END AS o FROM t),
e AS (SELECT substr(f, i, 2) AS fix, substr(o, i, 2) AS orig FROM (SELECT f, o, unnest(range(1, length(f))) AS i FROM g)), n AS (SELECT fix, orig, count(*) AS n FROM e GROUP BY ALL)
SELECT fix, orig, n, round(ln(sum(n) OVER (PARTITION BY fix)) - ln(n), 6) + 0 AS cost FROM n""")
def error_model_pairs(spark, d):
    """The same corrections by pairs of characters; of two equal letters the first is the lost one."""
    w = table(spark, d, "benchmark").select(F.explode(S.tokens(F.col("text"))).alias("fixed"))
    return L.error_model(w.select("fixed", F.concat(F.substring("fixed", 1, 1), F.expr("substring(fixed, 3)")).alias("original")), 2).withColumn("cost", F.round("cost", 6) + 0)


@query(TALK.replace("WITH toks", "WITH RECURSIVE toks", 1) + """, nx AS MATERIALIZED (SELECT w1, w2, sum(n) OVER o - n AS low, sum(n) OVER o AS high, sum(n) OVER (PARTITION BY w1) AS total FROM big WINDOW o AS (PARTITION BY w1 ORDER BY n DESC, w2 ROWS UNBOUNDED PRECEDING)),
said(key, pos, term) AS (SELECT item_id, 0, regexp_extract(lower(text), '[A-Za-zА-Яа-я0-9]+') FROM benchmark WHERE regexp_matches(lower(text), '[A-Za-zА-Яа-я0-9]')
  UNION ALL SELECT s.key, s.pos + 1, w2 FROM said s JOIN nx ON nx.w1 = s.term WHERE s.pos < 12 AND ('0x' || left(md5('7:' || s.key || ':' || s.pos), 8))::BIGINT % total BETWEEN low AND high - 1)
SELECT key, pos, term FROM said""")
def generated_text(spark, d):
    """Texts that begin as the benchmark's do and go on for up to 12 words as conversations would."""
    starts = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.get(S.tokens(F.col("text")), F.lit(0)).alias("term")).where("term is not null")
    return L.generated(starts, table(spark, d, "conversations").select(lowered(F.col("text"))), 12, 7)
