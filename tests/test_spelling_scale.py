"""The corpus is counted once for the dictionary, and isn't shuffled to the asked terms."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import language as L
from tidewright.plans import language, spelling

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["spell_candidates", "spell_shortlist", "spell_weighted"])
def test_corpus_is_counted_once(spark, name):
    plan = getattr(spelling, name)(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not [leaf for leaf in plan.splitlines() if "Relation" in leaf and "n_chars" in leaf]  # the table of documents


@pytest.mark.parametrize("name", ["spell_chain", "spell_best"])
def test_no_token_is_shuffled_to_the_asked_terms(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(spelling, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and not [line for line in semi if "SortMergeJoin" in line]


def test_bigrams_are_not_shuffled_at_each_word(spark):
    plan = language.generated_text(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_misspelt_words_are_counted_once(spark):
    rows = spark.createDataFrame([("hte", "the", 2), ("hte", "the", 1), ("cat", "cat", 4)], "original string, fixed string, times long")
    single = rows.select("original", "fixed", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    for order in (1, 2):
        assert sorted(L.error_model(rows, order).collect()) == sorted(L.error_model(single, order).collect())
