"""Lemmas by suffix rules that are learned from words with their lemmas.

A pair (word, lemma) says, for each suffix of the word that holds all that changes, what replaces it; a word that is its own lemma says that
its suffixes stay. The rule of a suffix is its commonest replacement. A new word follows the rule of its longest suffix that has one.
Null and empty words have no lemma and give no rows. A pair that is given twice counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the longest suffix, and words that a rule must rest on.
LONGEST, SUPPORT = 4, 3


def attested(words: DataFrame, endings: tuple[str, ...], least: int = 3) -> DataFrame:
    """word and lemma of distinct words: without its longest ending that leaves a word of at least so many letters, or itself."""
    every = words.where("word <> ''").select("word").distinct()
    cut = lambda e: F.when(F.col("word").endswith(e) & (F.length("word") >= least + len(e)), F.struct(F.lit(len(e)).alias("k"), F.expr(f"left(word, length(word) - {len(e)})").alias("stem")))
    forms = every.select("word", F.explode(F.array_compact(F.array(*map(cut, endings)))).alias("x")).select("word", "x.k", "x.stem")
    known = forms.join(every.select(F.col("word").alias("stem")), "stem", "left_semi").groupBy("word").agg(F.max(F.struct("k", "stem")).alias("best"))
    return every.join(known, "word", "left").select("word", F.coalesce("best.stem", "word").alias("lemma"))


def suffixes(longest: int) -> Column:
    return F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))


def learned(pairs: DataFrame, longest: int = LONGEST, support: int = SUPPORT) -> DataFrame:
    """suffix, replacement, n (words that it fits) and n_words (that end so): a rule for each suffix that support words or more agree on."""
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length("word"), F.length("lemma"))), lambda k: F.left("word", k) == F.left("lemma", k)))
    rows = pairs.where("word <> '' and lemma is not null").select("word", "lemma", same.alias("same"), F.explode(suffixes(longest)).alias("k"))
    by = F.when(F.length("word") - F.col("k") <= F.col("same"), F.expr("substring(lemma, length(word) - k + 1)"))  # none where more changes than the suffix
    each = rows.groupBy(F.right("word", F.col("k")).alias("suffix"), by.alias("replacement")).agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("replacement").isNotNull(), F.struct((-F.col("n")).alias("less"), "replacement")))
    rules = each.groupBy("suffix").agg(best.alias("x"), F.sum("n").alias("n_words"))
    return rules.where(-F.col("x.less") >= support).select("suffix", "x.replacement", (-F.col("x.less")).alias("n"), "n_words")


def applied(words: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """word and lemma of distinct words (word), by the rule of the longest suffix; without one, or where nothing would be left, the word itself.
    Words are joined with the rules by their suffixes, so that neither side is broadcast or held whole."""
    every = words.where("word <> ''").select("word").distinct()
    ends = every.select("word", F.explode(suffixes(longest)).alias("k")).withColumn("suffix", F.right("word", F.col("k")))
    found = ends.join(rules.select("suffix", "replacement"), "suffix", "left")
    best = found.groupBy("word").agg(F.max(F.when(F.col("replacement").isNotNull(), F.struct("k", "replacement"))).alias("x"))
    lemma = F.concat(F.expr("left(word, length(word) - x.k)"), F.col("x.replacement"))
    return best.select("word", F.when(lemma != "", lemma).otherwise(F.col("word")).alias("lemma"))
