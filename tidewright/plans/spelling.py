"""Queries of the spelling corrector. Typed words are benchmark words without their second letter; the dictionary is the words of all documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import strings as S
from tidewright.operators import control as C
from tidewright.operators import correction as K
from tidewright.operators import language as L
from tidewright.plans.language import DOCS, words
from tidewright.plans.registry import query
from tidewright.plans.text import whole_queries
from tidewright.sources.tables import table

CAND = DOCS + """, typed AS (SELECT DISTINCT left(t, 1) || substr(t, 3) AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+')) AS t FROM benchmark)),
dict AS (SELECT term, cost FROM uni WHERE n >= 5),
cand AS (SELECT word, term, levenshtein(word, term) AS distance, cost FROM typed JOIN dict ON abs(length(word) - length(term)) <= 1 WHERE levenshtein(word, term) <= 1)
"""


def typed(spark, d):
    t = table(spark, d, "benchmark").select(F.explode(S.tokens(F.col("text"))).alias("t"))
    return t.select(F.concat(F.substring("t", 1, 1), F.expr("substring(t, 3)")).alias("word")).distinct()


def dictionary(spark, d):
    """Terms that occur at least 5 times, with their costs; counted once, however often it is used."""
    return C.saved(L.unigrams(words(spark, d)).where("n >= 5"))


def candidates(spark, d):
    known = dictionary(spark, d)
    return L.neighbours(typed(spark, d), known).join(known.select("term", "cost"), "term")


@query(CAND + "SELECT word, term, distance FROM cand")
def spell_candidates(spark, d):
    return candidates(spark, d).select("word", "term", F.col("distance").cast("long").alias("distance"))


@query(CAND + """, o AS (SELECT word, term, cost, distance * 4.0::double AS err, row_number() OVER w AS rank, first_value(distance * 4.0::double) OVER w AS best FROM cand WINDOW w AS (PARTITION BY word ORDER BY round(cost, 6) + distance * 4.0::double, term)),
s AS (SELECT *, max(CASE WHEN err - best > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY word ORDER BY rank) AS stop FROM o)
SELECT word, term, rank FROM s WHERE stop = 0 AND rank <= 8""")
def spell_shortlist(spark, d):
    c = candidates(spark, d).select("word", "term", F.round("cost", 6).alias("lm"), (F.col("distance") * 4.0).alias("err"))
    return L.shortlist(c).select("word", "term", "rank")


VARIANTS = DOCS + """, q AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+'), ' ') AS q FROM benchmark),
v AS (SELECT item_id, 0 AS gen, q AS variant FROM q
  UNION ALL SELECT item_id, i, left(q, i - 1) || substr(q, i + 1) FROM (SELECT *, unnest(range(1, length(q) + 1)) AS i FROM q) WHERE substr(q, i, 1) = ' '
  UNION ALL SELECT item_id, 1000 + i, left(q, i) || ' ' || substr(q, i + 1) FROM (SELECT *, unnest(range(1, length(q))) AS i FROM q)),
vw AS (SELECT item_id, gen, variant, regexp_extract_all(variant, '[A-Za-zА-Яа-я0-9]+') AS w FROM v),
vo AS (SELECT item_id, gen, variant, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM vw),
vp AS (SELECT item_id, gen, variant, pos, lag(term) OVER (PARTITION BY item_id, gen ORDER BY pos) AS w1, term AS w2 FROM vo),
vc AS (SELECT item_id, gen, variant, round(sum(coalesce(CASE WHEN pos = 1 THEN uni.cost ELSE big.cost END, 100)), 5) AS cost FROM vp LEFT JOIN uni ON uni.term = vp.w2 LEFT JOIN big ON big.w1 = vp.w1 AND big.w2 = vp.w2 GROUP BY ALL)
SELECT item_id, CASE WHEN cost > 3000 THEN q ELSE best END AS fixed, cost FROM (SELECT item_id, arg_min(variant, cost * 100000 + gen) AS best, min(cost) AS cost FROM vc GROUP BY item_id) JOIN q USING (item_id)"""


@query(VARIANTS)
def spell_best(spark, d):
    """The cheapest of a query and its joined and split variants, the earliest made on ties; the query itself where all are too unlikely."""
    q = whole_queries(spark, d)
    space = F.filter(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda i: F.substring("q", i, F.lit(1)) == " ")
    joined = F.transform(space, lambda i: F.struct(i.alias("gen"), F.concat(F.substring("q", F.lit(1), i - 1), F.substring("q", i + 1, F.length("q"))).alias("variant")))
    split = F.transform(S.split_variants(F.col("q")), lambda v, i: F.struct((i + 1001).alias("gen"), v.alias("variant")))
    every = F.concat(F.array(F.struct(F.lit(0).alias("gen"), F.col("q").alias("variant"))), joined, split)
    v = q.select("item_id", "q", F.explode(every).alias("x")).select("item_id", "q", "x.gen", "x.variant")
    keyed = v.withColumn("key", F.struct("item_id", "gen"))
    asked = keyed.select("key", S.tokens(F.col("variant")).alias("w"))
    cost = L.query_cost(asked, *L.asked_models(asked, words(spark, d))).withColumn("cost", F.round("cost", 5))
    best = keyed.join(cost, "key").groupBy("item_id", "q").agg(F.min_by("variant", F.struct("cost", "gen")).alias("best"), F.min("cost").alias("cost"))
    return best.select("item_id", F.when(F.col("cost") > 3000, F.col("q")).otherwise(F.col("best")).alias("fixed"), "cost")


@query(CAND.replace("WITH toks", "WITH RECURSIVE toks", 1) + """, q AS (SELECT item_id AS key, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[A-Za-zА-Яа-я0-9]+') AS w FROM benchmark)),
c AS MATERIALIZED (SELECT key, pos, coalesce(term, left(t, 1) || substr(t, 3)) AS term FROM q LEFT JOIN cand ON cand.word = left(t, 1) || substr(t, 3)),
b AS MATERIALIZED (SELECT w1, w2, cost FROM big WHERE w1 IN (SELECT term FROM c)),
chain(key, pos, term, cost) AS (SELECT key, 0::BIGINT, term, coalesce(uni.cost, 100) FROM c LEFT JOIN uni USING (term) WHERE pos = 0
  UNION ALL SELECT h.key, h.pos + 1, c.term, min(h.cost + coalesce(b.cost, 100)) FROM chain h JOIN c ON c.key = h.key AND c.pos = h.pos + 1 LEFT JOIN b ON b.w1 = h.term AND b.w2 = c.term GROUP BY h.key, h.pos, c.term),
n AS (SELECT key, max(pos) AS last FROM q GROUP BY key)
SELECT key, round(min(cost), 5) AS cost FROM chain JOIN n USING (key) WHERE pos = last GROUP BY key""")
def spell_chain(spark, d):
    """Cheapest sentences from each word's candidates, by dynamic programming over positions; a word without candidates stays."""
    w = whole_queries(spark, d).select(F.col("item_id").alias("key"), F.posexplode(F.split("q", " ")).alias("pos", "t"))
    typed_ = w.select("key", "pos", F.concat(F.substring("t", 1, 1), F.expr("substring(t, 3)")).alias("word"))
    c = C.saved(typed_.join(candidates(spark, d).select("word", "term"), "word", "left").select("key", "pos", F.coalesce("term", "word").alias("term")))
    known = words(spark, d)
    asked = L.few(c.select("term").distinct())
    return L.best_chain(c, L.unigrams(known, asked), L.bigrams(known, asked.withColumnRenamed("term", "w1"))).select("key", F.round("cost", 5).alias("cost"))


@query(CAND + """, cut AS (SELECT term, left(term, i - 1) || substr(term, i + 1) AS word FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM dict) WHERE substr(term, i, 1) BETWEEN 'a' AND 'z')
SELECT word, term, min(cost) AS cost FROM (SELECT word, term, 0.0::double AS cost FROM typed JOIN dict ON word = term UNION ALL SELECT word, term, 0.5::double FROM typed JOIN cut USING (word)) GROUP BY word, term""")
def spell_weighted(spark, d):
    """Neighbours under weighted edits: a lost letter costs half."""
    return L.weighted_neighbours(typed(spark, d), dictionary(spark, d), {(c, "_"): 0.5 for c in "abcdefghijklmnopqrstuvwxyz"}, 0.5)


def learned(spark, d):
    """Edits learned from misspelt conversations, which no query corrects."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(S.tokens(F.col("text"))).alias("pos", "t"))
    known = K.misspelt(said, "conv_id", "turn", "pos").groupBy(F.col("word").alias("original"), F.col("t").alias("fixed")).agg(F.count("*").alias("times"))
    known = C.saved(known)  # both models are learned from the same counts
    return K.edits(L.error_model(known), L.error_model(known, 2), limit=6.0)


def misspelt_items(spark, d):
    """key, pos, t, word: benchmark texts by word, and as they are typed."""
    w = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.posexplode(S.tokens(F.col("text"))).alias("pos", "t"))
    return K.misspelt(w, "key", "pos")


@query()
def spell_searched(spark, d):
    """What the learned errors make of each misspelt word, best first: up to 8 terms."""
    found = K.best_matches(misspelt_items(spark, d).select("word"), dictionary(spark, d), learned(spark, d))
    return found.select("word", "term", F.round("lm", 6).alias("lm"), F.round("err", 6).alias("err"), "rank")


@query()
def spell_accuracy(spark, d):
    """Of the words that are misspelt and whose right form the dictionary has: how many the search gives first, and at all."""
    known = dictionary(spark, d)
    w = misspelt_items(spark, d).where("word <> t").select("word", "t").join(known.select(F.col("term").alias("t")), "t", "left_semi")
    found = K.best_matches(w.select("word"), known, learned(spark, d)).select("word", F.col("term").alias("t"), "rank")
    return w.join(found, ["word", "t"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("first"), F.count("rank").alias("listed"))


@query()
def spell_corrected(spark, d):
    """The corrector as a whole, for misspelt benchmark texts. In one minimum stand the text as typed, its layouts, joins and splits, and the best chain of each word's terms, all priced by the
    language model alone; errors learned from other texts only choose the terms (limit 6, 8 terms, 3 apart). A word without terms stays, and so does a text where all are too unlikely."""
    w = misspelt_items(spark, d)
    texts = w.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("q"))
    short = K.best_matches(w.select("word"), dictionary(spark, d), learned(spark, d)).select("word", "term")
    c = C.saved(w.select("key", "pos", "word").join(short, "word", "left").select("key", "pos", F.coalesce("term", "word").alias("term")))
    q = F.col("q")
    gens = F.concat(F.array(q), S.layout_variants(q), S.join_variants(q), S.split_variants(q))
    v = texts.select("key", F.posexplode(gens).alias("gen", "variant"))
    asked = v.select(F.struct("key", "gen").alias("key"), S.tokens(F.col("variant")).alias("w"))
    corpus = words(spark, d)
    terms = L.few(c.select("term").union(asked.select(F.explode("w"))).distinct())
    uni, big = C.saved(L.unigrams(corpus, terms)), C.saved(L.bigrams(corpus, terms.withColumnRenamed("term", "w1")))  # both serve variants and chains
    priced = L.query_cost(asked, uni, big).select(F.col("key.key").alias("key"), F.col("key.gen").alias("gen"), "cost").join(v, ["key", "gen"]).select("key", "gen", "variant", "cost")
    chains = L.best_chain(c, uni, big).select("key", F.lit(1 << 30).alias("gen"), F.col("chain").alias("variant"), "cost")
    best = priced.unionByName(chains).groupBy("key").agg(F.min_by("variant", F.struct(F.round("cost", 5).alias("cost"), "gen")).alias("best"), F.round(F.min("cost"), 5).alias("cost"))
    return best.join(texts, "key").select("key", F.col("q").alias("typed"), F.when(F.col("cost") > 3000, F.col("q")).otherwise(F.col("best")).alias("fixed"), "cost")


@query(CAND + "SELECT word, count(*) AS n, max(rank) AS last FROM (SELECT word, row_number() OVER (PARTITION BY word ORDER BY term) AS rank FROM cand) GROUP BY word")
def spell_counts(spark, d):
    ranked = candidates(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("term")))
    return ranked.groupBy("word").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last"))
