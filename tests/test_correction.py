"""The search under an error model against prices of all terms."""

import math
import random
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tidewright.functions import strings as S
from tidewright.operators import correction as K
from tidewright.operators import language as L
from tidewright.plans import language, spelling


def price(word, term, costs):
    """The cheapest edits by filling a table of all prefixes."""
    n, m, far = len(word), len(term), float("inf")
    d = [[far] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    last = far
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j and word[i - 1] == term[j - 1]:
                d[i][j] = min(d[i][j], d[i - 1][j - 1])
            for (u, v), c in costs.items():
                end, u = u.endswith("^"), u.rstrip("^")
                if word[:i].endswith(v) and term[:j].endswith(u) and len(v) <= i and len(u) <= j and d[i - len(v)][j - len(u)] < far:
                    if not end:
                        d[i][j] = min(d[i][j], d[i - len(v)][j - len(u)] + c)
                    elif (i, j) == (n, m):
                        last = min(last, d[i - len(v)][j - len(u)] + c)
    return min(last, d[n][m])


def every(words, terms, costs, limit, match_num, max_diff, alpha, beta):
    out = []
    for w in sorted(set(words)):
        found = sorted((alpha * lm + beta * e, t, lm, e) for t, lm in terms.items() if (e := price(w, t, costs)) <= limit)
        for rank, (_, t, lm, e) in enumerate(found[:match_num], 1):
            if e - found[0][3] > max_diff:
                break
            out.append((w, t, rank, round(lm, 6), round(e, 6)))
    return out


def some(seed, n=60):
    rng = random.Random(seed)
    terms = {"".join(rng.choices("abcd", k=rng.randint(1, 6))): rng.random() * 9 for _ in range(n)}
    words = ["", *(("".join(rng.choices("abcde", k=rng.randint(1, 7)))) for _ in range(25))]
    costs = {}
    for u in ["", "a", "b", "c", "d", "ab", "ba", "cd"]:
        for v in ["", "a", "b", "c", "d", "e", "ba", "ab", "de"]:
            if u != v and rng.random() < 0.4:
                costs[u, v] = rng.random() * 3 + 0.2
    costs |= {("a^", ""): 0.3, ("ab^", "b"): 0.7, ("^", "e"): 0.25}
    return terms, words, costs


@pytest.mark.parametrize(("seed", "limit", "match_num", "max_diff", "alpha", "beta"), [(1, 4.0, 8, 3.0, 1.0, 1.0), (2, 2.0, 3, 1.0, 0.5, 2.0), (3, 6.0, 50, 100.0, 0.0, 1.0)])
def test_search_finds_what_pricing_all_terms_finds(spark, monkeypatch, seed, limit, match_num, max_diff, alpha, beta):
    monkeypatch.setattr(K, "MOST_TERMS", 5)  # many parts and chunks
    monkeypatch.setattr(K, "MOST_WORDS", 7)
    terms, words, costs = some(seed)
    typed = spark.createDataFrame([(w, 1) for w in [*words, *words, None]], "word string, cost int")
    known = spark.createDataFrame([*terms.items(), *((t, c + 1) for t, c in terms.items()), (None, 0.0), ("abcd", None)], "term string, cost double")
    got = K.best_matches(typed, known, costs, limit, match_num, max_diff, alpha, beta)
    assert sorted((r.word, r.term, r["rank"], round(r.lm, 6), round(r.err, 6)) for r in got.collect()) == sorted(every(words, terms, costs, limit, match_num, max_diff, alpha, beta))


def test_reach_covers_every_price():
    for seed in range(5):
        terms, words, costs = some(seed)
        longer, shorter = K.reach(costs, 4.0)
        for w in words:
            for t in terms:
                if price(w, t, costs) <= 4.0:
                    assert len(w) - shorter <= len(t) <= len(w) + longer
    assert K.reach({("a", ""): 0.0}, 1.0)[0] > 1000


def test_parts_hold_every_length_once(monkeypatch):
    monkeypatch.setattr(K, "MOST_TERMS", 10)
    parts = K.parts_of({1: 2, 2: 3, 4: 4, 5: 3, 6: 25, 8: 1})
    assert parts == [(1, 4, 0, 1), (5, 5, 1, 1), (6, 6, 2, 3), (8, 8, 5, 1)] and K.parts_of({}) == []


def test_equal_scores_come_by_term():
    search = K.Search(K.Trie([("ab", 1.0), ("aa", 1.0), ("ac", 1.0)]), {("a", "x"): 0.5, ("b", "x"): 0.5, ("c", "x"): 0.5}, 6.0, 1.0, 1.0)
    assert [t for t, _, _ in search.best("ax", 2)] == ["aa", "ab"]


def test_long_words_and_none(spark):
    long = "ab" * 3000
    known = spark.createDataFrame([(long, 1.0), ("x", 2.0)], "term string, cost double")
    typed = spark.createDataFrame([(long + "c",), ("y",)], "word string")
    got = K.best_matches(typed, known, {("", "c"): 1.0}).collect()
    assert [(r.word, r.term, r.err) for r in got] == [(long + "c", long, 1.0)]
    assert K.best_matches(typed.limit(0), known, {}).count() == K.best_matches(typed, known.limit(0), {}).count() == 0


def test_edits_of_both_orders(spark):
    fixes = [("hte", "the"), ("teh", "the"), ("cats", "cat"), ("dog", "dogs"), ("a b", "ab"), (None, "x")]
    rows = spark.createDataFrame(fixes, "original string, fixed string")
    got = K.edits(L.error_model(rows), L.error_model(rows, 2), limit=6.0)
    assert ("t", "h") in got or ("", "h") in got  # swapped letters, by single characters
    assert got["s^", ""] == pytest.approx(0.0)  # of one s at an end all were lost
    assert ("^", "s") in got or ("t^", "ts") in got
    assert not any("=" in u + v for u, v in got if len(u) > 1 and len(v) > 1)


D = "/root/testdata/sf0.001"


def test_most_misspelt_words_are_found(spark):
    n = spelling.spell_accuracy(spark, D).first()
    assert n.n > 100 and n.first > 0.35 * n.n and n.listed > 0.75 * n.n  # the invented words are close to each other


def test_the_corrector_takes_the_cheapest_text(spark):
    """Priced by plain counts: the text as typed, its layouts, joins and splits, and the best chain of each word's terms."""
    docs = [r.w for r in language.words(spark, D).collect()]
    one, two, start = Counter(t for w in docs for t in w), Counter(p for w in docs for p in pairwise(w)), Counter(t for w in docs for t in w[:-1])
    total = sum(one.values())

    def step(a, b):
        return math.log(start[a] / two[a, b]) if two[a, b] else 100.0

    def head(t):
        return math.log(total / one[t]) if one[t] else 100.0

    def cost(w):
        return (head(w[0]) if w else 0.0) + sum(step(*p) for p in pairwise(w))

    found = defaultdict(list)
    for r in spelling.spell_searched(spark, D).collect():
        found[r.word].append(r.term)
    q = F.col("typed")
    got = spelling.spell_corrected(spark, D).withColumn("gens", F.concat(F.array(q), S.layout_variants(q), S.join_variants(q), S.split_variants(q)))
    got = got.withColumn("tokens", F.transform("gens", S.tokens)).collect()
    assert len(got) == spark.read.parquet(f"{D}/benchmark.parquet").count()
    chained = 0
    for r in got:
        best, n = min((round(cost(w), 5), n) for n, w in enumerate(r.tokens))
        at = {t: head(t) for t in found.get(r.tokens[0][0], [r.tokens[0][0]])}
        for w in r.tokens[0][1:]:
            at = {t: min(c + step(s, t) for s, c in at.items()) for t in found.get(w, [w])}
        chain = min(at.values())
        assert r.cost == pytest.approx(min(best, chain), abs=2e-5)
        if min(best, chain) > 3000:
            assert r.fixed == r.typed
        elif best < chain - 1e-4:
            assert cost(r.tokens[n]) == pytest.approx(best, abs=2e-5) and r.fixed == r.gens[n]
        elif chain < best - 1e-4:
            chained += 1
            assert cost(r.fixed.split(" ")) == pytest.approx(chain, abs=2e-5)
            assert all(t in found.get(w, [w]) for t, w in zip(r.fixed.split(" "), r.tokens[0], strict=True))
    assert chained > 5
