"""Suffix rules against a plain reading of their docstring."""

import random
from collections import Counter, defaultdict

from tidewright.operators import lemmas as L


def plain_rules(pairs, longest, support):
    by = defaultdict(Counter)
    for word, lemma in pairs:
        for k in range(1, min(longest, len(word)) + 1):
            stem = word[: len(word) - k]
            by[word[-k:]][lemma[len(stem) :] if lemma.startswith(stem) else None] += 1
    out = {}
    for suffix, found in by.items():
        some = [(-n, r) for r, n in found.items() if r is not None]
        if some and -min(some)[0] >= support:
            out[suffix] = (min(some)[1], -min(some)[0], sum(found.values()))
    return out


def plain_lemma(word, rules, longest):
    for k in range(min(longest, len(word)), 0, -1):
        if word[-k:] in rules:
            return word[: len(word) - k] + rules[word[-k:]][0] or word
    return word


def test_rules_against_plain_python(spark):
    rng = random.Random(3)
    stem = lambda: "".join(rng.choices("abdeiklnrstyé", k=rng.randint(1, 6)))
    pairs = []
    for _ in range(400):
        s = stem()
        pairs.append(rng.choice([(s + "ies", s + "y"), (s + "ing", s), (s + "ing", s + "e"), (s + "s", s), (s + "ß", s + "ss"), (s, s), ("ge" + s + "t", s + "en"), (s, s + "en")]))
    pairs += pairs[:30]
    rules = L.learned(spark.createDataFrame([*pairs, (None, "x"), ("", "x"), ("x", None)], "word string, lemma string"), 3, 2)
    want = plain_rules(pairs, 3, 2)
    assert {r.suffix: (r.replacement, r.n, r.n_words) for r in rules.collect()} == want
    words = [stem() + rng.choice(["ies", "ing", "s", "", "t", "ß"]) for _ in range(200)] + ["s", "q"]
    got = L.applied(spark.createDataFrame([(w, 1) for w in [*words, words[0], "", None]], "word string, suffix int"), rules, 3).collect()
    assert len(got) == len(set(words)) and {r.word: r.lemma for r in got} == {w: plain_lemma(w, want, 3) for w in words}


def test_rules_reach_new_words(spark):
    """A language with regular forms is learned from two words in three."""
    rng = random.Random(8)
    pairs = {}
    for _ in range(600):
        s = "".join(rng.choices("bcdfgklmnprt", k=3)) + rng.choice("aou") + rng.choice("lnr")
        pairs[s + rng.choice(["ity", "ities", "ed", "ing"])] = s
    fix = [(w, s + "ity" if w.endswith(("ity", "ities")) else s) for w, s in sorted(pairs.items())]
    known, new = fix[::3] + fix[1::3], fix[2::3]
    rules = L.learned(spark.createDataFrame(known, "word string, lemma string"))
    got = {r.word: r.lemma for r in L.applied(spark.createDataFrame(new, "word string, lemma string"), rules).collect()}
    assert sum(got[w] == lemma for w, lemma in new) >= 0.98 * len(new)


def test_attested_forms_and_empty_tables(spark):
    words = spark.createDataFrame([(w,) for w in ["walk", "walks", "walked", "bus", "bu", "es", "walkes", "walk", None, ""]], "word string")
    got = {r.word: r.lemma for r in L.attested(words, ("s", "es", "ed")).collect()}
    assert got == {"walk": "walk", "walks": "walk", "walked": "walk", "bus": "bus", "bu": "bu", "es": "es", "walkes": "walk"}
    none = spark.createDataFrame([], "word string, lemma string")
    rules = L.learned(none)
    assert rules.count() == 0 and L.applied(none, rules).count() == 0
    assert [r.lemma for r in L.applied(words.limit(1), rules).collect()] == ["walk"]
