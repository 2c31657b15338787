"""Best-first search of a dictionary under a learned error model.

An error model (fix, orig, cost) of single characters and of pairs of them gives edits: the dictionary's characters `u` were typed as `v`, for -ln p. A gap `_` is nothing, `^` the
end of a word; what is typed right costs nothing. A term's price for a word is that of the cheapest edits that turn it into the word, and its score alpha * lm + beta * price,
where lm is the term's own cost.

The dictionary is dealt by length, and where one length has too many by hash, into parts of about MOST_TERMS terms, and words into chunks of at most about MOST_WORDS; a word only goes to
parts whose lengths its limit can pay for. Few large parts are better than many, since each is searched for its own k best. A task holds one part as a trie whose nodes know the least lm below them, and takes from a priority queue the state (node, place in the word) with the least possible score. So terms come
in order of their scores, and the search ends with the k-th.

Words and terms that are null, and terms without cost, are left out; an empty word finds what is cheap enough to lose. Equal scores are ordered by term; repeated words and terms count once (the
term's least lm).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import language as L

MOST_TERMS, MOST_WORDS = 150_000, 20_000
#: Edits that are sent to all tasks, at most.
MOST_EDITS = 500_000
#: Longer terms share a band.
LONGEST = 64

Edits = dict[tuple[str, str], float]


def edits(*models: DataFrame, limit: float) -> Edits:
    """(u, v) to the least price of error models, as far as the limit pays for it; u ends in ^ where the edit must end the word."""
    rows = None
    for m in models:
        own = m.where(F.col("cost") <= limit).select("fix", "orig", "cost")
        rows = own if rows is None else rows.unionByName(own)
    found = rows.limit(MOST_EDITS + 1).collect()
    if len(found) > MOST_EDITS:
        raise ValueError(f"more than {MOST_EDITS} edits within the limit")
    out: Edits = {}
    for r in found:
        u, v = r.fix.replace("_", ""), r.orig.replace("_", "")
        if u.endswith("^") != v.endswith("^") or "^" in u[:-1] or "^" in v[:-1]:
            continue  # an end can't be typed or lost
        if u != v and r.cost < out.get((u, v.rstrip("^")), float("inf")):
            out[u, v.rstrip("^")] = r.cost
    return out


class Trie:
    """Terms by their characters. least: the lm of the cheapest term at or below a node."""

    def __init__(self, terms: Iterator[tuple[str, float]]):
        self.below: list[dict[str, int]] = [{}]
        self.least, self.term, self.lm = [float("inf")], [None], [float("inf")]
        for term, lm in terms:
            node = 0
            self.least[0] = min(self.least[0], lm)
            for c in term:
                to = self.below[node].get(c)
                if to is None:
                    to = self.below[node][c] = len(self.below)
                    self.below.append({})
                    self.least.append(float("inf"))
                    self.term.append(None)
                    self.lm.append(float("inf"))
                node = to
                self.least[node] = min(self.least[node], lm)
            self.term[node], self.lm[node] = term, min(self.lm[node], lm)

    def walk(self, node: int | None, u: str) -> int | None:
        for c in u:
            node = self.below[node].get(c)
            if node is None:
                return None
        return node


class Search:
    """Of one trie under one set of edits."""

    def __init__(self, trie: Trie, costs: Edits, limit: float, alpha: float, beta: float):
        self.trie, self.limit, self.alpha, self.beta = trie, limit, alpha, beta
        self.inside, self.at_end = defaultdict(list), defaultdict(list)
        for (u, v), price in costs.items():
            if u.endswith("^"):
                self.at_end[v].append((u[:-1], price))
            else:
                self.inside[v].append((u, price))

    def best(self, word: str, k: int) -> list[tuple[str, float, float]]:
        """The k terms of the least scores, in their order: term, lm, price."""
        t, out, seen, given = self.trie, [], set(), set()
        heap = [(self.alpha * t.least[0], 0, "", 0.0, 0, 0)]  # score, is a term, term, price, node, place; at equal scores states come before terms

        def offer(node: int, at: int, price: float) -> None:
            if price <= self.limit and (node, at) not in seen:
                heapq.heappush(heap, (self.beta * price + self.alpha * t.least[node], 0, "", price, node, at))

        def found(node: int, price: float) -> None:
            if t.term[node] is not None and price <= self.limit:
                heapq.heappush(heap, (self.beta * price + self.alpha * t.lm[node], 1, t.term[node], price, node, 0))

        while heap and len(out) < k:
            _, is_term, term, price, node, at = heapq.heappop(heap)
            if is_term:
                if term not in given:
                    given.add(term)
                    out.append((term, t.lm[node], price))
                continue
            if (node, at) in seen:
                continue
            seen.add((node, at))
            if at == len(word):
                found(node, price)
            elif (to := t.below[node].get(word[at])) is not None:
                offer(to, at + 1, price)
            for n in range(min(2, len(word) - at) + 1):
                v = word[at : at + n]
                for u, cost in self.inside.get(v, ()):
                    if (to := t.walk(node, u)) is not None:
                        offer(to, at + n, price + cost)
                if at + n == len(word):
                    for u, cost in self.at_end.get(v, ()):
                        if (to := t.walk(node, u)) is not None:
                            found(to, price + cost)
        return out


def reach(costs: Edits, limit: float) -> tuple[int, int]:
    """How many characters a term can be longer, and shorter, than a word within the limit."""
    longer = shorter = 0.0
    for (u, v), price in costs.items():
        more = len(u.rstrip("^")) - len(v)
        share = abs(more) * limit / price if price > 0 else float("inf")
        longer, shorter = (max(longer, share), shorter) if more > 0 else (longer, max(shorter, share) if more < 0 else shorter)
    return tuple(int(min(x + 1e-9, 1_000_000)) for x in (longer, shorter))


def parts_of(sizes: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Least and greatest length, first number and count of parts for each range of lengths, from how many terms each length has: neighbours share a part while they fit."""
    out, first, low, total = [], 0, None, 0
    for band in sorted(sizes):
        if low is not None and total + sizes[band] > MOST_TERMS:
            out.append((low, last, first, max(1, -(-total // MOST_TERMS))))
            first, low, total = first + out[-1][3], None, 0
        low, last, total = band if low is None else low, band, total + sizes[band]
    return [*out, (low, last, first, max(1, -(-total // MOST_TERMS)))] if low is not None else out


def best_matches(typed: DataFrame, dictionary: DataFrame, costs: Edits, limit: float = 6.0, match_num: int = 8, max_diff: float = 3.0, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """word, term, lm, err, rank: for each of the typed words (column word) terms of the dictionary (term, cost) in order of alpha lm + beta err with err at most the limit,
    cut before the first whose err is over the best's by max_diff, at most match_num. beta must be above 0."""
    if beta <= 0:
        raise ValueError("beta must be above 0")
    longer, shorter = reach(costs, limit)
    spark = typed.sparkSession
    terms = dictionary.where("term is not null and cost is not null").groupBy("term").agg(F.min("cost").alias("lm")).withColumn("band", F.least(F.length("term"), F.lit(LONGEST)))
    words = typed.where("word is not null").select("word").distinct()
    parts = parts_of({r.band: r.n for r in terms.groupBy("band").agg(F.count("*").alias("n")).collect()})  # LONGEST + 1 rows at most
    bands = F.broadcast(spark.createDataFrame([(b, first, subs) for low, high, first, subs in parts for b in range(low, high + 1)], "band int, first int, subs int"))
    ranges = F.broadcast(spark.createDataFrame(parts, "low int, high int, first int, subs int"))  # as many at most
    chunks = max(1, -(-words.count() // MOST_WORDS), spark.sparkContext.defaultParallelism // max(1, sum(p[3] for p in parts)))
    dealt = terms.join(bands, "band").withColumn("part", F.col("first") + F.pmod(F.xxhash64("term"), "subs").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    near = (F.least(F.length("word") - shorter, F.lit(LONGEST)) <= F.col("high")) & (F.length("word") + longer >= F.col("low"))
    asked = words.join(ranges, near).select("word", F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("subs") - 1)).alias("part"))

    def search(terms: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(terms) and len(words):
            own = Search(Trie(zip(terms["term"], terms["lm"], strict=True)), costs, limit, alpha, beta)
            rows = [(w, *m) for w in words["word"] for m in own.best(w, match_num)]
        return pd.DataFrame(rows, columns=["word", "term", "lm", "err"])

    keys = ["part", "chunk"]
    each = dealt.select("term", "lm", *keys).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "word string, term string, lm double, err double")
    return L.shortlist(each, match_num, max_diff, alpha, beta)


def misspelt(words: DataFrame, *key: str) -> DataFrame:
    """words (key columns, t) with word: t, of which a hash of the key chooses an eighth each for a lost, doubled, swapped or wrong letter, and where; words under four letters stay."""
    h = F.xxhash64(*key, F.lit("kind"))
    at = (F.pmod(F.xxhash64(*key, F.lit("place")), F.length("t") - 2) + 2).cast("int")  # never the first letter
    head, here, tail = F.substring("t", F.lit(1), at - 1), F.substring("t", at, F.lit(1)), F.substring("t", at + 1, F.length("t"))
    wrong = F.translate(here, "abcdefghijklmnopqrstuvwxyz", "snvfrdghujkzmbotwedhicqysa")
    kinds: list[Column] = [F.concat(head, tail), F.concat(head, here, here, tail), F.concat(head, F.substring("t", at + 1, F.lit(1)), here, F.substring("t", at + 2, F.length("t"))), F.concat(head, wrong, tail)]
    out = F.col("t")
    for k, c in enumerate(kinds):
        out = F.when((F.length("t") >= 4) & (F.pmod(h, F.lit(8)) == k), c).otherwise(out)
    return words.withColumn("word", out)
