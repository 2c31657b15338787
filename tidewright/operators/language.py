"""Word n-gram models and the noisy channel."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.strings import TOKEN
from tidewright.operators.control import saved

#: Cost of what a model has never seen.
UNSEEN = 100.0
#: Terms that are sent to all tasks, at most, to pick a corpus's n-grams.
MOST_ASKED = 500_000
#: Words whose pairs a task counts at once, about, and rows that it hands on at once.
BLOCK_WORDS, BLOCK_ROWS = 2_000_000, 50_000
FOLLOWERS = "w1 string, w2 array<string>, n array<long>"


def unigrams(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """words (key, w: array) to term, n, cost (-ln p); of the asked terms (term, distinct) alone, if given."""
    every = words.select(F.explode("w").alias("term"))
    n = (every if asked is None else every.join(asked, "term", "left_semi")).groupBy("term").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total")) if asked is None else words.agg(F.sum(F.size("w")).alias("total"))
    return n.crossJoin(F.broadcast(total)).select("term", "n", (F.log("total") - F.log("n")).alias("cost"))  # total is one row


def found_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of some texts, one after another, and how many each text has."""
    find = re.compile(TOKEN).findall
    for batch in batches:
        w = batch.column(0).drop_null()
        if pa.types.is_list(w.type):
            yield w.flatten(), w.value_lengths().to_numpy()
            continue
        flat, sizes = [], []
        for text in w:
            found = find(text.as_py())
            flat += found
            sizes.append(len(found))
            if len(flat) >= BLOCK_WORDS // 8:  # as Python strings they take the most memory
                yield pa.array(flat, "string"), np.array(sizes)
                flat, sizes = [], []
        yield pa.array(flat, "string"), np.array(sizes, np.int64)


def rows_of_first(a: np.ndarray, b: np.ndarray, n: np.ndarray, first: pa.Array, second: pa.Array) -> pa.RecordBatch:
    """FOLLOWERS, a row for each run of a, from places a in first, b in second."""
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    offsets = pa.array(np.append(starts, len(a)), "int32")
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (second.take(pa.array(b)), pa.array(n, "int64"))]
    return pa.RecordBatch.from_arrays([first.take(pa.array(a[starts])), *lists], ["w1", "w2", "n"])


def counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOLLOWERS of each block of texts: the words that follow a word there, and how often."""

    def block(held: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode(null_encoding="encode")
        ids, terms, inside = coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.ones(len(coded), bool)
        ends = np.cumsum(np.concatenate([[0], *(size for _, size in held)]))
        inside[ends[ends < len(ids)]] = False  # a text begins there
        at = np.flatnonzero(inside)
        key, n = np.unique(ids[at - 1] * len(terms) + ids[at], return_counts=True)
        a, b = np.divmod(key, max(1, len(terms)))
        rows = rows_of_first(a, b, n, terms, terms)
        rows = rows.filter(pc.is_valid(rows.column("w1")))
        yield from (rows.slice(k, BLOCK_ROWS) for k in range(0, len(rows), BLOCK_ROWS))

    held: list[tuple[pa.Array, np.ndarray]] = []
    for words in found_words(batches):
        held.append(words)
        if sum(len(w) for w, _ in held) >= BLOCK_WORDS:
            yield from block(held)
            held = []
    if held:
        yield from block(held)


def summed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOLLOWERS in order of w1 to w1, w2, n, total. Rows of one w1 are added up as they come, so that it takes memory for its distinct followers and a block."""

    def block(held: list[pa.RecordBatch], over: bool):
        """The pairs' rows; unless it's over, the last w1 stays, as FOLLOWERS."""
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        firsts, seconds = rows.column("w1").dictionary_encode(), rows.column("w2").flatten().dictionary_encode(null_encoding="encode")
        a = np.repeat(firsts.indices.to_numpy().astype(np.int64), rows.column("w2").value_lengths().to_numpy())
        width = len(seconds.dictionary)
        key = a * width + seconds.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        n = np.add.reduceat(rows.column("n").flatten().to_numpy()[order], starts)
        a, b = np.divmod(key[order[starts]], width)
        end = len(a) if over else np.searchsorted(a, a[-1])
        left = rows_of_first(a[end:], b[end:], n[end:], firsts.dictionary, seconds.dictionary)
        a, b, n = a[:end], b[:end], n[:end]
        runs = np.flatnonzero(np.diff(a, prepend=-1))
        total = np.repeat(np.add.reduceat(n, runs), np.diff(runs, append=end)) if end else n
        columns = [firsts.dictionary.take(pa.array(a)), seconds.dictionary.take(pa.array(b)), pa.array(n), pa.array(total)]
        return pa.RecordBatch.from_arrays(columns, ["w1", "w2", "n", "total"]), left

    held: list[pa.RecordBatch] = []
    size, limit = 0, BLOCK_WORDS
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch.column("w2").flatten())
        if size >= limit:
            out, left = block(held, False)
            yield from (out.slice(k, BLOCK_ROWS) for k in range(0, len(out), BLOCK_ROWS))
            held, size = [left.cast(batch.schema)], len(left.column("w2").flatten())  # Spark's columns may be without nulls
            limit = BLOCK_WORDS + 2 * size
    if held:
        out, _ = block(held, True)
        yield from (out.slice(k, BLOCK_ROWS) for k in range(0, len(out), BLOCK_ROWS))


def pair_counts(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """words (w: an array, or a text in lower case) to w1, w2, n, and total, the pairs that start with w1; of the asked first words (w1, distinct) alone, if given. Pairs are counted in blocks of
    texts; a row for each block and first word is shuffled, once, with all that follows it."""
    rows = words.select("w").mapInArrow(counted_pairs, FOLLOWERS)
    rows = rows if asked is None else rows.join(asked, "w1", "left_semi")
    return rows.repartition("w1").sortWithinPartitions("w1").mapInArrow(summed_pairs, "w1 string, w2 string, n long, total long")


def bigrams(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """w1, w2, n, cost: -ln p(w2 | w1), normalised by the bigrams that start with w1; words and asked as in pair_counts()."""
    return pair_counts(words, asked).select("w1", "w2", "n", (F.log("total") - F.log("n")).alias("cost"))


GENERATED = """
WITH RECURSIVE said MAX RECURSION LEVEL {levels} AS (
  SELECT key, 0 AS pos, term FROM {starts}
  UNION ALL
  SELECT {hint} s.key, s.pos + 1, n.w2 FROM said s JOIN {next} n ON n.w1 = s.term
  WHERE s.pos < {steps} AND conv(substring(md5(concat('{seed}', ':', s.key, ':', s.pos)), 1, 8), 16, 10)::bigint % n.total BETWEEN n.low AND n.high - 1)
SELECT key, pos, term FROM said"""


def successors(words: DataFrame) -> DataFrame:
    """w1, w2, low, high, total: a number from 0 below total, the bigrams that start with w1, falls to one w2; frequent ones first, then by word."""
    order = Window.partitionBy("w1").orderBy(F.desc("n"), "w2")
    high = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return pair_counts(words).select("w1", "w2", (high - F.col("n")).alias("low"), high.alias("high"), "total")


def generated(starts: DataFrame, words: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """key, pos, term: from each start (key, distinct, and term) up to so many words more, each drawn from the bigrams of the word before, by recursive SQL. The draw is the first 32 bits of md5 of
    "seed:key:pos" modulo the number of those bigrams, so it is the same wherever it is made. A text ends with a word that nothing follows; a null start stays alone. A level has a row for each start at
    most, which goes to the bigrams if there are at most MOST_ASKED; else the bigrams are shuffled at each level."""
    spark, tag = starts.sparkSession, uuid.uuid4().hex
    names = {"starts": f"_starts_{tag}", "next": f"_next_{tag}"}
    starts = saved(starts.select("key", "term"))
    starts.createOrReplaceTempView(names["starts"])
    hint = "/*+ BROADCAST(s) */" if starts.count() <= MOST_ASKED else ""
    saved(successors(words)).createOrReplaceTempView(names["next"])
    out = spark.sql(GENERATED.format(steps=steps, levels=steps + 2, seed=seed, hint=hint, **names))
    for name in names.values():
        spark.catalog.dropTempView(name)
    return out


def few(terms: DataFrame) -> DataFrame:
    """Distinct terms, computed once, that go to a corpus if there are at most MOST_ASKED; else it is shuffled to them."""
    terms = saved(terms)
    return F.broadcast(terms) if terms.count() <= MOST_ASKED else terms


def asked_models(queries: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unigrams() and bigrams() of words as far as query_cost() of the queries (key, w) needs them."""
    terms = few(queries.select(F.explode("w").alias("term")).distinct())
    return unigrams(words, terms), bigrams(words, terms.withColumnRenamed("term", "w1"))


def query_cost(queries: DataFrame, unigram: DataFrame, bigram: DataFrame) -> DataFrame:
    """queries (key, w) to key, cost: the first word's cost and those of all pairs; 0 without words."""
    first = queries.where(F.size("w") > 0).select("key", F.col("w")[0].alias("term"))
    head = first.join(unigram.select("term", "cost"), "term", "left").select("key", F.coalesce("cost", F.lit(UNSEEN)).alias("cost"))
    zipped = F.arrays_zip(F.col("w").alias("w1"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("w2"))
    later = queries.where(F.size("w") > 1).select("key", F.explode(F.slice(zipped, F.lit(1), F.size("w") - 1)).alias("p")).select("key", "p.w1", "p.w2")
    tail = later.join(bigram.select("w1", "w2", "cost"), ["w1", "w2"], "left").select("key", F.coalesce("cost", F.lit(UNSEEN)).alias("cost"))
    total = head.unionAll(tail).groupBy("key").agg(F.sum("cost").alias("cost"))
    return queries.select("key").join(total, "key", "left").select("key", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def aligned(typed: str, fixed: str) -> list[tuple[str, str]]:
    """Pairs (fixed character, typed character) of a shortest edit script; _ is a gap."""
    if typed == fixed:
        return list(zip(fixed, typed, strict=True))
    n, m = len(typed), len(fixed)
    d = [[i + j if i * j == 0 else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (typed[i - 1] != fixed[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (typed[i - 1] != fixed[j - 1]):
            i, j = i - 1, j - 1
            out.append((fixed[j], typed[i]))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("_", typed[i]))
        else:
            j -= 1
            out.append((fixed[j], "_"))
    return out[::-1]


def error_model(corrections: DataFrame, order: int = 1) -> DataFrame:
    """corrections (original, fixed, and maybe times, how often) to fix, orig, n, cost: -ln p(orig | fix) of characters, or with order 2 of each two that follow each other, ^ ending a
    text. = parts words: it is a character by itself, but in no pair."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for original, fixed, times in zip(frame["original"], frame["fixed"], frame["times"], strict=True):
                edits = aligned(original.replace(" ", "="), fixed.replace(" ", "="))
                if order == 2:
                    two = zip(edits, [*edits[1:], ("^", "^")], strict=True)
                    edits = [(a[0] + b[0], a[1] + b[1]) for a, b in two if "=" not in (*a, *b)]
                rows += [(*e, times) for e in edits]
            yield pd.DataFrame(rows, columns=["fix", "orig", "times"]).groupby(["fix", "orig"], as_index=False, sort=False)["times"].sum()

    known = corrections.where("original is not null and fixed is not null").groupBy("original", "fixed").agg((F.sum("times") if "times" in corrections.columns else F.count("*")).alias("times"))  # each is aligned once
    n = known.mapInPandas(scan, "fix string, orig string, times long").groupBy("fix", "orig").agg(F.sum("times").alias("n"))
    total = n.groupBy("fix").agg(F.sum("n").alias("total"))
    return n.join(total, "fix").select("fix", "orig", "n", (F.log("total") - F.log("n")).alias("cost"))


def neighbours(typed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, term, distance: dictionary terms within one edit of each word, by an equi-join on deletion variants."""

    def variants(c):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c), cut))

    left = typed.select("word", F.explode(variants(F.col("word"))).alias("v"))
    right = dictionary.select("term", F.explode(variants(F.col("term"))).alias("v"))
    found = left.join(right, "v").select("word", "term").distinct()
    return found.withColumn("distance", F.levenshtein("word", "term", 1)).where("distance >= 0")


def weighted_neighbours(typed: DataFrame, dictionary: DataFrame, costs: dict[tuple[str, str], float], limit: float, most_terms: int = 200_000) -> DataFrame:
    """word, term, cost: the cheapest edits under costs[(dictionary character, typed character)] (1 by default, _ for a gap), where at most limit. The dictionary is dealt into parts of
    about most_terms; each part is a trie in one task, which searches it for all words."""
    terms = dictionary.select("term").distinct()
    parts = max(typed.sparkSession.sparkContext.defaultParallelism, -(-terms.count() // most_terms))
    dealt = terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    asked = typed.select("word").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def price(a: str, b: str) -> float:
        return 0.0 if a == b else costs.get((a, b), 1.0)

    def search(terms: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        trie: dict = {}
        for t in terms["term"]:
            node = trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        rows = []
        for word in words["word"]:
            first = [0.0]
            for c in word:
                first.append(first[-1] + price("_", c))
            stack = [(trie, first)]
            while stack:
                node, line = stack.pop()
                if "" in node and line[-1] <= limit:
                    rows.append((word, node[""], line[-1]))
                for c, below in node.items():
                    if not c:
                        continue
                    now = [line[0] + price(c, "_")]
                    for k, w in enumerate(word, 1):
                        now.append(min(line[k - 1] + price(c, w), line[k] + price(c, "_"), now[k - 1] + price("_", w)))
                    if min(now) <= limit:
                        stack.append((below, now))
        return pd.DataFrame(rows, columns=["word", "term", "cost"])

    return dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(search, "word string, term string, cost double")


def shortlist(candidates: DataFrame, match_num: int = 8, max_diff: float = 3.0, alpha: float = 1.0, beta: float = 1.0):
    """candidates (word, term, lm, err) in order of alpha lm + beta err, cut before the first whose err is over the best's by max_diff, at most match_num."""
    own = candidates.groupBy("word", "term").agg(F.min("lm").alias("lm"), F.min("err").alias("err"))
    order = Window.partitionBy("word").orderBy(F.col("lm") * alpha + F.col("err") * beta, "term")
    seen = own.withColumns({"rank": F.row_number().over(order), "best": F.first("err").over(order)})
    stop = F.max((F.col("err") - F.col("best") > max_diff).cast("int")).over(order)
    return seen.withColumn("stop", stop).where((F.col("stop") == 0) & (F.col("rank") <= match_num)).select("word", "term", "lm", "err", F.col("rank").cast("long").alias("rank"))


def best_chain(candidates: DataFrame, unigram: DataFrame, bigram: DataFrame) -> DataFrame:
    """The cheapest chain of candidates (key, pos from 0, term, and maybe err, what a candidate costs by itself) over all positions: key, cost, chain. A step keeps the cheapest chain
    that ends in each candidate, the first by its words on ties, so no product of candidate lists arises."""
    if "err" not in candidates.columns:
        candidates = candidates.withColumn("err", F.lit(0.0))
    node = "struct<cost:double,chain:string>"
    first = candidates.where("pos = 0").join(unigram.select("term", F.col("cost").alias("c")), "term", "left")
    own = F.struct((F.coalesce("c", F.lit(UNSEEN)) + F.col("err")).alias("cost"), F.col("term").alias("chain"))
    start = first.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", own))).cast(f"map<string,{node}>").alias("start"))
    later = candidates.select("key", (F.col("pos") - 1).alias("pos"), F.col("term").alias("next"), "err")
    edges = candidates.select("key", "pos", "term").join(later, ["key", "pos"]).join(bigram.select(F.col("w1").alias("term"), F.col("w2").alias("next"), F.col("cost").alias("c")), ["term", "next"], "left")
    edges = edges.groupBy("key", "pos").agg(F.collect_list(F.struct("term", "next", (F.coalesce("c", F.lit(UNSEEN)) + F.col("err")).alias("c"))).alias("edges"))
    steps = edges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "edges"))).alias("steps"))

    def step(state, s):
        def best(word):
            into = F.filter(s["edges"], lambda e: e["next"] == word)
            return F.array_min(F.transform(into, lambda e: F.struct((state[e["term"]]["cost"] + e["c"]).alias("cost"), F.concat(state[e["term"]]["chain"], F.lit(" "), word).alias("chain"))))

        words = F.array_distinct(F.transform(s["edges"], lambda e: e["next"]))
        return F.map_from_arrays(words, F.transform(words, best)).cast(f"map<string,{node}>")

    last = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), F.col("start"), step)
    return start.join(steps, "key", "left").select("key", F.array_min(F.map_values(last)).alias("x")).select("key", "x.cost", "x.chain")


def edit_prices(pairs: DataFrame, errors: DataFrame) -> DataFrame:
    """word, term, err of pairs (word, term) at most one edit apart: the sum of -ln p(typed | meant) over their characters under an error model (fix, orig, cost)."""
    a, b = F.split("term", ""), F.split("word", "")
    same = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    at = F.when(same > 0, same - 1).otherwise(F.length("term")).cast("int")
    gap = lambda c: F.concat(F.substring(c, F.lit(1), at), F.lit("_"), F.substring(c, at + 1, F.length(c)))
    meant = F.when(F.length("term") < F.length("word"), gap(F.col("term"))).otherwise(F.col("term"))
    typed = F.when(F.length("term") > F.length("word"), gap(F.col("word"))).otherwise(F.col("word"))
    each = pairs.select("word", "term", F.explode(F.arrays_zip(F.split(meant, "").alias("fix"), F.split(typed, "").alias("orig"))).alias("e")).select("word", "term", "e.*")
    priced = each.join(errors.select("fix", "orig", "cost"), ["fix", "orig"], "left")
    return priced.groupBy("word", "term").agg(F.sum(F.coalesce("cost", F.lit(UNSEEN))).alias("err"))
