"""Language identification by interpolated Kneser-Ney character models.

Training counts character ORDER-grams of lower-cased words (padded by spaces) over all documents of
the training folds, for each language: counts are summed in the tasks, then by a shuffle of gram
types. All of them make the model. For each order it has sorted arrays of packed grams and contexts with their
discounted probabilities and interpolation weights, which are sent to the executors while there are at most BROADCAST_GRAMS
grams in all languages together. Beyond that the same model stays a table: each distinct gram of the documents is joined with it order
by order, and each document's grams with their costs. Both ways give the same results.

A text's language is the one whose model has the lowest cross-entropy for each character. Its score is the
posterior of that language, with a temperature fitted on all documents of a held-back fold (a fiftieth of the training documents by their id), scored by a model without
them. A text whose cross-entropy is above the REJECT quantile that its language has on these is marked as rejected. The final model
counts them too.

Null texts and texts without a letter are `und` with score 0, rejected. Ties go to the first language
by name. Repeated rows are scored each; texts of any length are whole. Without any training document,
every row is `und`.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import common

ORDER = 4
#: Grams of all languages that are collected and broadcast at most; 16 bytes each, and as much for their contexts at worst.
BROADCAST_GRAMS = 4_000_000
#: The quantile of rejection, the steps its histogram has, and what temperatures are tried.
REJECT, STEP, TEMPERATURES = 0.995, 0.001, np.geomspace(0.005, 1, 24).tolist()
WORDS = regex.compile(r"\p{L}+").findall
U = np.uint64
MAX_PIECES, MAX_KNOWN = 400_000, 1_000_000


def held_out(doc_id: Column) -> Column:
    return common.crc_mod(doc_id, 4) == 2


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER-grams of all words, one for each letter and the space after, and how many each word has."""
    text = "".join([" " * (ORDER - 1) + w + " " for w in words])
    code = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF).astype(U)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    packed = np.zeros(max(0, len(code) - ORDER + 1), U)
    for k in range(ORDER):
        packed = (packed << U(16)) | code[k : k + len(packed)]
    begin = np.cumsum(size + ORDER - 1) - (size + ORDER - 1)
    at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return packed[at], size


def counted(docs: DataFrame) -> DataFrame:
    """lang, gram, n and rest (n without the documents that are held back) over docs (text, lang, held)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, bool], Counter] = {}

        def flush():
            for (lang, back), count in words.items():
                gram, size = grams(list(count))
                kind, where = np.unique(gram, return_inverse=True)
                n = np.bincount(where, np.repeat(np.fromiter(count.values(), np.int64, len(count)), size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kind)), pa.array(kind.view(np.int64)), pa.array(n), pa.array(n * (not back))], ["lang", "gram", "n", "rest"])
            words.clear()

        for part in common.blocks(batches):
            for text, *key in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "held")), strict=True):
                pieces = words.setdefault(tuple(key), Counter())
                for piece, n in Counter((text or "").lower().split()).items():
                    for w in [piece] if piece.isalpha() else WORDS(piece):
                        pieces[w] += n
            if sum(map(len, words.values())) > MAX_PIECES:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(common.freed(scan), "lang string, gram long, n long, rest long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))


def find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether the wanted one is there."""
    at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
    return at, (keys[at] == want) if len(keys) else np.zeros(len(want), bool)


class KneserNey:
    """One language's model: for each order, sorted grams with discounted probabilities and sorted contexts with weights."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, alphabet: int):
        self.orders, self.floor = [], 1.0 / max(1, alphabet)
        tables = {}
        for order in range(ORDER, 0, -1):
            by = np.argsort(gram)
            gram, n = gram[by], n[by]
            tables[order] = (gram, n)
            short = gram & ((U(1) << U(16 * (order - 1))) - U(1))
            gram, n = np.unique(short, return_counts=True)  # continuations: how many characters come before
        for order in range(1, ORDER + 1):
            gram, n = tables[order]
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            cut = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, first = np.unique(gram >> U(16), return_index=True)
            total = np.add.reduceat(n, first).astype(float) if len(n) else np.zeros(0)
            kinds = np.diff(np.append(first, len(gram)))
            owner = np.repeat(np.arange(len(context)), kinds)
            self.orders.append((gram, np.maximum(n - cut, 0) / total[owner], context, cut * kinds / total))

    def cost(self, gram: np.ndarray) -> np.ndarray:
        """-ln p of each gram's last character after the others."""
        p = np.full(len(gram), self.floor)
        for order, (known, value, context, weight) in enumerate(self.orders, 1):
            want = gram if order == ORDER else gram & ((U(1) << U(16 * order)) - U(1))
            at, there = find(known, want)
            c, seen = find(context, want >> U(16))
            p = np.where(seen, np.where(there, value[at] if len(value) else 0, 0) + (weight[c] if len(weight) else 1) * p, p)
        return -np.log(p)


class Scorer:
    """Cross-entropies of texts under every model; distinct grams and pieces are scored once."""

    def __init__(self, models: dict[str, KneserNey]):
        self.langs, self.models = sorted(models), models
        self.gram, self.costs = np.zeros(0, U), np.zeros((0, len(models)))
        self.clear()

    def clear(self) -> None:
        self.codes, self.table, self.size = common.Interner(), np.zeros((0, len(self.langs))), np.zeros(0, np.int64)

    def gram_costs(self, gram: np.ndarray) -> np.ndarray:
        at, there = find(self.gram, gram)
        if not there.all():
            if len(self.gram) > MAX_KNOWN:
                self.gram, self.costs = self.gram[:0], self.costs[:0]
                return self.gram_costs(gram)
            new = np.unique(gram[~there])
            costs = np.stack([self.models[x].cost(new) for x in self.langs], axis=1)
            every = np.concatenate([self.gram, new])
            by = np.argsort(every)
            self.gram, self.costs = every[by], np.concatenate([self.costs, costs])[by]
            at = np.searchsorted(self.gram, gram)
        return self.costs[at]

    def learn(self, pieces: list[str]) -> None:
        words = [[p] if p.isalpha() else WORDS(p) for p in pieces]
        gram, size = grams([w for ws in words for w in ws])
        starts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]
        self.table = np.concatenate([self.table, common.sums(self.gram_costs(gram), starts)])
        self.size = np.concatenate([self.size, np.diff(starts)])

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text a row of cross-entropies, and the characters they are means of."""
        if len(self.codes) > MAX_PIECES:
            self.clear()
        known, pieces, sizes = len(self.codes), [], []
        for text in texts:
            p = text.lower().split()
            pieces += p
            sizes.append(len(p))
        code = self.codes.codes(pieces)
        if len(self.codes) > known:
            self.learn(list(islice(self.codes, known, None)))
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = common.sums(self.size[code], starts)
        return common.sums(self.table[code], starts) / np.maximum(n, 1)[:, None], n


def models_of(counts: DataFrame, column: str, langs: list[str]) -> dict[str, KneserNey]:
    """The model of each language as arrays. counts: at most BROADCAST_GRAMS rows."""
    every = counts.where(F.col(column) > 0).select("lang", "gram", F.col(column).alias("n")).toArrow()
    lang = every.column("lang").to_numpy(zero_copy_only=False)
    gram, n = every.column("gram").to_numpy().view(U), every.column("n").to_numpy()
    mine = {x: lang == x for x in langs}
    return {x: KneserNey(gram[m], n[m], len(np.unique(gram[m] & U(0xFFFF)))) for x, m in mine.items()}


def tables_of(counts: DataFrame, column: str, langs: list[str]) -> dict:
    """The same model as tables: for each order, arrays by language of values by gram and of weights by context; floor: the chance of any character."""
    low = lambda gram, order: gram.bitwiseAND((1 << 16 * order) - 1)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")
    now = counts.where(F.col(column) > 0).select(number.alias("lang"), "gram", F.col(column).alias("n"))
    floor = {r.lang: 1 / r.n for r in now.groupBy("lang").agg(F.count_distinct(low(F.col("gram"), 1)).alias("n")).collect()}
    by_lang = lambda name: F.array(*(F.max(F.when(F.col("lang") == k + 1, F.col(name))) for k in range(len(langs))))
    orders = {}
    for order in range(ORDER, 0, -1):
        now = common.kept(now, "grams")
        cuts = now.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("a"), F.sum((F.col("n") == 2).cast("long")).alias("b"))
        cuts = cuts.select("lang", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") / (F.col("a") + 2 * F.col("b"))).otherwise(0.5).alias("cut"))
        context = F.shiftrightunsigned("gram", 16).alias("context")
        sums = now.join(F.broadcast(cuts), "lang").groupBy("lang", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.first("cut").alias("cut"))
        sums = common.kept(sums, "contexts")
        values = now.withColumn("context", F.shiftrightunsigned("gram", 16)).join(sums, ["lang", "context"]).select("lang", "gram", (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total")).alias("value"))
        weights = sums.select("lang", "context", (F.col("cut") * F.col("kinds") / F.col("total")).alias("weight"))
        orders[order] = common.kept(values.groupBy("gram").agg(by_lang("value").alias("values")), "values"), common.kept(weights.groupBy("context").agg(by_lang("weight").alias("weights")), "weights")
        if order > 1:
            now = now.groupBy("lang", low(F.col("gram"), order - 1).alias("gram")).agg(F.count("*").alias("n"))
    return {"orders": orders, "floor": [floor.get(k + 1, 1.0) for k in range(len(langs))]}


def fitted(scored: DataFrame, langs: list[str]) -> dict:
    """temperature and limits from all rows of scored (lang, entropy by langs): the temperature of TEMPERATURES with the least mean loss, and for each language the REJECT quantile of the entropies of its
    rows that are read right, in steps of STEP, where there are 20. Sums and a histogram of each language come to the driver."""
    scored = scored.withColumn("k", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int")).where("k > 0")  # lang is the name of a language with a model
    scored = common.kept(scored.select("k", F.transform("entropy", lambda e: e - F.array_min("entropy")).alias("over"), F.array_min("entropy").alias("low")), "scored")
    own = F.element_at("over", F.col("k"))
    odds = lambda t: F.aggregate("over", F.lit(0.0), lambda a, e: a + F.exp(-e / t))
    loss = [F.avg(F.least(own / t + F.log(odds(t)), F.lit(-np.log(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    losses = scored.agg(*loss).first()
    out = {"limits": {}}
    if losses[0] is not None:
        out["temperature"] = float(TEMPERATURES[int(np.argmin(losses))])
    right = scored.where(F.array_position("over", 0.0) == F.col("k")).groupBy("k", F.floor(F.col("low") / STEP).alias("step")).agg(F.count("*").alias("n")).toPandas()
    for k, mine in right.sort_values("step").groupby("k"):
        upto = mine["n"].cumsum().to_numpy()
        if upto[-1] >= 20:
            at = int(np.searchsorted(upto, REJECT * upto[-1]))
            out["limits"][langs[k - 1]] = float((mine["step"].iloc[at] + 1) * STEP) + 0.05
    return out


def train(docs: DataFrame) -> dict:
    """The model of docs' text and lang: what identify() takes."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    held = F.coalesce(common.crc_mod(F.col("doc_id"), 1000) < 20, F.lit(False))
    counts = common.kept(counted(known.select("text", "lang", held.alias("held"))), "counts")
    found = counts.groupBy("lang").agg(F.count("*").alias("n"), F.sum("rest").alias("rest")).collect()  # a row for each language
    langs = sorted(r.lang for r in found)
    model = {"langs": langs, "temperature": 0.05, "limits": {x: np.inf for x in langs}}
    if not langs:
        return model
    small = sum(r.n for r in found) <= BROADCAST_GRAMS
    made = models_of if small else tables_of
    first = [x for x in langs if any(r.lang == x and r.rest for r in found)]
    if first:
        model |= fitted(entropies(known.where(held).select("lang", "text"), made(counts, "rest", first)).where("n > 0"), first)
        model["limits"] = {x: model["limits"].get(x, np.inf) for x in langs}
    model["models"] = made(counts, "n", langs)
    common.give_back()
    return model


def entropies(docs: DataFrame, models: dict) -> DataFrame:
    """docs without text, with entropy (one value for each language) and n. models: arrays or tables."""
    if "orders" in models:
        return joined(docs, models)
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(models))
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("entropy", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for part in common.blocks(batches):
            scorer = scorer or Scorer(pickle.loads(blob.value))
            entropy, n = scorer.entropies(part.column("text").fill_null("").to_pylist())
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * entropy.shape[1]), pa.array(entropy.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), wide, pa.array(n)], [*(f.name for f in rest), "entropy", "n"])

    return docs.select(*(f.name for f in rest), "text").mapInArrow(common.freed(scan), schema)


def joined(docs: DataFrame, tables: dict) -> DataFrame:
    """What entropies() gives, by joins with the tables."""
    rest = [c for c in docs.columns if c != "text"]
    rows = common.kept(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches, size=1 << 18):
            for row, text in zip(part.column("_row").to_pylist(), part.column("text").to_pylist(), strict=True):
                gram, n = np.unique(grams(WORDS((text or "").lower()))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), row)), pa.array(gram.view(np.int64)), pa.array(n)], ["_row", "gram", "n"])

    held = common.kept(rows.select("_row", "text").mapInArrow(common.freed(scan), "_row long, gram long, n long"), "held")
    cost = held.select("gram").distinct().withColumn("p", F.array(*(F.lit(x) for x in tables["floor"])))
    for order, (values, weights) in sorted(tables["orders"].items()):
        own = F.col("gram").bitwiseAND((1 << 16 * order) - 1) if order < 4 else F.col("gram")
        cost = cost.withColumn("own", own).join(values.withColumnRenamed("gram", "own"), "own", "left").withColumn("context", F.shiftrightunsigned("own", 16)).join(weights, "context", "left")
        value, weight = (lambda k: F.get(F.col("values"), k)), (lambda k: F.get(F.col("weights"), k))
        cost = cost.select("gram", F.transform("p", lambda p, k: F.when(weight(k).isNull(), p).otherwise(F.coalesce(value(k), F.lit(0.0)) + weight(k) * p)).alias("p"))
    part = held.join(cost, "gram").select("_row", "n", F.posexplode("p").alias("lang", "p"))
    total = part.groupBy("_row", "lang").agg(F.sum("n").alias("n"), F.sum(-F.col("n") * F.log("p")).alias("h"))
    by_row = total.groupBy("_row").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("lang", "h"))), lambda x: x["h"]).alias("h"))
    empty = F.array(*[F.lit(0.0)] * len(tables["floor"]))
    return rows.join(by_row, "_row", "left").select(*rest, F.coalesce(F.transform("h", lambda x: x / F.col("n")), empty).alias("entropy"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every row of docs."""
    langs = model["langs"]
    base = common.texts_of(docs)
    if not langs:
        return base.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    low = F.array_min("entropy")
    at = F.array_position("entropy", low).cast("int")
    limits = F.array(*(F.lit(float(model["limits"][x])) for x in langs))
    total = F.aggregate("entropy", F.lit(0.0), lambda a, e: a + F.exp(-(e - low) / F.lit(model["temperature"])))
    some = F.col("n") > 0
    return entropies(base, model["models"]).select(
        "doc_id",
        F.when(some, F.element_at(F.array(*map(F.lit, langs)), at)).otherwise("und").alias("lang_pred"),
        F.when(some, 1 / total).otherwise(0.0).alias("score"),
        F.when(some, low).alias("cross_entropy"),
        (~some | (low > F.element_at(limits, at))).alias("rejected"),
    )
