"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its embedding beside the mean embedding of its character n-grams. The network reads
windows of WINDOW words that overlap by half; a document's score is that of its worst window, shifted and scaled so that 0.7
lies where held-back labelled documents part best, through a logistic function. Of a word's n-grams the network sees the
GRAMS_OF_WORD that tell the classes apart best. Only documents carry labels, so training is by multiple instances: in
each round every labelled document is represented by its worst windows under the network so far (in the first
round, by those with the most telling n-grams), and the network is fitted to them.

The network is fitted to a bounded sample of labelled rows (SAMPLE_DOCS toxic and twice as many others at most, of up to SAMPLE_CHARS); all windows
of all texts are scored. Null and empty texts, and texts without a word, are one window of padding. Repeated
rows are scored each. Labels that disagree for a doc_id count as toxic. With labels of one class or none, every
score is 0 (or 1, if all are toxic).
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import common
from tidewright.llm.segments import Ragged, gather

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
MAX_VOCAB, MAX_GRAMS, GRAMS_OF_WORD = 4000, 6000, 6
#: Labelled documents of each class that the network is fitted to, at most.
SAMPLE_DOCS, ROUNDS, EPOCHS, RATE = 1200, 4, 6, 0.01
#: What a share of others called toxic weighs against the same share of toxic documents missed, where the threshold is placed.
BLAME = 2
#: Characters of a document of that sample, at most: longer ones aren't drawn. They are scored whole.
SAMPLE_CHARS = 100_000
WORDS = regex.compile(r"[\p{L}\p{N}]+").findall
MAX_PIECES = 300_000


def held_out(doc_id: Column) -> Column:
    return common.crc_mod(doc_id, 3) == 1


def grams_of(word: str) -> set[str]:
    """Beginnings and ends of a word, and all its inner 4-grams."""
    w = f"^{word}$"
    return {w[:k] for k in (4, 5, 6, 7) if k < len(w)} | {w[-k:] for k in (4, 5) if k < len(w)} | {w[k : k + 4] for k in range(1, len(w) - 4)}


class Vocabulary:
    """Words and n-grams that the network knows, and each word's input as numbers."""

    def __init__(self, words: list[str], grams: list[tuple[str, float]]):
        self.word = {w: k for k, w in enumerate(words, 1)}  # 0: any other
        self.gram = {g: k for k, (g, _) in enumerate(grams, 1)}
        self.weight = dict(grams)
        # the most telling first; a word keeps its GRAMS_OF_WORD first ones
        self.place = {g: k for k, g in enumerate(sorted(self.gram, key=lambda g: (-abs(self.weight[g]), g)))}
        self.at = [self.gram[g] for g in self.place]
        self.clear()

    def clear(self) -> None:
        self.inputs: dict[tuple, int] = {(-1,): 0}  # row 0 is padding
        self.pieces, self.rows = common.Interner(), Ragged(np.int32)

    def input_of(self, word: str) -> tuple:
        w, get, at = f"^{word}$", self.place.get, self.at
        n = len(w)
        if n < 5:
            return (self.word.get(word, 0),)
        # what grams_of() has
        found = {get(w[k : k + 4]) for k in range(n - 3)}
        if n > 5:
            found |= {get(w[:5]), get(w[-5:])}
        if n > 6:
            found.add(get(w[:6]))
        if n > 7:
            found.add(get(w[:7]))
        found.discard(None)
        return (self.word.get(word, 0), *sorted([at[k] for k in sorted(found)[:GRAMS_OF_WORD]]))

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all texts' words end to end, and where each text's begin."""
        known, pieces, sizes = len(self.pieces), [], []
        for text in texts:
            p = text.lower().split()
            pieces += p
            sizes.append(len(p))
        code = self.pieces.codes(pieces)
        if len(self.pieces) > known:
            fresh = [[self.inputs.setdefault(self.input_of(w), len(self.inputs)) for w in WORDS(p)] for p in islice(self.pieces, known, None)]
            self.rows.add(np.fromiter((i for f in fresh for i in f), np.int32), np.fromiter(map(len, fresh), np.int64, len(fresh)))
        return gather(self.rows.flat, self.rows.ends, code, np.array(sizes, np.int64))


def windows(code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all overlapping windows, padded by 0, and the text that each is of. The last window of a text ends with it."""
    size = np.diff(starts)
    n = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(nth * STRIDE, np.maximum(0, size[text] - WINDOW))
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < size[text][:, None]
    padded = np.append(code, 0)
    return np.where(inside, padded[np.where(inside, starts[text][:, None] + at, len(code))], 0), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent layers, one for each direction, pooled by attention."""

    def __init__(self, n_words: int, n_grams: int, seed: int = 0):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return (rng.standard_normal(shape) / math.sqrt(shape[0] if len(shape) > 1 else 4)).astype(np.float32)

        d = WORD_DIM + CHAR_DIM
        self.p = {"word": 0.1 * normal(n_words + 1, WORD_DIM) * math.sqrt(n_words + 1), "gram": 0.1 * normal(n_grams + 1, CHAR_DIM) * math.sqrt(n_grams + 1), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32), "att": normal(2 * HIDDEN, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": normal(ATTENTION)}
        for side in "fb":
            self.p |= {f"w{side}": normal(d, 3 * HIDDEN), f"u{side}": normal(HIDDEN, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, n-gram numbers (0 for none) and 1 over how many, of input rows."""
        word = np.array([max(0, r[0]) for r in rows], np.int64)
        gram = np.zeros((len(rows), GRAMS_OF_WORD), np.int64)
        for k, r in enumerate(rows):
            gram[k, : len(r) - 1] = r[1:]
        return word, gram, (1 / np.maximum(1, (gram > 0).sum(axis=1))).astype(np.float32)

    def embed(self, word: np.ndarray, gram: np.ndarray, share: np.ndarray) -> np.ndarray:
        chars = (self.p["gram"][gram] * (gram > 0)[..., None]).sum(axis=1) * share[:, None]
        return np.concatenate([self.p["word"][word], chars], axis=1)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: x @ self.p[f"w{side}"] + self.p[f"b{side}"] for side in "fb"}

    def recur(self, side: str, gates: np.ndarray, real: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States after each step; gates: (window, step, 3 HIDDEN), in reading order of the side."""
        n, steps, _ = gates.shape
        u = self.p[f"u{side}"]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            g = gates[:, t]
            hu = h @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = 2 / (1 + np.exp(-2 * (g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :]))) - 1
            new = c + z * (h - c)
            if real is not None:
                new = np.where(real[:, t, None], new, h)
            if keep is not None:
                keep.append((h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def pool(self, states: np.ndarray, real: np.ndarray | None) -> tuple:
        a = np.tanh(states @ self.p["att"] + self.p["att_b"])
        e = a @ self.p["att_v"]
        if real is not None:
            e = np.where(real, e, -30)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        w = e / e.sum(axis=1, keepdims=True)
        c = np.einsum("nt,nth->nh", w, states)
        return a, w, c, c @ self.p["out"] + self.p["bias"][0]

    def logits(self, table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Of windows; table: projections of all input rows."""
        out = np.empty(len(rows), np.float32)
        for k in range(0, len(rows), 2048):
            part = rows[k : k + 2048]
            real = None if (part > 0).all() else part > 0
            forth = self.recur("f", table["f"][part], real)
            back = self.recur("b", table["b"][part[:, ::-1]], None if real is None else real[:, ::-1])
            states = np.concatenate([forth, back[::-1]], axis=2).transpose(1, 0, 2)
            out[k : k + 2048] = self.pool(states, real)[3]
        return out

    def step(self, inputs: tuple, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log-loss over windows."""
        word, gram, share = inputs
        used, where = np.unique(rows, return_inverse=True)
        where = where.reshape(rows.shape)
        x = self.embed(word[used], gram[used], share[used])
        gates = self.project(x)
        real = rows > 0
        kept: dict[str, list] = {"f": [], "b": []}
        forth = self.recur("f", gates["f"][where], real, kept["f"])
        back = self.recur("b", gates["b"][where[:, ::-1]], real[:, ::-1], kept["b"])
        states = np.concatenate([forth, back[::-1]], axis=2).transpose(1, 0, 2)
        a, w, c, logit = self.pool(states, real)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["bias"] = c.T @ d, d.sum(keepdims=True)
        dc = d[:, None] * self.p["out"]
        dw = np.einsum("nh,nth->nt", dc, states)
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True)) * real
        g["att_v"] = np.einsum("nt,nta->a", de, a)
        da = de[..., None] * self.p["att_v"] * (1 - a * a)
        g["att"], g["att_b"] = np.einsum("nth,nta->ha", states, da), da.sum(axis=(0, 1))
        ds = w[..., None] * dc[:, None] + da @ self.p["att"].T
        dx = np.zeros_like(x)
        for side, part, order in (("f", ds[..., :HIDDEN], where), ("b", ds[:, ::-1, HIDDEN:], where[:, ::-1])):
            live = real if side == "f" else real[:, ::-1]
            u, dh = self.p[f"u{side}"], np.zeros((len(rows), HIDDEN), np.float32)
            for t in range(WINDOW - 1, -1, -1):
                h, z, r, cand, hun = kept[side][t]
                dh = dh + part[:, t]
                dn = np.where(live[:, t, None], dh, 0)
                dcand = dn * (1 - z) * (1 - cand * cand)
                dz = dn * (h - cand) * z * (1 - z)
                dr = dcand * hun * r * (1 - r)
                gate = np.concatenate([dz, dr, dcand], axis=1)
                into = np.concatenate([dz, dr, dcand * r], axis=1)
                g[f"u{side}"] += h.T @ into
                dh = np.where(live[:, t, None], dn * z + into @ u.T, dh)
                g[f"b{side}"] += gate.sum(axis=0)
                g[f"w{side}"] += x[order[:, t]].T @ gate
                np.add.at(dx, order[:, t], gate @ self.p[f"w{side}"].T)
        np.add.at(g["word"], word[used], dx[:, :WORD_DIM])
        spread = dx[:, WORD_DIM:] * share[used][:, None]
        for k in range(GRAMS_OF_WORD):
            np.add.at(g["gram"], gram[used, k], spread * (gram[used, k] > 0)[:, None])
        return g


def vocabulary(texts: list[str], toxic: np.ndarray) -> Vocabulary:
    """Words and n-grams of the sample that are frequent or tell the classes apart, by how many documents have them."""
    seen: list[dict[str, Counter]] = [{"w": Counter(), "g": Counter()} for _ in range(2)]
    cache: dict[str, set[str]] = {}
    for text, y in zip(texts, toxic.tolist(), strict=True):
        words = set(WORDS(text.lower()))
        seen[y]["w"].update(words)
        found = set()
        for w in words:
            if w not in cache:
                cache[w] = grams_of(w)
            found |= cache[w]
        seen[y]["g"].update(found)
    n = np.bincount(toxic, minlength=2)

    def telling(kind: str, most: int) -> list[tuple[str, float]]:
        odds = {}
        for w in set(seen[0][kind]) | set(seen[1][kind]):
            a, b = seen[1][kind][w], seen[0][kind][w]
            if a + b >= 3:
                lift = math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
                odds[w] = (lift * math.sqrt(a + b), a + b, lift)
        by_tell = sorted(odds, key=lambda w: (-abs(odds[w][0]), w))[: most // 2]
        by_count = sorted(set(odds) - set(by_tell), key=lambda w: (-odds[w][1], w))[: most // 2]
        return [(w, odds[w][0]) for w in [*by_tell, *by_count]]

    return Vocabulary([w for w, _ in telling("w", MAX_VOCAB)], telling("g", MAX_GRAMS))


def fit(texts: list[str], toxic: np.ndarray, seed: int = 0) -> dict:
    """The model of a sample: what score() takes."""
    if len(set(toxic.tolist())) < 2:
        return {"constant": float(toxic[0]) if len(toxic) else 0.0}
    words = vocabulary(texts, toxic)
    code, starts = words.codes(texts)
    rows, text = windows(code, starts)
    inputs = list(words.inputs)
    net = Network(len(words.word), len(words.gram), seed)
    numbers = net.inputs(inputs)
    name = {k: g for g, k in words.gram.items()}
    tell = np.array([max((words.weight[name[k]] for k in r[1:]), default=0.0) for r in inputs])
    logit = np.sort(tell[rows], axis=1)[:, -3:].sum(axis=1)
    rng = np.random.default_rng(seed)
    check = rng.random(len(texts)) < 0.2  # calibrates, isn't fitted
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    ticks, best = 0, {}
    for turn in range(ROUNDS):
        order = np.lexsort((-logit, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = order[(rank < np.where(toxic[text[order]] == 1, 1, 3)) & ~check[text[order]]]
        y = toxic[text[chosen]].astype(np.float32)
        weight = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())).astype(np.float32)
        for _ in range(EPOCHS):
            mixed = rng.permutation(len(chosen))
            for k in range(0, len(mixed), 256):
                pick = mixed[k : k + 256]
                ticks += 1
                for p, d in net.step(numbers, rows[chosen[pick]], y[pick], weight[pick]).items():
                    m, v = moment[p]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    net.p[p] -= RATE * (0.5 if turn else 1) * (m / (1 - 0.9**ticks)) / (np.sqrt(v / (1 - 0.999**ticks)) + 1e-8)
        logit = net.logits(net.project(net.embed(*numbers)), rows)
    worst = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(worst, text, logit)
    best = calibrated(worst[check] if len(set(toxic[check].tolist())) == 2 else worst, toxic[check] if len(set(toxic[check].tolist())) == 2 else toxic)
    words.clear()
    return {"net": net, "words": words, "scale": best}


def calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (from the median distance) and offset so that 0.7 lies where the classes part best: with the least sum of the share of toxic documents missed and BLAME times the share of others called toxic."""
    by = np.argsort(logit)
    missed, blamed = np.concatenate([[0], np.cumsum(y[by] == 1)]), np.concatenate([np.cumsum((y[by] == 0)[::-1])[::-1], [0]])
    wrong = missed * int((y == 0).sum()) + BLAME * blamed * int((y == 1).sum())
    edge = np.concatenate([[logit[by[0]] - 1], (logit[by[1:]] + logit[by[:-1]]) / 2, [logit[by[-1]] + 1]])
    least = edge[wrong == wrong.min()]
    cut = float((least.min() + least.max()) / 2)
    spread = max(0.5, float(np.median(np.abs(logit - cut))))
    return 4 / spread, cut


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits the model to labels (doc_id, toxic) of docs; a bounded sample of each class travels to the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, n in sorted(count.items()):
        most = SAMPLE_DOCS * (1 if y else 2)
        some = known.where((F.col("toxic") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < min(1_000_000, math.ceil(1_000_000 * 0.95 * most / n)))).limit(most)
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return fit([], np.zeros(0, np.int64))
    known = common.texts_of(docs).where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    rows = known.join(F.broadcast(picked), "doc_id").limit(3 * SAMPLE_DOCS).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return fit([r.text or "" for r in rows], np.array([1 if r.toxic else 0 for r in rows], np.int64))


class Scorer:
    def __init__(self, model: dict):
        self.net, self.words, (self.slope, self.cut) = model["net"], model["words"], model["scale"]
        self.table, self.n = {}, 0

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.words.pieces) > MAX_PIECES:
            self.words.clear()
            self.n = 0
        code, starts = self.words.codes(texts)
        if len(self.words.inputs) > self.n:
            fresh = self.net.project(self.net.embed(*self.net.inputs(list(islice(self.words.inputs, self.n, None)))))
            self.table = {s: np.concatenate([self.table[s], fresh[s]]) if self.n else fresh[s] for s in "fb"}
            self.n = len(self.words.inputs)
        rows, text = windows(code, starts)
        worst = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(worst, text, self.net.logits(self.table, rows))
        return sigmoid(self.slope * (worst.astype(float) - self.cut) + math.log(0.7 / 0.3))


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row."""
    if "constant" in model:
        out = common.texts_of(docs).select("doc_id", F.lit(model["constant"]).alias("score"))
    else:
        blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by MAX_VOCAB and MAX_GRAMS

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = None
            for part in common.blocks(batches, size=1 << 20):
                scorer = scorer or Scorer(pickle.loads(blob.value))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scorer.scores(part.column("text").fill_null("").to_pylist()))], ["doc_id", "score"])

        out = common.texts_of(docs).mapInArrow(common.freed(scan), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
