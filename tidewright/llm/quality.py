"""Quality by co-training of two views.

The text view sees hashed byte trigrams of a document. The metadata view sees no words: its source and language, its
length, and its layout (lines, and the shares of the kinds of characters). Each view is a logistic classifier in numpy. In each
round, each view labels the unlabelled documents it is surest of, and these join the other view's training
set. Afterwards each view is calibrated on held-back labelled documents, and a document's score is the mean of
the calibrated log-odds. All whole texts are scored.

The views are fitted to a bounded sample (LABELLED and UNLABELLED documents at most). Null and empty texts have
score 0 and are rejected. Repeated rows are scored each. A doc_id with labels that disagree counts by the mean. With labels of
one class or none nothing can be told apart: all documents but empty ones have score 1 and are kept. Columns that docs may lack (lang,
source) count as null. In what score() returns, its columns take the place of columns of docs with their names; kept_rows() leaves
all columns of docs as they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import common

TRIGRAMS, STRONG, META = 2048, 3, 64
#: Documents that the views are fitted to, at most.
LABELLED, UNLABELLED = 4000, 4000
ROUNDS, SHARE = 3, 0.05
KEEP = 0.5


def text_view(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, and in STRONG columns how concentrated they are."""
    n = len(starts) - 1
    size = np.diff(starts)
    out = np.zeros((n, TRIGRAMS + STRONG), np.float32)
    if len(data) >= 3:
        b = data.astype(np.uint32)
        h = ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> 16) % TRIGRAMS
        owner = np.repeat(np.arange(n), size)
        inside = owner[:-2] == owner[2:]
        count = np.bincount(owner[:-2][inside] * TRIGRAMS + h[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        share = count / np.maximum(1, size - 2)[:, None]
        out[:, :TRIGRAMS] = np.sqrt(share)
        kinds_ = (share > 0).sum(axis=1) / np.maximum(1, np.minimum(size, TRIGRAMS))
        out[:, TRIGRAMS:] = np.stack([kinds_, np.log(np.maximum((share * share).sum(axis=1), 1e-9)), share.max(axis=1)], axis=1)
    return out


LETTER, UPPER, DIGIT, SPACE, LINE, ENDS, MARK = range(7)


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    every = list(map(chr, range(0x110000)))
    out = np.full(len(every), MARK, np.uint8)
    for kind, of in ((LETTER, str.isalpha), (UPPER, lambda c: c.isalpha() and c.isupper()), (DIGIT, str.isdigit), (SPACE, str.isspace)):
        out[np.fromiter(map(of, every), bool, len(every))] = kind
    out[ord("\n")] = LINE
    out[[ord(c) for c in ".,;:?"]] = ENDS
    return out


def meta_views(texts: list[str], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """Length, layout and hashed language and source of each document."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, owner = kinds()[code], np.repeat(np.arange(len(texts)), size)
    count = np.bincount(owner * 8 + kind, minlength=8 * len(texts)).reshape(-1, 8)
    n, lines = np.maximum(1, size), count[:, LINE] + 1
    letters = (count[:, LETTER] + count[:, UPPER]) / n
    shares = [count[:, k] / n for k in (UPPER, DIGIT, SPACE, LINE, ENDS, MARK)]
    white = (kind == SPACE) | (kind == LINE)
    lone = (kind >= ENDS)[1:-1] & white[:-2] & white[2:] & (owner[:-2] == owner[2:])  # marks between white space
    # how much the lines differ in length
    stop = np.cumsum(size)
    at = np.flatnonzero(kind == LINE)
    ends, inner = np.concatenate([at, stop]), np.concatenate([np.ones(len(at), np.int64), np.zeros(len(stop), np.int64)])
    line_of = np.concatenate([owner[at], np.arange(len(texts))])
    by = np.lexsort((inner, ends, line_of))
    ends, inner, line_of = ends[by], inner[by], line_of[by]
    length = np.diff(np.concatenate([[0], ends + inner])) - inner
    mean = np.bincount(line_of, length, len(texts)) / lines
    spread = np.sqrt(np.maximum(0, np.bincount(line_of, length * length, len(texts)) / lines - mean * mean)) / (mean + 1)
    out = np.zeros((len(texts), META))
    own = [np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 5, letters, *shares, 10 * np.bincount(owner[1:-1][lone], minlength=len(texts)) / n, spread]
    out[:, : len(own)] = np.stack(own, axis=1)
    for key, values in (("l", langs), ("s", sources)):
        cell = [len(own) + zlib.crc32(f"{key}{v}".encode()) % (META - len(own)) for v in values]
        out[np.arange(len(texts)), cell] = 1
    return out


def meta_view(text: str, lang: str | None, source: str | None) -> list[float]:
    return meta_views([text], [lang], [source])[0].tolist()


def views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = part.column("text").fill_null("").to_pylist()
    meta = meta_views(texts, part.column("lang").to_pylist(), part.column("source").to_pylist())
    return text_view(*common.raw(part.column("text"))), meta.astype(np.float32)


class Logistic:
    """Features with a deviation of 1, or less where they hardly vary, and of 4 in STRONG columns; a weighted logistic loss with a quadratic penalty, full steps of Adam."""

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], penalty: float = 1e-3, steps: int = 120) -> Logistic:
        """parts: features, labels, and whether a row counts (1 or 0); matrices are used in place."""
        n = sum(float(use.sum()) for _, _, use in parts)
        self.mean = sum(use @ x for x, _, use in parts) / n
        square = sum(np.einsum("ij,ij,i->j", x, x, use) for x, _, use in parts) / n
        self.scale = np.maximum(np.sqrt(np.maximum(square - self.mean**2, 0)) + 1e-3, 0.02)
        self.scale[TRIGRAMS:] /= 4
        share = [max(1.0, sum(float(use[y == k].sum()) for _, y, use in parts)) for k in range(2)]
        weights = [np.where(y == 1, 0.5 / share[1], 0.5 / share[0]).astype(np.float32) * use for _, y, use in parts]
        w, m, v = (np.zeros(len(self.mean) + 1, np.float32) for _ in range(3))
        for t in range(1, steps + 1):
            self.w = w
            ds = [weight * (1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30))) - y) for (x, y, _), weight in zip(parts, weights, strict=True)]
            d = sum(float(one.sum()) for one in ds)
            g = (sum(one @ x for one, (x, _, _) in zip(ds, parts, strict=True)) - d * self.mean) / self.scale + penalty * w[1:]
            g = np.concatenate([[d], g]).astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w = w - 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        self.w, self.a, self.b = w.astype(np.float32), 1.0, 0.0
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        w = self.w[1:] / self.scale
        return x @ w + (self.w[0] - self.mean @ w)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset of the log-odds, by Newton steps on smoothed targets."""
        s = self.raw(x)
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        design, beta = np.stack([s, np.ones_like(s)], axis=1).astype(float), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            hessian = design.T @ (design * np.maximum(p * (1 - p), 1e-6)[:, None]) + 1e-3 * np.eye(2)
            beta = beta - np.clip(np.linalg.solve(hessian, design.T @ (p - t) + 1e-3 * (beta - [1, 0])), -1, 1)
        self.a, self.b = max(0.05, float(beta[0])), float(beta[1])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -12, 12)


def cotrain(seen: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> tuple[Logistic, Logistic] | None:
    """The two calibrated classifiers, or None if y has one class."""
    hold = np.arange(len(y)) % 5 == 0
    if len(set(y.tolist())) < 2 or len(set(y[~hold].tolist())) < 2:
        return None
    # a view's training rows: labelled ones, and those of the pool with the label that the other view gave
    use, given = (~hold).astype(np.float32), [np.zeros(0, np.int64)] * 2
    told = [np.zeros(0, y.dtype)] * 2
    free = np.arange(len(pool[0]))
    for turn in range(rounds + 1):
        made = [Logistic().fit([(seen[k], y, use), (pool[k][given[k]], told[k], np.ones(len(told[k]), np.float32))]) for k in range(2)]
        if turn == rounds or not len(free):
            break
        n = max(1, int(SHARE * len(free)))
        taken = set()
        for k in range(2):
            s = made[k].raw(pool[k][free])
            by = np.argsort(s, kind="stable")
            share = y[~hold].mean()
            low, high = by[: max(1, round(n * (1 - share)))], by[len(by) - max(1, round(n * share)) :]
            low, high = low[s[low] < -1], high[s[high] > 1]
            for at, label in ((low, 0), (high, 1)):
                given[1 - k] = np.concatenate([given[1 - k], free[at]])
                told[1 - k] = np.concatenate([told[1 - k], np.full(len(at), label, y.dtype)])
                taken.update(free[at].tolist())
        free = np.array(sorted(set(free.tolist()) - taken), np.int64)
    check = hold if len(set(y[hold].tolist())) == 2 else np.ones(len(y), bool)
    for k in range(2):
        made[k].calibrate(seen[k][check], y[check])
    return made[0], made[1]


def base_of(docs: DataFrame) -> DataFrame:
    def column(name: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast("string").alias(name)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), column("text"), column("lang"), column("source"))


def sampled(docs: DataFrame, most: int, n: int, seed: int) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < min(1_000_000, math.ceil(950_000 * most / max(1, n)))).limit(most)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Logistic, Logistic] | None:
    """Fits both views to labels (doc_id, quality); features of a bounded sample travel to the driver."""
    base = base_of(docs).where("text is not null and doc_id is not null")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    picked = sampled(known, LABELLED, known.count(), 1)
    chosen = base.join(F.broadcast(picked), "doc_id", "left")
    n = docs.count()
    some = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) < min(1_000_000, math.ceil(950_000 * UNLABELLED / max(1, n)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches):
            a, b = views(part)
            both = np.concatenate([a, b], axis=1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in both], pa.binary())], ["doc_id", "y", "x"])

    common.release(docs.sparkSession)  # the driver holds the sample next
    rows = chosen.where(F.col("y").isNotNull() | some).mapInArrow(common.freed(scan), "doc_id long, y int, x binary").limit(LABELLED + UNLABELLED).toArrow()
    width = TRIGRAMS + STRONG + META
    ids, y = rows.column("doc_id").to_numpy(), rows.column("y").fill_null(-1).to_numpy()
    chunks = rows.column("x").chunks
    del rows
    blocks = lambda c: common.raw(c)[0].view(np.float16).reshape(-1, width)
    order = np.lexsort((np.concatenate([np.zeros(0, np.float16), *(blocks(c)[:, 0] for c in chunks)]), ids))
    place = np.empty(len(order), np.int64)  # of each row among the labelled ones, or among the others
    y = y[order]
    for mask in (y >= 0, y < 0):
        place[order[mask]] = np.arange(mask.sum())
    known = np.empty(len(order), bool)
    known[order] = y >= 0
    seen, pool = ((np.zeros((n, TRIGRAMS + STRONG), np.float32), np.zeros((n, META), np.float32)) for n in (int((y >= 0).sum()), int((y < 0).sum())))
    at = 0
    while chunks:
        part = blocks(chunks.pop(0))
        for k in range(0, len(part), 500):
            some, here = part[k : k + 500], slice(at + k, at + min(k + 500, len(part)))
            for mask, (text, meta) in ((known[here], seen), (~known[here], pool)):
                text[place[here][mask]], meta[place[here][mask]] = some[mask][:, : TRIGRAMS + STRONG], some[mask][:, TRIGRAMS + STRONG :]
        at += len(part)
        del part, some
    common.give_back()
    model = cotrain(seen, y[y >= 0].astype(np.float32), pool)
    del seen, pool
    common.give_back()
    return model


def scored(docs: DataFrame, model: tuple[Logistic, Logistic] | None, names: list[str], keep: float) -> DataFrame:
    """All columns of docs, which has none of the names, with both views' scores, the score and the decision under these names."""
    if model is None:
        out = docs
        some = F.length(F.coalesce(F.col("text"), F.lit(""))) > 0
        for name in names[:3]:
            out = out.withColumn(name, some.cast("double"))
        return out.withColumn(names[3], F.col(names[2]) >= keep)

    own = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches, size=1 << 20):
            a, b = views(part)
            odds = [model[0].odds(a), model[1].odds(b)]
            empty = np.asarray(pc.binary_length(part.column("text")).fill_null(0)) == 0
            made = [np.where(empty, 0.0, 1 / (1 + np.exp(-o))) for o in (odds[0], odds[1], (odds[0] + odds[1]) / 2)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.array(m.astype(float)) for m in made)], [*own, *names[:3]])

    missing = [c for c in ("lang", "source") if c not in docs.columns]
    wide = docs.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else docs
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names[:3])])
    return wide.mapInArrow(common.freed(scan), schema).withColumn(names[3], F.col(names[2]) >= keep)


NAMES = ["quality_text", "quality_meta", "quality_score", "quality_keep"]


def score(docs: DataFrame, model: tuple[Logistic, Logistic] | None, keep: float = KEEP) -> DataFrame:
    """All columns of docs with NAMES."""
    return scored(docs.drop(*NAMES), model, NAMES, keep)


def kept_rows(docs: DataFrame, model: tuple[Logistic, Logistic] | None, keep: float = KEEP) -> DataFrame:
    """The rows of docs that aren't rejected, as they are."""
    names = NAMES
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    return scored(docs, model, names, keep).where(names[3]).select(*docs.columns)
