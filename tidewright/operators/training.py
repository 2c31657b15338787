"""Training of small dense networks over any number of rows, data-parallel.

Rows are dealt once, by a hash of their key, into `steps` mini-batches, which lie in folders of their own. A step is one job over its batch: tasks add up gradients over the rows
they read, sums meet in a tree of FAN tasks each, and the driver takes the step and sends the new weights with the next. What is sent and collected is as large as the
networks, whatever the rows; several networks are trained in one pass over a batch. An epoch goes over all batches, in an order of its own.

A network is a list of layers: ("dense", outputs), and "sigmoid", "tanh", "relu" or "elu" between them; the last outputs go through a softmax, and the loss is the negative
logarithm of the label's share. Its weights are a list of arrays, a matrix and a bias for each dense layer.

Rows whose vector or label is null, or whose vector has another length than the first network takes, or a null or no finite number in it, are left out. Empty batches make no step. Equal keys share a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.control import shared_folder

Layers = list
Weights = list[np.ndarray]
FAN = 64
SUMS = "part long, v array<double>"
#: Value and slope (of the input x and the value) of each activation.
ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "sigmoid": (lambda x: 0.5 * (1 + np.tanh(x / 2)), lambda x, v: v * (1 - v)),
    "tanh": (np.tanh, lambda x, v: 1 - v * v),
    "relu": (lambda x: np.maximum(x, 0.0), lambda x, v: (x > 0) * 1.0),
    "elu": (lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0.0))), lambda x, v: np.where(x > 0, 1.0, v + 1)),
}


def started(layers: Layers, size: int, seed: int) -> Weights:
    """Normal weights: of variance 2 / inputs before a relu or elu, of 2 / (inputs + outputs) elsewhere; biases are 0."""
    rng, out = np.random.default_rng(seed), []
    for k, layer in enumerate(layers):
        if layer[0] == "dense":
            rectified = layers[k + 1 : k + 2] in (["relu"], ["elu"])
            out += [rng.normal(size=(size, layer[1])) * np.sqrt(2 / size if rectified else 2 / (size + layer[1])), np.zeros(layer[1])]
            size = layer[1]
    return out


def outputs(layers: Layers, weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """The input and what each layer makes of it."""
    own, out = iter(weights), [x]
    for layer in layers:
        out.append(ACTIVATIONS[layer][0](out[-1]) if isinstance(layer, str) else out[-1] @ next(own) + next(own))
    return out


def priced(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's loss, and the shares that the softmax gives."""
    shifted = scores - scores.max(axis=1, keepdims=True)
    total = np.exp(shifted).sum(axis=1)
    return np.log(total) - shifted[np.arange(len(y)), y], np.exp(shifted) / total[:, None]


def gradients(layers: Layers, weights: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, int, Weights]:
    """Sums over rows: the loss, how many are right, and the slopes of the loss by each weight."""
    values = outputs(layers, weights, x)
    loss, share = priced(values[-1], y)
    share[np.arange(len(y)), y] -= 1
    back, slopes, at = share, [], len(weights)
    for k in range(len(layers) - 1, -1, -1):
        if isinstance(layers[k], str):
            back = back * ACTIVATIONS[layers[k]][1](values[k], values[k + 1])
        else:
            at -= 2
            slopes = [values[k].T @ back, back.sum(axis=0), *slopes]
            back = back @ weights[at].T
    return float(loss.sum()), int((values[-1].argmax(axis=1) == y).sum()), slopes


def rows_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column("x").flatten().to_numpy().reshape(-1, size), b.column("y").to_numpy()


def added(own: DataFrame) -> np.ndarray:
    """The sum of the vectors of own (part, v), added in the order of parts, FAN at a time in tasks."""
    n = own.rdd.getNumPartitions()

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"part": [table.column("part")[0].as_py() // FAN], "v": pa.array([total], pa.list_(pa.float64()))})

    while n > FAN:
        own = own.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(add, SUMS)
        n = -(-n // FAN)
    found = sorted(own.collect())
    return np.sum([r.v for r in found], axis=0) if found else np.zeros(0)


def totals(rows: DataFrame, nets: dict[str, Layers], weights: dict[str, Weights], size: int, slopes: bool) -> dict[str, tuple[int, float, int, Weights]]:
    """For each network: rows, sum of losses, how many are right, and the sums of slopes (none if not asked for). A job."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, y in rows_of(batches, size):
            each = []
            for name, layers in nets.items():
                if slopes:
                    loss, right, own = gradients(layers, weights[name], x, y)
                    each += [[len(y), loss, right], *(s.ravel() for s in own)]
                else:
                    scores = outputs(layers, weights[name], x)[-1]
                    each.append([len(y), priced(scores, y)[0].sum(), (scores.argmax(axis=1) == y).sum()])
            found = np.concatenate(each)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["part", "v"])

    v, at, out = added(rows.select("x", "y").mapInArrow(scan, SUMS)), 0, {}
    for name in nets:
        if not len(v):
            out[name] = (0, 0.0, 0, [np.zeros_like(w) for w in weights[name]])
            continue
        (n, loss, right), at, own = v[at : at + 3], at + 3, []
        for w in weights[name] if slopes else ():
            own.append(v[at : at + w.size].reshape(w.shape))
            at += w.size
        out[name] = (int(n), float(loss), int(right), own)
    return out


def gradient_step(weights: Weights, slopes: Weights, state: dict, rate: float, momentum: float = 0.9) -> Weights:
    """A step down the slopes with momentum."""
    state["v"] = [momentum * v + g for v, g in zip(state.get("v") or [0.0] * len(slopes), slopes, strict=True)]
    return [w - rate * v for w, v in zip(weights, state["v"], strict=True)]


def adam_step(weights: Weights, slopes: Weights, state: dict, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> Weights:
    """A step by the slopes' running means over the roots of their running squares."""
    state["t"] = t = state.get("t", 0) + 1
    none = [0.0] * len(slopes)
    state["m"] = [b1 * m + (1 - b1) * g for m, g in zip(state.get("m", none), slopes, strict=True)]
    state["s"] = [b2 * s + (1 - b2) * g * g for s, g in zip(state.get("s", none), slopes, strict=True)]
    return [w - rate * m / (1 - b1**t) / (np.sqrt(s / (1 - b2**t)) + eps) for w, m, s in zip(weights, state["m"], state["s"], strict=True)]


STEPS = {"momentum": gradient_step, "adam": adam_step}


def usable(rows: DataFrame, size: int, classes: int) -> DataFrame:
    x = F.col("x").cast("array<double>")
    return rows.select("key", x.alias("x"), F.col("y").cast("long").alias("y")).where((F.size("x") == size) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.col("y").between(0, classes - 1))


def train(rows: DataFrame, test: DataFrame, nets: dict[str, Layers], size: int, epochs: int, steps: int, rate: float, optimiser: str = "adam", seed: int = 0) -> tuple[dict[str, Weights], list[tuple]]:
    """Networks fitted to rows (key, x: array, y: class from 0), and their curves: net, epoch, means of the batches' mean losses and accuracies, and of the test rows' losses and accuracies."""
    spark = rows.sparkSession
    classes = {layers[-1][1] for layers in nets.values()}
    if len(classes) > 1:
        raise ValueError("the networks differ in how many classes they tell apart")
    place = shared_folder(spark, "training")
    step = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(steps)).cast("int")
    lots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // steps)
    known = usable(rows, size, *classes).withColumn("step", step).withColumn("lot", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(lots)))
    known.repartition(F.col("step"), F.col("lot")).select("x", "y", "step").write.partitionBy("step").parquet(f"{place}/rows")
    usable(test, size, *classes).select("x", "y").write.parquet(f"{place}/test")
    dealt = spark.read.schema("x array<double>, y long, step int").parquet(f"{place}/rows")
    unseen = spark.read.schema("x array<double>, y long").parquet(f"{place}/test")
    weights = {name: started(layers, size, seed) for name, layers in nets.items()}
    state: dict[str, dict] = {name: {} for name in nets}
    curves = []
    for epoch in range(1, epochs + 1):
        met: dict[str, list] = {name: [] for name in nets}
        for k in np.random.default_rng([seed, epoch]).permutation(steps).tolist():
            for name, (n, loss, right, slopes) in totals(dealt.where(F.col("step") == k), nets, weights, size, True).items():
                if n:
                    met[name].append((loss / n, right / n))
                    weights[name] = STEPS[optimiser](weights[name], [s / n for s in slopes], state[name], rate)
        for name, (n, loss, right, _) in totals(unseen, nets, weights, size, False).items():
            mean = np.mean(met[name], axis=0) if met[name] else (float("nan"),) * 2
            curves.append((name, epoch, float(mean[0]), float(mean[1]), loss / n if n else float("nan"), right / n if n else float("nan")))
    return weights, curves


def predicted(rows: DataFrame, layers: Layers, weights: Weights, size: int) -> DataFrame:
    """key, y, predicted class and its share for rows (key, x, y)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(-1, size)
                share = priced(outputs(layers, weights, x)[-1], np.zeros(len(x), np.int64))[1]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), pa.array(share.argmax(axis=1).astype(np.int32)), pa.array(share.max(axis=1))], ["key", "y", "predicted", "share"])

    return usable(rows, size, layers[-1][1]).mapInArrow(scan, "key long, y long, predicted int, share double")
