"""Gradient-boosted trees by histograms, trained by tasks that run together.

Each task holds a share of the training rows, TASK_ROWS of them while there are tasks enough, as the bins of their features, a byte each. A level of a tree needs the sums of gradients and hessians by node, feature and bin; tasks
exchange theirs by allGather and add them in the tasks' order, so all come to the same sums and the same splits, and no row moves. The whole ensemble is one
barrier stage: should a task be lost, the stage begins anew and gives the same trees. An exchange takes about a second whatever its size, and each tree needs `depth` of them, which is more than what
4 million rows take one task; so by default one task trains. A feature that has one bin in a task is not summed by bin there.

Training takes all rows, unless the caller gives `most_rows`, and then those of the least hash. The tasks must hold them: some 130 bytes a row and one for each feature. Bins are
exact quantiles of all of them. Scoring is a plain map over any number of rows. The model is a table (tree, node, feature, threshold, value): node n has children 2n + 1 (feature < threshold) and 2n + 2; a leaf has no feature.

Loss is logistic; a leaf is -rate * G / (H + l2); a split needs a positive gain and `least_weight` hessian on both sides; the first feature and bin win ties. Null or NaN features
count as 0, and so do those that a shorter array lacks; null labels are left out. Without rows of training the model is one empty leaf, and scores are 0.5.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.control import saved

MODEL = "tree int, node int, feature int, threshold double, value double"
#: Rows of training for a task of it.
TASK_ROWS = 4_000_000


def clean(column: str = "features"):
    return F.transform(column, lambda x: F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0))))


def filled(column, n: int):
    """n features, 0 where there are fewer."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.get(column, k), F.lit(0.0)))


def tasks_of(n: int, slots: int) -> int:
    """How many tasks train n rows."""
    return max(1, min(slots, -(-n // TASK_ROWS)))


def quantiles(rows: DataFrame, n_features: int, shares: list[float]) -> list[list[float]]:
    """Of each feature those at the shares, interpolated as percentile() does; none of a feature without values. Values are counted, then sorted over all tasks, so that none holds all of a feature's."""
    each = rows.select(F.posexplode("features").alias("feature", "v")).where((F.col("feature") < n_features) & F.col("v").isNotNull())
    counts = saved(each.groupBy("feature", "v").agg(F.count("*").alias("n")).repartitionByRange("feature", "v")).withColumn("part", F.spark_partition_id())
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_features)]
    for r in counts.groupBy("feature", "part").agg(F.sum("n").alias("n")).orderBy("feature", "part").collect():  # rows for each feature and part at most
        held[r.feature].append((r.part, r.n))
    totals = [sum(n for _, n in parts) for parts in held]
    places = [sorted({p for s in shares for p in (int(np.floor(s * (n - 1))), int(np.ceil(s * (n - 1))))}) if n else [] for n in totals]
    wanted = []
    for feature, parts in enumerate(held):
        ends = np.cumsum([n for _, n in parts])
        for place in places[feature]:
            k = int(np.searchsorted(ends, place, "right"))
            wanted.append((feature, parts[k][0], place, place - int(ends[k] - parts[k][1])))
    if not wanted:
        return [[] for _ in held]
    asked = F.broadcast(rows.sparkSession.createDataFrame(wanted, "feature int, part int, place long, at long"))  # two for each feature and share
    run = counts.withColumn("high", F.sum("n").over(Window.partitionBy("feature", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("at") < F.col("high")) & (F.col("at") >= F.col("high") - F.col("n"))
    found = {(r.feature, r.place): r.v for r in run.join(asked, ["feature", "part"]).where(inside).select("feature", "place", "v").collect()}

    def between(feature: int, at: float) -> float:
        low, high = int(np.floor(at)), int(np.ceil(at))
        a, b = found[feature, low], found[feature, high]
        return a if a == b else (high - at) * a + (at - low) * b

    return [[between(k, s * (n - 1)) for s in shares] if n else [] for k, n in enumerate(totals)]


def bin_edges(rows: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Thresholds between bins of each feature: exact quantiles, each once; below the first is bin 0."""
    return [np.unique(np.array(q, np.float64)) for q in quantiles(rows, n_features, [k / bins for k in range(1, bins)])]


def best_splits(g: np.ndarray, h: np.ndarray, l2: float, least_weight: float) -> list[tuple[int, int] | None]:
    """For sums by (node, feature, bin): the feature and the last bin on the left of each node's best split."""
    left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
    all_g, all_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain = np.where((left_h >= least_weight) & (right_h >= least_weight), gain, -1.0)
    flat = gain.reshape(len(g), -1)
    at = flat.argmax(axis=1)
    return [divmod(int(k), gain.shape[2]) if flat[n, k] > 1e-9 else None for n, k in enumerate(at)]


def train(rows: DataFrame, trees: int = 1000, depth: int = 3, rate: float = 0.1, bins: int = 32, l2: float = 1.0, least_weight: float = 1.0, most_rows: int | None = None) -> DataFrame:
    """rows (key, features: array<double>, label: 0 or 1) to the model's table. Runs a job."""
    spark = rows.sparkSession
    known = rows.where("label is not null and features is not null").select("key", clean().alias("features"), F.col("label").cast("int").alias("label"))
    n = known.count()
    if most_rows is not None and n > most_rows:
        cut = known.select(F.percentile(F.xxhash64("key"), most_rows / n)).first()[0]
        known = known.where(F.xxhash64("key") <= cut)
        n = most_rows
    if not n:
        return spark.createDataFrame([(0, 0, None, None, 0.0)], MODEL)
    n_features = max(1, known.agg(F.max(F.size("features"))).first()[0])
    known = known.withColumn("features", filled("features", n_features))
    edges = bin_edges(known, n_features, bins)
    tasks = tasks_of(n, spark.sparkContext.defaultParallelism)
    width = max(map(len, edges), default=0) + 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        x, y = [np.empty((0, n_features), np.uint8)], [np.empty(0)]
        for b in batches:
            values = b.column("features").flatten().to_numpy().reshape(-1, n_features)
            x.append(np.stack([np.searchsorted(e, values[:, k], "right") for k, e in enumerate(edges)], axis=1).astype(np.uint8))
            y.append(b.column("label").to_numpy().astype(np.float64))
        y, flat = np.concatenate(y), np.ravel(np.concatenate(x), "F")  # one feature after another
        x = flat.reshape(n_features, -1)
        margin, every, cells = np.zeros(len(y)), np.arange(len(y)), np.empty(len(y), np.intp)
        alone = [int(c[0]) if len(c) and (c == c[0]).all() else None for c in x]  # the only bin of a feature that has one here
        columns = [c if k is None else None for c, k in zip(x, alone, strict=True)]
        out = []

        def summed(own: np.ndarray) -> np.ndarray:
            if tasks == 1:
                return own
            parts = context.allGather(base64.b64encode(own.tobytes()).decode())
            return sum((np.frombuffer(base64.b64decode(p)) for p in parts), np.zeros(own.size)).reshape(own.shape)

        for tree in range(trees):
            p = 1 / (1 + np.exp(-margin))
            weights = (p - y, p * (1 - p))
            at = np.zeros(len(y), np.intp)  # a row's node
            nodes, gone = [0], np.zeros(2 ** (depth + 1) - 1)  # what a node gives, if it is a leaf
            for level in range(depth):
                n_cells = len(nodes) * width
                rank = np.full(len(gone), len(nodes))  # rows in leaves go to cells behind the others
                rank[nodes] = np.arange(len(nodes))
                ranked = rank[at]
                first = ranked * width
                totals_here = [np.bincount(ranked, w, len(nodes) + 1)[:-1] for w in weights]
                own = np.zeros((2, len(nodes), n_features, width))
                for f, column in enumerate(columns):
                    if column is None:
                        own[:, :, f, alone[f]] = totals_here
                        continue
                    np.add(first, column, out=cells)
                    for k, w in enumerate(weights):
                        own[k, :, f] = np.bincount(cells, w, n_cells + width)[:n_cells].reshape(-1, width)
                g, h = summed(own)
                below, totals = [], {}
                by, last, to = np.zeros(len(gone), np.intp), np.zeros(len(gone), np.intp), np.repeat(np.arange(len(gone)), 2)
                for k, (node, split) in enumerate(zip(nodes, best_splits(g, h, l2, least_weight), strict=True)):
                    if split is None:
                        gone[node] = -rate * float(g[k, 0].sum()) / (float(h[k, 0].sum()) + l2)
                        out.append((tree, node, None, None, float(gone[node])))
                        continue
                    f, b = split
                    out.append((tree, node, f, float(edges[f][b]), None))
                    by[node], last[node], to[2 * node : 2 * node + 2] = f * len(y), b, (2 * node + 1, 2 * node + 2)
                    for child, part in ((2 * node + 1, slice(None, b + 1)), (2 * node + 2, slice(b + 1, None))):
                        below.append(child)
                        totals[child] = float(g[k, f, part].sum()), float(h[k, f, part].sum())
                at = to[2 * at + (flat[by[at] + every] > last[at])]
                nodes = below
                if not nodes:
                    break
            for node in nodes:
                gone[node] = -rate * totals[node][0] / (totals[node][1] + l2)
                out.append((tree, node, None, None, float(gone[node])))
            margin += gone[at]
        if context.partitionId() == 0:
            columns = list(zip(*out, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["tree", "node", "feature", "threshold", "value"])

    found = known.select("features", "label").repartition(tasks).mapInArrow(fit, MODEL, barrier=True).toArrow()  # (2^(depth + 1) - 1) rows a tree, at most
    return spark.createDataFrame(found)


def scored(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (with features) with score, the chance of label 1, and prediction, 1 where it is above a half. The model goes to every task: its size is given by trees and depth."""
    table = model.orderBy("tree", "node").toPandas()
    n_trees, n_nodes = (int(table["tree"].max()) + 1, int(table["node"].max()) + 1) if len(table) else (0, 1)
    feature, threshold, value = np.full((n_trees, n_nodes), -1), np.zeros((n_trees, n_nodes)), np.zeros((n_trees, n_nodes))
    at = table["tree"].to_numpy(np.int64), table["node"].to_numpy(np.int64)
    feature[at], threshold[at], value[at] = table["feature"].fillna(-1).to_numpy(np.int64), table["threshold"].fillna(0.0).to_numpy(), table["value"].fillna(0.0).to_numpy()
    turns = int(np.log2(n_nodes + 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_clean")
            x = np.zeros((batch.num_rows, int(feature.max(initial=-1)) + 1))
            for k in range(x.shape[1]):
                x[:, k] = pc.list_element(lists, k).to_numpy(zero_copy_only=False)
            margin, rows_at = np.zeros(batch.num_rows), np.arange(batch.num_rows)
            for t in range(n_trees):
                node = np.zeros(batch.num_rows, np.int64)
                for _ in range(turns - 1):
                    f = feature[t, node]
                    node = np.where(f < 0, node, 2 * node + 1 + (x[rows_at, f] >= threshold[t, node]))
                margin += value[t, node]
            score = 1 / (1 + np.exp(-margin))
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score > 0.5).astype(np.int32))], [*batch.schema.names[:-1], "score", "prediction"])

    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("prediction", T.IntegerType())])
    return rows.withColumn("_clean", filled(clean(), max(1, int(feature.max(initial=-1)) + 1))).mapInArrow(scan, schema)
