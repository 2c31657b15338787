"""Ordered series (key..., t, v). A series is one partition of a window; there are many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: list[str], by: list[str] | None = None):
    return Window.partitionBy(*key).orderBy(*(by or ["t"]))


def upto(key: list[str]):
    return ordered(key).rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    return df.withColumn("t", (F.row_number().over(ordered(key, by)) - 1).cast("long"))


def moving_average(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """Trailing means of n values; the first n - 1 places have none."""
    return df.withColumn("mean", F.avg("v").over(ordered(key).rowsBetween(1 - n, 0))).where(F.col("t") >= n - 1)


def windows(df: DataFrame, key: list[str], back: int, forward: int) -> DataFrame:
    """x: back values from t on; y: the same window forward places later; len - back - 1 - forward samples a series."""
    w = ordered(key)
    n = F.count("*").over(Window.partitionBy(*key))
    rows = df.withColumns({"x": F.collect_list("v").over(w.rowsBetween(0, back - 1)), "y": F.collect_list("v").over(w.rowsBetween(forward, forward + back - 1)), "_n": n})
    return rows.where(F.col("t") < F.col("_n") - back - 1 - forward).drop("_n")


def convolved(df: DataFrame, key: list[str], kernel: list[float]) -> DataFrame:
    """Convolution where the kernel lies wholly inside; the kernel is flipped."""
    w = ordered(key)
    total = sum((F.lit(k) * (F.lag("v", j).over(w) if j else F.col("v")) for j, k in enumerate(kernel)), F.lit(0.0))
    return df.withColumn("c", total).where(F.col("t") >= len(kernel) - 1)


def box(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """Means over size places around each; places outside count as 0."""
    half = size // 2
    return df.withColumn("smooth", F.sum("v").over(ordered(key).rowsBetween(-half, half)) / size)


def box_sweep(df: DataFrame, key: list[str], sizes, block: int = 1 << 16) -> DataFrame:
    """Mean square difference between smoothed and own values, for each (odd) size. Series are cut into blocks of places, each with what the widest box needs on both sides, so that a long series is
    many tasks' work too; each task gives one sum a size. Keys are told apart by 64 bits of a hash."""
    sizes, widest = list(sizes), max(sizes) // 2
    wide = max(block, widest)
    place = F.floor(F.col("t") / wide)
    near = F.array(F.struct(place.alias("block"), F.lit(True).alias("own")), *(F.struct((place + by).alias("block"), F.lit(False).alias("own")) for by in (-1, 1)))
    within = lambda x: x["own"] | ((F.col("t") < (x["block"] + 1) * wide + widest) & (F.col("t") >= x["block"] * wide - widest))
    rows = df.select(*key, "t", F.col("v").cast("double").alias("v"), F.explode(F.filter(near, within)).alias("x")).select(*key, "t", "v", "x.block", "x.own")

    half, width = np.array(sizes) // 2, np.array(sizes, float)

    def add(frame: pd.DataFrame, s: np.ndarray) -> int:
        g, t, mine, v = (frame[c].to_numpy() for c in ("g", "t", "mine", "v"))
        first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (frame["block"].to_numpy()[1:] != frame["block"].to_numpy()[:-1])))
        last = np.append(first[1:], len(g)) - 1
        room = t[last] - t[first] + widest + 1  # zeros, as places outside a series are, keep neighbours apart
        at = t - np.repeat(t[first] - (np.cumsum(room) - room) - widest - 1, last - first + 1)
        filled = np.zeros(int(room.sum()) + 2 * widest + 2)
        filled[at] = v
        upto, i, x = np.cumsum(filled), at[mine], v[mine]
        for k in range(0, len(i), 1024):
            j = i[k : k + 1024, None]
            s += np.square((upto[j + half] - upto[j - half - 1]) / width - x[k : k + 1024, None]).sum(axis=0)
        return len(i)

    def swept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n, rest = np.zeros(len(sizes)), 0, None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            open_ = (frame["g"] == frame["g"].iloc[-1]) & (frame["block"] == frame["block"].iloc[-1]) if len(frame) else np.zeros(0, bool)
            whole, rest = frame[~open_], frame[open_]  # the last block may go on
            n += add(whole, s) if len(whole) else 0
        n += add(rest, s) if rest is not None and len(rest) else 0
        yield pd.DataFrame({"size": sizes, "n": n, "s": s})

    known = rows.where("v is not null").select(F.xxhash64(*key).alias("g"), "block", "t", "v", F.col("own").alias("mine"), *(F.col(k).alias(f"_{k}") for k in key))  # a null adds nothing to its neighbours
    dealt = known.repartition("g", "block").sortWithinPartitions("g", *(f"_{k}" for k in key), "block", "t").select("g", "block", "t", "v", "mine")
    sums = dealt.mapInPandas(swept, "size long, n long, s double")
    return sums.groupBy("size").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mse"))


def with_ends(df: DataFrame, column: str) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))))  # one row


def scaled(df: DataFrame, column: str) -> DataFrame:
    """All values to [0, 1]."""
    return with_ends(df, column).withColumn("scaled", (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")))


def framed(df: DataFrame, column: str, frame: int, margin: int) -> DataFrame:
    """Whole places in a frame."""
    return with_ends(df, column).withColumn("x", F.floor((F.col(column) - F.col("lo")) * (frame / (F.col("hi") - F.col("lo"))) + margin).cast("long"))


def prefix_split(df: DataFrame, key: list[str], share: float) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("part", F.when(F.col("t") < F.floor(F.lit(share) * n), "train").otherwise("test"))


def roll_out(df: DataFrame, key: list[str], weights: list[float], steps: int) -> DataFrame:
    """key, step, v: values predicted one after another by a linear model, each fed back. Only each series' last values travel."""
    back = len(weights)
    n = F.count("*").over(Window.partitionBy(*key))
    tail = df.withColumn("_n", n).where(F.col("t") >= F.col("_n") - back).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).getField("v").alias("seen")).where(F.size("seen") == back)
    w = F.array(*map(F.lit, weights))

    def one(state, _):
        last = F.slice(state, -back, back)
        return F.concat(state, F.array(F.aggregate(F.zip_with(last, w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))

    every = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("seen"), one)
    return tail.select(*key, F.posexplode(F.slice(every, back + 1, steps)).alias("step", "v"))


def sessions(df: DataFrame, key: list[str], by: list[str], time: str, gap: int) -> DataFrame:
    """session: numbers runs whose steps are at most gap."""
    w = ordered(key, by)
    opens = F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap)
    return df.withColumn("_opens", opens.cast("long")).withColumn("session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def lstm(df: DataFrame, key: list[str], weights: dict) -> DataFrame:
    """key, h: the last hidden states of an LSTM cell (gates in the order input, forget, cell, output) over each series' values. weights: w (4h), u (h x 4h), b (4h) as lists."""
    import numpy as np

    w, u, b = (np.array(weights[k], float) for k in "wub")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = len(b) // 4
        h, c = np.zeros(n), np.zeros(n)
        for v in frame.sort_values("t")["v"]:
            i, f, g, o = np.split(v * w + h @ u + b, 4)
            c = c / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
            h = np.tanh(c) / (1 + np.exp(-o))
        return pd.DataFrame([[*frame[key].iloc[0], h.tolist()]], columns=[*key, "h"])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in key), "h array<double>"])
    return df.groupBy(*key).applyInPandas(run, schema)
