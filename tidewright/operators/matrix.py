"""Matrices in square blocks: rows of i, j (a block's row and column) and values (its SIZE x SIZE numbers, row by row; beyond the matrix's edge they are 0).

A product joins blocks on the inner index. Each task adds up what it has of a block of the result, and the numbers of these sums are added by Spark, partly before they are shuffled: no
task holds a whole matrix, nor all products of one block. Blocks of zeros need not be there. Null values count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.numeric import bound

SIZE = 64
BLOCKS = "i long, j long, values array<double>"
#: Blocks of the result that a task holds before it passes on what it has.
HELD = 256


def blocked(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of a matrix given by rows (row: from 0, values: array). Each row number may occur once."""
    n = F.ceil(F.size("values") / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(j.cast("long").alias("j"), F.slice("values", j * size + 1, size).alias("part")))
    cut = rows.where(F.size("values") > 0).select(F.floor(F.col("row") / size).cast("long").alias("i"), F.pmod("row", F.lit(size)).alias("at"), F.explode(parts).alias("p"))
    held = cut.groupBy("i", F.col("p.j").alias("j")).agg(F.map_from_entries(F.collect_list(F.struct("at", "p.part"))).alias("m"))  # size rows at most
    inside = F.sequence(F.lit(0), F.lit(size - 1))
    full = lambda part: F.transform(inside, lambda c: F.coalesce(F.get(part, c), F.lit(0.0)))
    filled = bound(F.col("m"), lambda m: F.flatten(F.transform(inside, lambda k: bound(F.element_at(m, k.cast("long")), full))))
    return held.select("i", "j", filled.alias("values"))


def transposed(a: DataFrame, size: int = SIZE) -> DataFrame:
    inside = F.sequence(F.lit(0), F.lit(size * size - 1))
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), bound(F.col("values"), lambda v: F.transform(inside, lambda k: F.get(v, (k % size) * size + F.floor(k / size).cast("int")))).alias("values"))


def product(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of a b."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            cells = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(cells, ["i", "j", "values"])

        for batch in batches:
            left, right = (batch.column(c).flatten().to_numpy().reshape(-1, size, size) for c in ("x", "y"))
            for i, j, x, y in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), left, right, strict=True):
                held[i, j] = held.get((i, j), 0.0) + x @ y
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    pairs = a.select("i", F.col("j").alias("k"), F.col("values").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("values").alias("y")), "k")
    each = pairs.select("i", "j", "x", "y").mapInArrow(multiply, BLOCKS).select("i", "j", F.posexplode("values").alias("at", "v"))
    sums = each.groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    return sums.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("values"))  # size x size numbers


def cells(a: DataFrame, size: int = SIZE) -> DataFrame:
    """r, c, v of a matrix's numbers, the zeros beyond its edge included."""
    each = a.select("i", "j", F.posexplode("values").alias("at", "v"))
    return each.select((F.col("i") * size + F.floor(F.col("at") / size)).alias("r"), (F.col("j") * size + F.col("at") % size).alias("c"), "v")


def shares(gram: np.ndarray, total: np.ndarray, n: int) -> list[tuple[int, float, float]]:
    """k (from 1), share and running share of variance of principal components, from X'X, the columns' sums and the number of rows."""
    covariance = (gram - np.outer(total, total) / n) / max(n - 1, 1)
    values = np.maximum(np.linalg.eigvalsh(covariance)[::-1], 0.0)
    part = values / values.sum() if values.sum() else values
    return [(k + 1, float(p), float(r)) for k, (p, r) in enumerate(zip(part, np.cumsum(part), strict=True))]
