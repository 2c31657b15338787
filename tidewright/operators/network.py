"""Layers over long tables: an input or gradient is (key, i, x), weights are (i, o, w) and (o, b). Layers are small and go to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import numeric as N


class Dense:
    """y = X W + b. Backward keeps the gradients of weights (sums over all keys) and returns that of X; step() takes them off the weights."""

    def __init__(self, weights: DataFrame, bias: DataFrame):
        self.weights, self.bias = weights, bias

    def forward(self, x: DataFrame) -> DataFrame:
        self.x = x
        return N.dense(x, self.weights, self.bias, "key").select("key", F.col("o").alias("i"), F.col("y").alias("x"))

    def backward(self, dy: DataFrame) -> DataFrame:
        d = dy.select("key", F.col("i").alias("o"), F.col("x").alias("d"))
        self.d_weights = self.x.join(d, "key").groupBy("i", "o").agg(F.sum(F.col("x") * F.col("d")).alias("d"))
        self.d_bias = d.groupBy("o").agg(F.sum("d").alias("d"))
        return d.join(F.broadcast(self.weights), "o").groupBy("key", "i").agg(F.sum(F.col("d") * F.col("w")).alias("x"))

    def step(self, rate: float) -> None:
        less = lambda column: (F.col(column) - rate * F.coalesce("d", F.lit(0.0))).alias(column)
        self.weights = self.weights.join(self.d_weights, ["i", "o"], "left").select("i", "o", less("w"))
        self.bias = self.bias.join(self.d_bias, "o", "left").select("o", less("b"))


class Activation:
    """One of the functions of numeric.gradients() on every value."""

    OF = {"sigmoid": N.sigmoid, "relu": N.relu, "elu": N.elu, "tanh": F.tanh}

    def __init__(self, name: str):
        self.name = name

    def forward(self, x: DataFrame) -> DataFrame:
        self.x = x
        return x.withColumn("x", self.OF[self.name](F.col("x")))

    def backward(self, dy: DataFrame) -> DataFrame:
        slope = self.x.select("key", "i", N.gradients(F.col("x"))[self.name].alias("slope"))
        return dy.join(slope, ["key", "i"]).select("key", "i", (F.col("x") * F.col("slope")).alias("x"))

    def step(self, rate: float) -> None:
        pass


class Chain:
    """Layers in order, and backward in reverse."""

    def __init__(self, *layers):
        self.layers = layers

    def forward(self, x: DataFrame) -> DataFrame:
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def backward(self, dy: DataFrame) -> DataFrame:
        for layer in reversed(self.layers):
            dy = layer.backward(dy)
        return dy

    def step(self, rate: float) -> None:
        for layer in self.layers:
            layer.step(rate)


def mean_square(y: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The loss (one row) and its gradient by y. target: (key, i, t)."""
    both = y.join(target, ["key", "i"]).withColumn("e", F.col("x") - F.col("t"))
    n = both.agg(F.count("*").alias("n"))
    return both.agg(F.avg(F.col("e") * F.col("e")).alias("loss")), both.crossJoin(F.broadcast(n)).select("key", "i", (2 * F.col("e") / F.col("n")).alias("x"))  # n is one row
