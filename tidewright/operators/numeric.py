"""Kernels of numeric learning as column expressions over arrays and structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * (F.exp(x) - 1))


def gradients(x: Column) -> dict[str, Column]:
    s, t = sigmoid(x), F.tanh(x)
    return {"sigmoid": s * (1 - s), "relu": (x > 0).cast("double"), "elu": F.when(x > 0, 1.0).otherwise(F.exp(x)), "tanh": 1 - t * t}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is computed once for each row, however often f names it, also within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(a: Column) -> Column:
    """With the greatest value taken off first."""
    e = bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return bound(e, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: x / t)))


def nll(a: Column, label: Column) -> Column:
    """-ln softmax(a)[label], by the log of the sum of exponentials."""
    return bound(F.array_max(a), lambda top: F.log(total(F.transform(a, lambda x: F.exp(x - top)))) + top - F.get(a, label))


def nll_gradient(a: Column, label: Column) -> Column:
    return F.transform(softmax(a), lambda p, i: p - F.when(i == label, 1.0).otherwise(0.0))


def bce(p: Column, y: Column) -> Column:
    return F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))


def argmax(a: Column) -> Column:
    """The first place of the greatest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("int"))


def layer_norm(a: Column, eps: float = 1e-6) -> Column:
    def spread(mean: Column) -> Column:
        return F.sqrt(total(F.transform(a, lambda x: (x - mean) * (x - mean))) / (F.size(a) - 1))

    return bound(total(a) / F.size(a), lambda mean: bound(spread(mean), lambda s: F.transform(a, lambda x: (x - mean) / (s + eps))))


def padded(a: Column, n: Column, value) -> Column:
    return F.concat(a, F.array_repeat(value, (n - F.size(a)).cast("int")))


def clipped(x: Column, limit: float) -> Column:
    return F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))


def dense(long: DataFrame, weights: DataFrame, bias: DataFrame, key: str) -> DataFrame:
    """X W + b of long tables: long (key, i, x), weights (i, o, w), bias (o, b). The layer is small and goes to every task."""
    out = long.join(F.broadcast(weights), "i").groupBy(key, "o").agg(F.sum(F.col("x") * F.col("w")).alias("s"))
    return out.join(F.broadcast(bias), "o").select(key, "o", (F.col("s") + F.col("b")).alias("y"))


def numeric_gradient(f: Callable[[Column], Column], x: Column, eps: float = 1e-6) -> Column:
    return (f(x + eps) - f(x - eps)) / (2 * eps)


#: Objectives of two variables with their gradients.
OBJECTIVES: dict[str, tuple[Callable, Callable]] = {
    "bowl": (lambda x, y: x * x + y * y, lambda x: 2 * x),
    "waves": (lambda x, y: x * x * F.sin(x) + y * y * F.sin(y), lambda x: 2 * x * F.sin(x) + x * x * F.cos(x)),
    "ripples": (lambda x, y: x * x * F.sin(x * x) + y * y * F.sin(y * y), lambda x: 2 * x * F.sin(x * x) + 2 * x * x * x * F.cos(x * x)),
}
START = (1.0, 2.0)
RATES = {"gd": 0.1, "momentum": 0.02, "nag": 0.02, "adagrad": 0.5, "adadelta": 1.0, "adam": 0.1}


def descend(method: str, gradient: Callable[[Column], Column], steps: Column, start: float, rate: float) -> Column:
    """Points of one coordinate (all these objectives are sums over coordinates) before each step: an array."""
    eps = 1e-8

    def step(s: Column, t: Column) -> Column:
        x, m, v = s["x"], s["m"], s["v"]
        if method == "nag":
            m2 = 0.9 * m + rate * gradient(x - 0.9 * m)
            new, v2 = x - m2, v
        else:
            g = gradient(x)
            if method == "gd":
                new, m2, v2 = x - rate * g, m, v
            elif method == "momentum":
                m2 = 0.9 * m + rate * g
                new, v2 = x - m2, v
            elif method == "adagrad":
                v2 = v + g * g
                new, m2 = x - rate * g / F.sqrt(v2 + eps), m
            elif method == "adadelta":
                v2 = 0.9 * v + 0.1 * g * g
                d = F.sqrt(m + 1e-6) / F.sqrt(v2 + 1e-6) * g
                new, m2 = x - rate * d, 0.9 * m + 0.1 * d * d
            else:
                m2, v2 = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                new = x - rate * (m2 / (1 - F.pow(F.lit(0.9), t))) / (F.sqrt(v2 / (1 - F.pow(F.lit(0.999), t))) + eps)
        return F.struct(new.alias("x"), m2.alias("m"), v2.alias("v"), F.concat(s["path"], F.array(x)).alias("path"))

    zero = F.struct(F.lit(start).alias("x"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("path"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda i: i.cast("double")), zero, step)["path"]


def trajectory(spark, objective: str, method: str, steps: int) -> DataFrame:
    """objective, method, step, x, y, loss of each point before its step."""
    f, g = OBJECTIVES[objective]
    paths = [descend(method, g, F.lit(steps), s, RATES[method]).alias(n) for n, s in zip("xy", START, strict=True)]
    rows = spark.range(1).select(*paths).select(F.posexplode(F.arrays_zip("x", "y")).alias("step", "p"))
    return rows.select(F.lit(objective).alias("objective"), F.lit(method).alias("method"), "step", F.col("p.x").alias("x"), F.col("p.y").alias("y")).withColumn("loss", f(F.col("x"), F.col("y")))


def components(df: DataFrame, column: str, k: int):
    """Principal components of arrays: df with pca, the fitted model, and the means taken off the input first."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows)
    centred = scaler.transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn("pca", vector_to_array("_p")).drop("_v", "_c", "_p"), model, scaler.mean.toArray()


def principal(df: DataFrame, column: str, k: int):
    """df with pca, and the share of variance of each component."""
    out, model, _ = components(df, column, k)
    return out, model.explainedVariance.toArray()


def restored(df: DataFrame, column: str, k: int):
    """df with restored, the arrays that k components give back, and error, their mean square distance; and the share of variance of each component."""
    out, model, mean = components(df, column, k)
    place = F.array(*(F.array(*map(F.lit, row)) for row in model.pc.toArray().tolist()))
    back = F.zip_with(place, F.array(*map(F.lit, mean.tolist())), lambda row, m: dot(row, F.col("pca")) + m)
    out = out.withColumn("restored", back)
    return out.withColumn("error", total(F.zip_with("restored", column, lambda a, b: (a - b) * (a - b))) / F.size(column)), model.explainedVariance.toArray()
