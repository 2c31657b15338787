"""Images as arrays of rows of pixels, or long tables (key, y, x, v)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels(df: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """key, y, x, v of flat arrays."""
    p = df.select(key, F.posexplode(column).alias("i", "v"))
    return p.select(key, F.floor(F.col("i") / width).alias("y"), F.pmod("i", F.lit(width)).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def spread(long: DataFrame, key: str, offsets: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel's weighted value at each place whose neighbourhood holds it: a map, then one sum for each place. offsets: (dy, dx, w...)."""
    moved = long.crossJoin(F.broadcast(offsets)).withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")})  # a kernel is a few rows
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


SOBEL_X = [(-1, -1, 1.0), (-1, 1, -1.0), (0, -1, 2.0), (0, 1, -2.0), (1, -1, 1.0), (1, 1, -1.0)]


def sobel(long: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """key, y, x, g: the size of the gradient, with zeros outside."""
    spark = long.sparkSession
    both = {}
    for dy, dx, w in SOBEL_X:
        both.setdefault((dy, dx), [0.0, 0.0])[0] += w
        both.setdefault((dx, dy), [0.0, 0.0])[1] += w
    kernel = spark.createDataFrame([(dy, dx, *w) for (dy, dx), w in sorted(both.items())], "dy long, dx long, wx double, wy double")
    g = spread(long, key, kernel, height, width).groupBy(key, "y", "x").agg(F.sum(F.col("v") * F.col("wx")).alias("gx"), F.sum(F.col("v") * F.col("wy")).alias("gy"))
    return g.select(key, "y", "x", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("g"))


def filter_bank(long: DataFrame, key: str, bank: list[tuple[int, int, int, int, float]], height: int, width: int) -> DataFrame:
    """long (key, y, x, c, v) under kernels (dy, dx, c in, c out, w): key, y, x, c, v."""
    kernel = long.sparkSession.createDataFrame(bank, "dy long, dx long, c long, o long, w double")
    moved = long.join(F.broadcast(kernel), "c").withColumns({"y": F.col("y") + F.col("dy"), "x": F.col("x") + F.col("dx")})
    inside = moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    return inside.groupBy(key, "y", "x", F.col("o").alias("c")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def pooled(long: DataFrame, key: str, size: int, height: int, width: int, how: Column) -> DataFrame:
    """key, y, x and how over whole tiles; partial tiles are dropped."""
    inside = long.where((F.col("y") < height // size * size) & (F.col("x") < width // size * size))
    return inside.groupBy(key, F.floor(F.col("y") / size).alias("y"), F.floor(F.col("x") / size).alias("x")).agg(how)


def grey(r: Column, g: Column, b: Column) -> Column:
    return 0.2989 * r + 0.5870 * g + 0.1140 * b


def rescaled(points: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """Landmarks after scaling by scale and cropping at (dx, dy)."""
    return F.transform(points, lambda p: F.struct((p["x"] * scale - dx).alias("x"), (p["y"] * scale - dy).alias("y")))


def salted(v: Column, key: Column, share: float, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    """Salt and pepper: a share of values becomes low or high, by a hash of key."""
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return F.when(h < share / 2, low).when(h < share, high).otherwise(v)


def turned(pixels_of: Column, width: int, degrees: Column, shift: Column, noise: Column):
    """Flat square images turned about their middle, moved sideways and lightened by noise, by nearest pixels: a pandas function."""
    @F.pandas_udf("array<double>")
    def turn(p: pd.Series, a: pd.Series, s: pd.Series, n: pd.Series) -> pd.Series:
        y, x = np.mgrid[:width, :width] - (width - 1) / 2
        out = []
        for flat, angle, dx, lift in zip(p, a, s, n, strict=True):
            c, d = np.cos(np.radians(angle)), np.sin(np.radians(angle))
            sx, sy = np.rint(c * x + d * y + (width - 1) / 2 - dx).astype(int), np.rint(c * y - d * x + (width - 1) / 2).astype(int)
            inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < width)
            img = np.asarray(flat, float).reshape(width, width)
            out.append((np.where(inside, img[np.clip(sy, 0, width - 1), np.clip(sx, 0, width - 1)], 0) + lift).ravel())
        return pd.Series(out)

    return turn(pixels_of, degrees, shift, noise)
