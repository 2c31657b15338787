"""Metrics of binary classifiers, and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.strings import ratio


def confusion(predictions: DataFrame, threshold: float) -> DataFrame:
    """tp, fp, tn, fn of (mark, prediction); a prediction above the threshold is positive."""
    yes, one = F.col("prediction") > threshold, F.col("mark") == 1
    return predictions.agg(F.count_if(yes & one).alias("tp"), F.count_if(yes & (F.col("mark") == 0)).alias("fp"), F.count_if(~yes & (F.col("mark") == 0)).alias("tn"), F.count_if(~yes & one).alias("fn"))


def sweep(predictions: DataFrame, steps: int) -> DataFrame:
    """Metrics at thresholds 0, 1 / steps ... 1: rows are counted once by the number of thresholds below them, and the counts summed up."""
    below = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0), lambda a, i: a + (F.col("prediction") > i / F.lit(float(steps))).cast("int"))
    part = predictions.groupBy(below.alias("k"), "mark").agg(F.count("*").alias("n"))
    grid = predictions.sparkSession.range(0, steps + 1).select(F.col("id").alias("i"))
    both = grid.join(F.broadcast(part), how="cross")  # at most 2 (steps + 2) rows on that side
    yes, n = F.col("k") > F.col("i"), F.col("n")
    c = both.groupBy("i").agg(*(F.sum(F.when(cond, n).otherwise(0)).alias(name) for name, cond in (("tp", yes & (F.col("mark") == 1)), ("fp", yes & (F.col("mark") == 0)), ("tn", ~yes & (F.col("mark") == 0)), ("fn", ~yes & (F.col("mark") == 1)))))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    s = c.withColumns({"precision_1": ratio(tp, tp + fp), "recall_1": ratio(tp, tp + fn), "precision_0": ratio(tn, tn + fn), "recall_0": ratio(tn, tn + fp)})
    s = s.withColumns({f"f1_{k}": ratio(2 * F.col(f"precision_{k}") * F.col(f"recall_{k}"), F.col(f"precision_{k}") + F.col(f"recall_{k}")) for k in (0, 1)})
    names = ("precision_1", "recall_1", "precision_0", "recall_0", "f1_0", "f1_1")
    return s.select((F.col("i") / float(steps)).alias("threshold"), "tp", "fp", "tn", "fn", *(F.round(x, 6).alias(x) for x in names), F.round((F.col("f1_0") + F.col("f1_1")) / 2, 6).alias("macro_f1"))


def histogram(df: DataFrame, by: str, value: str, low: float, high: float, width: float) -> DataFrame:
    """Counts and densities of bins of fixed width in [low, high), for each class; values outside are left out."""
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    n = inside.groupBy(by, F.floor((F.col(value) - low) / float(width)).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return n.select(by, "bin", "n", F.round(F.col("n") / (total * float(width)), 9).alias("density"))


def even_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal bins from the least to the greatest value, which the last bin holds."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    return df.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(bins - 1).cast("long"), at).alias("bin")).agg(F.count("*").alias("n"))
