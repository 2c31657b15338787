"""Queries of images. An embedding of 64 values is an image of 8 by 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import grids as G
from tidewright.plans.registry import query
from tidewright.sources.tables import table

PIX = "WITH e AS (SELECT vec_id, embedding, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::double AS v FROM embeddings), p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v FROM e)"


def pixels(spark, d):
    return G.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


_K = {(dy, dx): w for dy, dx, w in G.SOBEL_X}
_GX = " + ".join(f"({w}::double) * coalesce(max(CASE WHEN q.y - p.y = {-dy} AND q.x - p.x = {-dx} THEN q.v END), 0)" for (dy, dx), w in _K.items())
_GY = " + ".join(f"({w}::double) * coalesce(max(CASE WHEN q.y - p.y = {-dx} AND q.x - p.x = {-dy} THEN q.v END), 0)" for (dy, dx), w in _K.items())


@query(PIX + f", g AS (SELECT p.vec_id, p.y, p.x, {_GX} AS gx, {_GY} AS gy FROM p JOIN p q ON q.vec_id = p.vec_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY p.vec_id, p.y, p.x) SELECT vec_id, y, x, round(sqrt(gx * gx + gy * gy), 6) AS g FROM g")
def sobel(spark, d):
    return G.sobel(pixels(spark, d), "vec_id", 8, 8).withColumn("g", F.round("g", 6))


@query(PIX + " SELECT vec_id, y // 2 AS y, x // 2 AS x, max(v) AS top, round(quantile_cont(v, 0.5), 9) + 0 AS middle FROM p GROUP BY ALL")
def pooling(spark, d):
    p = pixels(spark, d)
    top = G.pooled(p, "vec_id", 2, 8, 8, F.struct(F.max("v").alias("top"), (F.round(F.percentile("v", 0.5), 9) + 0).alias("middle")).alias("s"))
    return top.select("vec_id", "y", "x", "s.top", "s.middle")


@query(PIX + " SELECT vec_id, y // 3 AS y, x // 3 AS x, max(v) AS top FROM p WHERE y < 6 AND x < 6 GROUP BY ALL")
def pooling_partial(spark, d):
    return G.pooled(pixels(spark, d), "vec_id", 3, 8, 8, F.max("v").alias("top"))


@query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::double AS v FROM embeddings), c AS (SELECT vec_id, i // 3 AS p, max(CASE WHEN i % 3 = 0 THEN v END) AS r, max(CASE WHEN i % 3 = 1 THEN v END) AS g, max(CASE WHEN i % 3 = 2 THEN v END) AS b FROM e WHERE i < 63 GROUP BY ALL) SELECT vec_id, p, round(0.2989::double * r + 0.5870::double * g + 0.1140::double * b, 6) + 0 AS grey FROM c")
def grey_levels(spark, d):
    """Each three values are a pixel's red, green and blue."""
    e = F.col("embedding")
    px = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.struct(p.alias("p"), *(F.get(e, 3 * p + k).cast("double").alias(c) for k, c in enumerate("rgb"))))
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(px).alias("q"))
    return rows.select("vec_id", F.col("q.p").cast("long").alias("p"), (F.round(G.grey(F.col("q.r"), F.col("q.g"), F.col("q.b")), 6) + 0).alias("grey"))


BANK = [(dy, dx, c, o, round(0.1 * (dy + 2) + 0.05 * (dx + 2) + 0.2 * c - 0.1 * o, 4)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for c in (0, 1) for o in (0, 1, 2)]


@query(PIX + ", k(dy, dx, c, o, w) AS (VALUES " + ", ".join(f"({a}, {b}, {c}, {o}, {w}::double)" for a, b, c, o, w in BANK) + "), s AS (SELECT vec_id, y, x, 0 AS c, v FROM p UNION ALL SELECT vec_id, y, x, 1, v * v FROM p) SELECT vec_id, y + dy AS y, x + dx AS x, o AS c, round(sum(v * w), 6) + 0 AS v FROM s JOIN k USING (c) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY ALL")
def filter_bank(spark, d):
    """Two channels, values and their squares, under three kernels."""
    p = pixels(spark, d)
    two = p.select("vec_id", "y", "x", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("c"), F.col("v")), F.struct(F.lit(1).cast("long").alias("c"), (F.col("v") * F.col("v")).alias("v")))).alias("q")).select("vec_id", "y", "x", "q.c", "q.v")
    return G.filter_bank(two, "vec_id", BANK, 8, 8).withColumn("v", F.round("v", 6) + 0)


@query("WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, embedding AS e FROM embeddings) SELECT vec_id, i AS point, round(e[2 * i + 1]::double * 2 - 0.5::double, 6) + 0 AS x, round(e[2 * i + 2]::double * 2 - 0.25::double, 6) + 0 AS y FROM l WHERE i < 32")
def landmarks_moved(spark, d):
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    moved = table(spark, d, "embeddings").select("vec_id", F.posexplode(G.rescaled(pts, F.lit(2.0), F.lit(0.5), F.lit(0.25))).alias("point", "q"))
    return moved.select("vec_id", F.col("point").cast("long").alias("point"), (F.round("q.x", 6) + 0).alias("x"), (F.round("q.y", 6) + 0).alias("y"))


@query()
def salt_and_pepper(spark, d):
    return pixels(spark, d).withColumn("v", G.salted(F.col("v"), F.struct("vec_id", "y", "x"), 0.1))


@query()
def augmentation(spark, d):
    e = table(spark, d, "embeddings")
    u = [F.pmod(F.xxhash64("vec_id", F.lit(k)), F.lit(1000)) / 1000 for k in range(3)]
    return e.select("vec_id", G.turned(F.col("embedding").cast("array<double>"), 8, u[0] * 30 - 15, F.floor(u[1] * 3) - 1.0, u[2] / 5).alias("image"))
