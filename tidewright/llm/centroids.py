"""Exact k-means over integer vectors, with block-norm screening.

A vector is cut into SEGMENTS segments. Its compressed form has, for each, the mean of the components (times the root of the segment's length) and the norm of what is
left of them. By the Cauchy-Schwarz inequality on what is left, the squared distance of two compressed vectors is never more than that of
the vectors themselves. Compressed vectors are computed once, those of the centroids once a round; a centroid whose bound is above the best distance found is left out,
and only the others get an exact distance, in integers. Bounds are lowered by SLACK of the norms, far more than rounding can raise them, so no
nearest centroid is lost.

Vectors lie in packed rows of BLOCK_ROWS in a table that each round reads again. A round sends the centroids to the tasks (k rows, whatever the input) and sums
count and components by cluster: k rows from each task, added up by Spark in decimals.

Kept are vectors of exactly `size` components, none of them null, NaN or infinite; other rows are left out. Repeated rows count each; a null
vec_id is kept, but starts a centroid only after all others. Equal starting rows (of one vec_id) are taken by their components. With fewer vectors than k each starts a
centroid; an empty table gives no rows. Components are floor(scale * x); beyond 2^26 distances might not fit a long, which raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import common

SEGMENTS, BLOCK_ROWS, SLACK = 8, 4096, 1e-5
LARGEST = 1 << 26


def vectors(table: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and v: the integer components of the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == size) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    large = F.exists("x", lambda e: F.abs(e * scale) > LARGEST)
    v = F.transform("x", lambda e: F.floor(e * scale).cast("int"))
    return rows.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST / scale:.0f}"))).otherwise(v).cast("array<int>").alias("v"))


def compressed(v: np.ndarray) -> np.ndarray:
    """Two numbers for each segment; the squared distance of two rows bounds that of the vectors from below."""
    parts = np.array_split(v.astype(np.float64), min(SEGMENTS, v.shape[1]), axis=1)
    means = [p.mean(axis=1, keepdims=True) for p in parts]
    rest = [np.sqrt(((p - m) ** 2).sum(axis=1)) for p, m in zip(parts, means, strict=True)]
    return np.stack([*(m[:, 0] * np.sqrt(p.shape[1]) for p, m in zip(parts, means, strict=True)), *rest], axis=1)


def nearest(v: np.ndarray, short: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (the smaller number of equals), the squared distance, and how many exact distances that took."""
    small = compressed(centroids)
    norms, own = (short**2).sum(axis=1)[:, None], (small**2).sum(axis=1)[None]
    bound = norms + own - 2 * short @ small.T - SLACK * (norms + own)
    order = np.argsort(bound, axis=1, kind="stable")
    best, at = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), len(centroids))
    alive, exact = np.arange(len(v)), 0
    for r in range(len(centroids)):
        j = order[alive, r]
        near = bound[alive, j] <= best[alive]  # bounds ascend: a row that is out stays out
        alive, j = alive[near], j[near]
        if not len(alive):
            break
        d = ((v[alive] - centroids[j]) ** 2).sum(axis=1)
        exact += len(alive)
        closer = (d < best[alive]) | (d == best[alive]) & (j < at[alive])
        best[alive[closer]], at[alive[closer]] = d[closer], j[closer]
    return at, best, exact


def packed(rows: DataFrame, size: int) -> DataFrame:
    """ids, vectors and compressed vectors, BLOCK_ROWS to a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                v = part.column("v").flatten().to_numpy().reshape(-1, size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id")], pa.list_(pa.int64())), pa.array([v.tobytes()]), pa.array([compressed(v).tobytes()])], ["ids", "vectors", "short"])

    return rows.mapInArrow(common.freed(scan), "ids array<long>, vectors binary, short binary")


def opened(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            v = np.frombuffer(batch.column("vectors")[k].as_py(), np.int32).reshape(-1, size).astype(np.int64)
            yield batch.column("ids").slice(k, 1).flatten(), v, np.frombuffer(batch.column("short")[k].as_py(), np.float64).reshape(len(v), -1)


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least sha256 of "seed:vec_id"."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: each the floor of its vectors' mean, or as it was where it has none."""
    size = centroids.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, v, short in opened(batches, size):
            at, _, _ = nearest(v, short, centroids)
            order = np.argsort(at, kind="stable")
            met, begin, many = np.unique(at[order], return_index=True, return_counts=True)
            total[met] += np.add.reduceat(v[order], begin)
            n[met] += many
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(total[met].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = blocks.mapInArrow(common.freed(scan), "cluster long, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("k", "x"))
    out = centroids.copy()
    for r in sums.groupBy("cluster", "k").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k x size rows
        out[r.cluster, r.k] = int(r.x) // int(r.n)
    return out


def cluster(table: DataFrame, k: int, rounds: int, seed: int, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector kept. Runs a job for each round."""
    spark = table.sparkSession
    kinds = "vec_id long, cluster int, distance long"
    rows = vectors(table, size, scale)
    blocks = common.kept(packed(rows, size), "vectors")
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{kinds}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, short in opened(batches, size):
            at, d, _ = nearest(v, short, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    last = common.kept(blocks.mapInArrow(common.freed(scan), kinds), "clusters")
    inertia = {r.cluster: r.d for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    whole = sum(inertia.values())
    by = [(c, d, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    side = spark.createDataFrame(by, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int, rounds: int, seed: int, size: int = 64, scale: int = 256) -> str:
    """The same in DuckDB SQL, by comparing every vector with every centroid."""
    near = "SELECT v.vec_id, v.v, arg_min(c.c, (d, c.c)) AS c, min(d) AS d FROM kept v, cents{0} c, LATERAL (SELECT list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) GROUP BY v.vec_id, v.v"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"cents0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(r)})")
        if r < rounds:
            steps.append(f"part{r} AS (SELECT c, k, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM near{r}) GROUP BY c, k)")
            steps.append(f"mean{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS v FROM part{r} GROUP BY c)")
            steps.append(f"cents{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM cents{r} o LEFT JOIN mean{r} m USING (c))")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(t.v, ',')) AS centroid_sha256
        FROM near{rounds} JOIN cents{rounds} t USING (c)"""
