"""Queries over ordered series. Each user's events, in order of time, are a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import series as R
from tidewright.plans.registry import query
from tidewright.sources.tables import table

BASE = "WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"
BY = "OVER (PARTITION BY user_id ORDER BY t"


def numbered(spark, d):
    return R.numbered(table(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("v")), ["user_id"], ["ts", "event_id"]).select("user_id", "t", "v")


@query(BASE + f", m AS (SELECT user_id, t, avg(v) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM s) SELECT user_id, t, round(mean, 6) AS mean FROM m WHERE t >= 19")
def moving_average(spark, d):
    return R.moving_average(numbered(spark, d), ["user_id"], 20).select("user_id", "t", F.round("mean", 6).alias("mean"))


@query(BASE + f" SELECT user_id, t, round(sum(v) {BY} ROWS UNBOUNDED PRECEDING), 4) AS total FROM s")
def cumulative_sum(spark, d):
    return numbered(spark, d).withColumn("total", F.round(F.sum("v").over(R.upto(["user_id"])), 4)).select("user_id", "t", "total")


@query(BASE + f", w AS (SELECT user_id, t, list(v) {BY} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x, list(v) {BY} ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING) AS y, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT user_id, t, array_to_string(list_transform(x, lambda v: round(v, 2)::varchar), ' ') AS x, array_to_string(list_transform(y, lambda v: round(v, 2)::varchar), ' ') AS y FROM w WHERE t < n - 5 - 1 - 2")
def supervised_windows(spark, d):
    def shown(c):
        return F.array_join(F.transform(c, lambda v: F.round(v, 2).cast("string")), " ").alias(c)

    return R.windows(numbered(spark, d), ["user_id"], 5, 2).select("user_id", "t", shown("x"), shown("y"))


@query(BASE + f", c AS (SELECT user_id, t, 0.5::double * v + 0.3::double * lag(v, 1) {BY}) + 0.2::double * lag(v, 2) {BY}) AS c FROM s) SELECT user_id, t, round(c, 6) AS c FROM c WHERE t >= 2")
def convolution(spark, d):
    return R.convolved(numbered(spark, d), ["user_id"], [0.5, 0.3, 0.2]).select("user_id", "t", F.round("c", 6).alias("c"))


@query(BASE + f" SELECT user_id, t, round(sum(v) {BY} ROWS BETWEEN 35 PRECEDING AND 35 FOLLOWING) / 71, 6) AS smooth FROM s")
def box_smoothing(spark, d):
    return R.box(numbered(spark, d), ["user_id"], 71).select("user_id", "t", F.round("smooth", 6).alias("smooth"))


@query(BASE + ", k AS (SELECT 2 * i + 3 AS size FROM range(0, 498) r(i)), " + "c AS (SELECT user_id, t, v, sum(v) OVER (PARTITION BY user_id ORDER BY t) AS upto, sum(v) OVER (PARTITION BY user_id) AS every FROM s), b AS (SELECT size, c.v, (coalesce(hi.upto, c.every) - coalesce(lo.upto, 0)) / size AS smooth FROM c CROSS JOIN k LEFT JOIN c hi ON hi.user_id = c.user_id AND hi.t = c.t + (size - 1) // 2 LEFT JOIN c lo ON lo.user_id = c.user_id AND lo.t = c.t - (size + 1) // 2) SELECT size, round(avg((smooth - v) * (smooth - v)), 4) AS mse FROM b GROUP BY size")
def smoothing_sweep(spark, d):
    return R.box_sweep(numbered(spark, d), ["user_id"], range(3, 998, 2)).select("size", F.round("mse", 4).alias("mse"))


@query(BASE + " SELECT user_id, t, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS scaled FROM s")
def minmax_scaling(spark, d):
    return R.scaled(numbered(spark, d), "v").select("user_id", "t", F.round("scaled", 6).alias("scaled"))


@query(BASE + " SELECT user_id, t, round((v - 0.1307::double) / 0.3081::double, 6) AS z FROM s")
def z_normalisation(spark, d):
    return numbered(spark, d).select("user_id", "t", F.round((F.col("v") - 0.1307) / 0.3081, 6).alias("z"))


@query(BASE + " SELECT user_id, t, CAST(floor((v - min(v) OVER ()) * (500 / (max(v) OVER () - min(v) OVER ())) + 20) AS BIGINT) AS x FROM s")
def frame_scaling(spark, d):
    return R.framed(numbered(spark, d), "v", 500, 20).select("user_id", "t", "x")


@query(BASE + " SELECT user_id, t, v FROM s WHERE t % 3 = 0")
def every_third(spark, d):
    return numbered(spark, d).where(F.pmod("t", F.lit(3)) == 0)


@query(BASE + ", n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s) SELECT user_id, t, CASE WHEN t < floor(0.67::double * n) THEN 'train' ELSE 'test' END AS part FROM n")
def prefix_split(spark, d):
    return R.prefix_split(numbered(spark, d), ["user_id"], 0.67).select("user_id", "t", "part")


@query("SELECT event_id, CASE WHEN ('0x' || left(md5(event_id::varchar), 4))::int % 100 < 67 THEN 'train' ELSE 'test' END AS part FROM events")
def hash_split(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 100 < 67, "train").otherwise("test").alias("part"))


@query()
def random_split(spark, d):
    train, test = table(spark, d, "events").select("event_id").randomSplit([0.67, 0.33], 7)
    return train.withColumn("part", F.lit("train")).unionAll(test.withColumn("part", F.lit("test")))


@query()
def roll_out(spark, d):
    """The next 10 values of each series, each predicted from the 5 before it."""
    return R.roll_out(numbered(spark, d), ["user_id"], [0.1, 0.1, 0.2, 0.2, 0.4], 10)


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), f AS (SELECT user_id, sum(CASE WHEN before IS NULL OR us - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, session, count(*) AS n FROM f GROUP BY ALL")
def sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return R.sessions(e, ["user_id"], ["us", "event_id"], "us", 3_600_000_000).groupBy("user_id", "session").agg(F.count("*").alias("n"))


LSTM = {"w": [0.5, -0.3, 0.2, 0.4, 0.6, -0.5, 0.3, 0.1], "u": [[0.1, 0.2, -0.1, 0.3, 0.2, -0.2, 0.1, 0.4], [-0.2, 0.1, 0.3, -0.1, 0.1, 0.3, -0.3, 0.2]], "b": [0.0, 0.1, 1.0, 1.0, 0.0, -0.1, 0.2, 0.0]}


def _lstm_sql() -> str:
    gate = lambda j: f"(x * {LSTM['w'][j]}::double + h0 * {LSTM['u'][0][j]}::double + h1 * {LSTM['u'][1][j]}::double + {LSTM['b'][j]}::double)"
    up = lambda z: f"(1 / (1 + exp(-{z})))"
    cell = [f"c{k} * {up(gate(2 + k))} + {up(gate(k))} * tanh({gate(4 + k)})" for k in range(2)]
    return (
        BASE.replace("WITH s", "WITH RECURSIVE s") + ", n AS (SELECT user_id, max(t) AS last FROM s GROUP BY user_id), w(user_id, t, h0, h1, c0, c1) AS (SELECT user_id, -1::BIGINT, 0.0::double, 0.0::double, 0.0::double, 0.0::double FROM n UNION ALL SELECT user_id, t, "
        + ", ".join(f"{up(gate(6 + k))} * tanh({cell[k]})" for k in range(2)) + ", " + ", ".join(cell)
        + " FROM (SELECT w.user_id, s.t, s.v / 1000 AS x, h0, h1, c0, c1 FROM w JOIN s ON s.user_id = w.user_id AND s.t = w.t + 1)) SELECT user_id, round(h0, 6) + 0 AS h0, round(h1, 6) + 0 AS h1 FROM w JOIN n USING (user_id) WHERE t = last"
    )


@query(_lstm_sql())
def lstm_states(spark, d):
    """The last hidden state of a cell of two units over each user's values."""
    rows = numbered(spark, d).withColumn("v", F.col("v") / 1000)
    return R.lstm(rows, ["user_id"], LSTM).select("user_id", *((F.round(F.get("h", F.lit(k)), 6) + 0).alias(f"h{k}") for k in range(2)))
