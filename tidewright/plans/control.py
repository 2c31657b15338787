"""Queries of decision processes: a user's event type is a state, its successor's the next, the parity of its value the action, the value the reward."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import control as C
from tidewright.plans.registry import query
from tidewright.sources.tables import table

BASE = """WITH RECURSIVE e AS (SELECT event_type AS s, CAST(floor(value) AS BIGINT) % 2 AS a, value / 100 AS r, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s2 FROM events),
n AS (SELECT s, a, s2, count(*) AS n, sum(CAST(r AS DECIMAL(20, 8)))::double / count(*) AS r FROM e WHERE s2 IS NOT NULL GROUP BY ALL),
p AS (SELECT s, a, s2, n::double / sum(n) OVER (PARTITION BY s, a) AS p, r FROM n)"""


def steps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("s"), (F.floor("value") % 2).alias("a"), (F.col("value") / 100).alias("r"), F.lead("event_type").over(w).alias("s2"))
    return e.where("s2 is not null")


def process(spark, d):
    return C.estimated(steps(spark, d))


@query(BASE + " SELECT s, a, s2, round(p, 6) AS p, round(r, 6) AS r FROM p")
def transitions(spark, d):
    return process(spark, d).select("s", "a", "s2", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"))


_V = "v0 AS (SELECT DISTINCT s, 0.0::double AS v FROM p WHERE a = 0), " + ", ".join(f"v{k} AS (SELECT p.s, sum(p.p * (p.r + 0.9::double * coalesce(v.v, 0))) AS v FROM p LEFT JOIN v{k - 1} v ON v.s = p.s2 WHERE p.a = 0 GROUP BY p.s)" for k in range(1, 7))


@query(BASE + ", " + _V + " SELECT s, round(v, 5) AS v FROM v6")
def policy_evaluation(spark, d):
    p = C.saved(process(spark, d))
    policy = p.select("s").distinct().withColumn("a", F.lit(0).cast("long"))
    return C.evaluate(p, policy, 0.9, 6).select("s", F.round("v", 5).alias("v"))


@query(BASE + ", " + _V + ", q AS (SELECT p.s, p.a, sum(p.p * (p.r + 0.9::double * coalesce(v.v, 0))) AS q FROM p LEFT JOIN v6 v ON v.s = p.s2 GROUP BY p.s, p.a) SELECT s, a FROM (SELECT s, a, row_number() OVER (PARTITION BY s ORDER BY round(q, 9) DESC, a) AS k FROM q) WHERE k = 1")
def greedy_policy(spark, d):
    p = C.saved(process(spark, d))
    policy = p.select("s").distinct().withColumn("a", F.lit(0).cast("long"))
    return C.greedy(p, C.evaluate(p, policy, 0.9, 6), 0.9)


_W = "w(t, s, v) AS (SELECT 0, s, 0.0::double FROM (SELECT DISTINCT s FROM p WHERE a = 0) UNION ALL SELECT w.t + 1, p.s, sum(p.p * (p.r + 0.9::double * w.v)) FROM w JOIN p ON p.s2 = w.s WHERE p.a = 0 AND w.t < 400 GROUP BY w.t, p.s)"


@query(BASE + ", " + _W + " SELECT s, round(v, 5) AS v FROM w WHERE t = 400")
def policy_values(spark, d):
    """Evaluation until no value moves by 1e-10. Every state has action 0."""
    p = C.saved(process(spark, d))
    policy = p.select("s").distinct().withColumn("a", F.lit(0).cast("long"))
    return C.evaluate(p, policy, 0.9, 400, 1e-10).select("s", F.round("v", 5).alias("v"))


GAMMAS = (1.0, 0.9, 0.5, 0.2, 0.0)
#: Turns of policy iteration, one after the other: values of the policy, then the best actions by them.
_TURNS = ", ".join(f"""w{k}(gamma, t, s, v) AS (SELECT gamma, 0, s, 0.0::double FROM a{k} UNION ALL
  SELECT w.gamma, w.t + 1, a.s, sum(q.p * (q.r + w.gamma * w.v)) FROM w{k} w JOIN q ON q.s2 = w.s JOIN a{k} a ON a.gamma = w.gamma AND a.s = q.s AND a.a = q.a WHERE w.t < 3000 GROUP BY w.gamma, w.t, a.s),
v{k} AS MATERIALIZED (SELECT gamma, s, v FROM w{k} WHERE t = 3000),
a{k + 1} AS MATERIALIZED (SELECT gamma, s, arg_min(a, (-g, a)) AS a FROM (SELECT v.gamma, q.s, q.a, round(sum(q.p * (q.r + v.gamma * v.v)), 9) AS g FROM q JOIN v{k} v ON v.s = q.s2 GROUP BY ALL) GROUP BY gamma, s)""" for k in range(4))


@query(BASE.replace("WHERE s2 IS NOT NULL ", "").replace("lead(event_type)", "lead(event_type, 1, '-')") + f""", q AS MATERIALIZED (SELECT s, a, s2, p, r FROM p UNION ALL SELECT '-', 0, '-', 1, 0),
a0 AS MATERIALIZED (SELECT gamma, s, min(a) AS a FROM q, (SELECT unnest([{", ".join(f"{g}::double" for g in GAMMAS)}]) AS gamma) GROUP BY ALL), {_TURNS}
SELECT gamma, s, a3.a, round(v, 5) AS v FROM a3 JOIN v3 USING (gamma, s) WHERE s <> '-'""")
def policy_iteration(spark, d):
    """The best actions and their values at each discount, where a user's last event ends the episode."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("s"), (F.floor("value") % 2).alias("a"), (F.col("value") / 100).alias("r"), F.lead("event_type").over(w).alias("s2"))
    return C.improve(C.estimated(e), list(GAMMAS)).select("gamma", "s", "a", F.round("v", 5).alias("v"))


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS r FROM events), g AS (SELECT user_id, sum(pow(0.9::double, t) * r) AS g FROM e GROUP BY user_id) SELECT round(avg(g), 5) AS mean_return, count(*) AS episodes FROM g")
def mean_return(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("episode"), (F.row_number().over(w) - 1).alias("step"), F.col("value").alias("r"))
    return C.returns(e, 0.9).agg(F.round(F.avg("g"), 5).alias("mean_return"), F.count("*").alias("episodes"))
