"""Markov decision processes as tables of transitions (s, a, p, s2, r, done)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def estimated(steps: DataFrame) -> DataFrame:
    """Transitions from observed steps (s, a, s2, r), where a null s2 is the end: shares and mean rewards. Rewards are summed as decimals, so that no order of rows changes the mean."""
    n = steps.groupBy("s", "a", "s2").agg(F.count("*").alias("n"), (F.sum(F.col("r").cast("decimal(20,8)")).cast("double") / F.count("*")).alias("r"))
    total = n.groupBy("s", "a").agg(F.sum("n").alias("total"))
    return n.join(total, ["s", "a"]).select("s", "a", "s2", (F.col("n") / F.col("total")).alias("p"), "r", F.col("s2").isNull().alias("done"))


def backup(transitions: DataFrame, values: DataFrame, gamma: float) -> DataFrame:
    """s, a, q: expected reward and discounted value of each action."""
    v = values.select(F.col("s").alias("s2"), "v")
    gain = F.col("p") * (F.col("r") + gamma * F.when(F.col("done"), 0.0).otherwise(F.coalesce("v", F.lit(0.0))))
    return transitions.join(v, "s2", "left").groupBy("s", "a").agg(F.sum(gain).alias("q"))


def evaluate(transitions: DataFrame, policy: DataFrame, gamma: float, rounds: int, tolerance: float = 0.0) -> DataFrame:
    """s, v of a policy (s, a) after so many rounds, or fewer once no value moves by the tolerance. A few rounds' plan is cut by a checkpoint."""
    own = transitions.join(policy, ["s", "a"])
    values = own.select("s").distinct().withColumn("v", F.lit(0.0))
    for k in range(rounds):
        new = backup(own, values, gamma).select("s", F.col("q").alias("v"))
        if k % 10 == 9:
            new = saved(new)
            if tolerance:
                move = new.join(values.withColumnRenamed("v", "w"), "s").agg(F.sqrt(F.sum((F.col("v") - F.col("w")) ** 2)).alias("d")).first().d
                if move is not None and move <= tolerance:
                    return new
        values = new
    return values


def greedy(transitions: DataFrame, values: DataFrame, gamma: float) -> DataFrame:
    """s, a: the best action, the first on ties."""
    q = backup(transitions, values, gamma)
    return q.groupBy("s").agg(F.min_by("a", F.struct((-F.round("q", 9)).alias("q"), "a")).alias("a"))


#: States of a process that improve() takes whole, as arrays in one row.
MOST_STATES = 128

IMPROVED = """
WITH RECURSIVE run MAX RECURSION LEVEL {turns} AS (
  SELECT gamma, m.model, 0 AS turn, m.first AS policy, {first} AS v, true AS moved FROM {gammas} CROSS JOIN {mdp} m
  UNION ALL
  SELECT gamma, model, turn + 1, better, {better} AS v, better <> policy FROM (SELECT *, {greedy} AS better FROM run WHERE moved))
SELECT gamma, max_by(policy, turn) AS policy, max_by(v, turn) AS v, NOT min_by(moved, -turn) AS ended FROM run GROUP BY gamma"""


def improve(transitions: DataFrame, gammas: list[float] | float, turns: int = 50) -> DataFrame:
    """gamma, s, a, v: policy iteration until the policy stays, for each discount (or the one), by recursive SQL. A turn evaluates the policy to its fixpoint: with M the discounted chances of the policy and
    b its rewards, b + M b and M M stand for twice as many steps, and 2^14 steps leave nothing. Raises an error where they do (a discount of 1 and no way to an end), where
    the policy still moves after so many turns, and above MOST_STATES states. Ties take the first action; a state that is never left has no row and the value 0."""
    spark, gammas = transitions.sparkSession, gammas if isinstance(gammas, list) else [gammas]
    numbered = transitions.where("s is not null").select("s").distinct().limit(MOST_STATES + 1).orderBy("s").collect()
    if len(numbered) > MOST_STATES:
        raise ValueError(f"more than {MOST_STATES} states")
    if not numbered:
        return transitions.select(F.lit(0.0).alias("gamma"), "s", "a", F.lit(0.0).alias("v")).limit(0)
    n, states = len(numbered), F.array(*(F.lit(r.s) for r in numbered))
    at = lambda c: F.array_position(states, F.col(c)) - 1  # -1: an end
    go = F.map_from_entries(F.collect_list(F.struct(F.when(F.col("done") | F.col("s2").isNull(), -1).otherwise(at("s2")).alias("i"), F.col("p").alias("p"))))
    summed = transitions.where("s is not null and a is not null").groupBy("s", "a", "s2", "done").agg(F.sum("p").alias("p"), F.sum(F.col("p") * F.col("r")).alias("r"))
    ends = summed.groupBy("s", "a", F.when(F.col("done"), None).otherwise(F.col("s2")).alias("s2")).agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.every("done").alias("done"))
    actions = ends.groupBy("s", "a").agg(go.alias("go"), F.sum("r").alias("r"))
    row = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.element_at("go", j.cast("long")), F.lit(0.0)))
    by_state = actions.select("s", F.struct("a", "r", row.alias("p")).alias("x")).groupBy("s").agg(F.sort_array(F.collect_list("x")).alias("x"))
    mdp = by_state.groupBy().agg(F.sort_array(F.collect_list(F.struct(at("s").alias("i"), "x"))).alias("m")).select(F.transform("m", lambda s: s["x"]).alias("model"), F.array_repeat(F.lit(0), n).alias("first"))

    seq = f"sequence(0, {n - 1})"
    dot = lambda a, b: f"aggregate({seq}, 0D, (y, k) -> y + {a} * {b})"
    twice = f"named_struct('m', transform({seq}, i -> transform({seq}, j -> {dot('x.m[i][k]', 'x.m[k][j]')})), 'b', transform({seq}, i -> x.b[i] + {dot('x.m[i][k]', 'x.b[k]')}))"

    def valued(policy: str, model: str) -> str:
        start = f"named_struct('m', transform({seq}, i -> transform({model}[i][{policy}[i]].p, p -> p * gamma)), 'b', transform({seq}, i -> {model}[i][{policy}[i]].r))"
        left = f"array_max(transform(x.m, r -> aggregate(r, 0D, (y, p) -> y + p))) > 1e-9"
        return f"aggregate(sequence(1, 14), {start}, (x, turn) -> {twice}, x -> IF({left}, raise_error('the values have no bound at this discount'), x.b))"

    gain = f"round(model[i][a].r + gamma * {dot('model[i][a].p[k]', 'v[k]')}, 9)"
    greedy = f"transform({seq}, i -> array_min(transform(sequence(0, size(model[i]) - 1), a -> named_struct('q', -{gain}, 'a', a))).a)"
    names = {k: f"_{k}_{uuid.uuid4().hex}" for k in ("gammas", "mdp")}
    spark.createDataFrame([(float(g),) for g in gammas], "gamma double").createOrReplaceTempView(names["gammas"])
    saved(mdp).createOrReplaceTempView(names["mdp"])
    found = saved(spark.sql(IMPROVED.format(turns=turns + 1, first=valued("m.first", "m.model"), better=valued("better", "model"), greedy=greedy, **names)))
    if found.where("not ended").limit(1).count():
        raise ValueError(f"the policy still moves after {turns} turns")
    model = spark.table(names["mdp"])
    each = found.crossJoin(F.broadcast(model.select("model"))).select("gamma", F.posexplode(F.arrays_zip("policy", "v", "model")).alias("i", "x"))  # model: one row
    out = each.select("gamma", F.get(states, F.col("i")).alias("s"), F.get("x.model", F.col("x.policy"))["a"].alias("a"), F.col("x.v").alias("v"))
    for name in names.values():
        spark.catalog.dropTempView(name)
    return out


def returns(rewards: DataFrame, gamma: float) -> DataFrame:
    """episode, g: discounted returns of (episode, step, r)."""
    return rewards.groupBy("episode").agg(F.sum(F.pow(F.lit(gamma), F.col("step")) * F.col("r")).alias("g"))


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder's name in spark.checkpoint.dir or, where none is set and one machine does all, in a folder of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"file://{tempfile.gettempdir()}/tidewright-{uuid.uuid4().hex}"
        context.setCheckpointDir(base)
    return f"{context.getCheckpointDir().rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()
