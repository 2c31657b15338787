"""Queries of numeric kernels over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import control as C
from tidewright.operators import numeric as N
from tidewright.plans.registry import query
from tidewright.sources.tables import table

VEC = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def r(c, n: int = 6):
    return F.round(c, n) + 0


@query(VEC + ", x AS (SELECT vec_id, unnest(e) * 20 AS x, generate_subscripts(e, 1) - 1 AS i FROM v) SELECT vec_id, i, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(greatest(x, 0), 6) + 0 AS relu, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) + 0 AS elu, round(tanh(x), 6) + 0 AS tanh, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS d_sigmoid, round(1 - tanh(x) * tanh(x), 6) AS d_tanh, CASE WHEN x > 0 THEN 1::double ELSE 0 END AS d_relu, round(CASE WHEN x > 0 THEN 1 ELSE exp(x) END, 6) AS d_elu FROM x")
def activations(spark, d):
    x = F.col("x")
    rows = vectors(spark, d).select("vec_id", F.posexplode("e").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), (F.col("v") * 20).alias("x"))
    g = N.gradients(x)
    return rows.select("vec_id", "i", F.round(N.sigmoid(x), 6).alias("sigmoid"), r(N.relu(x)).alias("relu"), r(N.elu(x)).alias("elu"), r(F.tanh(x)).alias("tanh"), F.round(g["sigmoid"], 6).alias("d_sigmoid"), F.round(g["tanh"], 6).alias("d_tanh"), g["relu"].alias("d_relu"), F.round(g["elu"], 6).alias("d_elu"))


@query(VEC + ", x AS (SELECT vec_id, label, e AS a FROM v), m AS (SELECT *, list_max(a) AS top FROM x), s AS (SELECT *, list_sum(list_transform(a, lambda q: exp(q - top))) AS z FROM m) SELECT vec_id, round(ln(z) + top - a[label + 1], 6) AS loss, list_position(a, top) - 1 AS best, round(exp(a[label + 1] - top) / z - 1, 6) AS gradient, CASE WHEN list_position(a, top) - 1 <> label THEN 1 ELSE 0 END AS wrong FROM s")
def softmax_loss(spark, d):
    v = vectors(spark, d).withColumn("a", F.col("e"))
    best = N.argmax(F.col("a"))
    return v.select("vec_id", F.round(N.nll(F.col("a"), F.col("label")), 6).alias("loss"), best.alias("best"), F.round(F.get(N.nll_gradient(F.col("a"), F.col("label")), F.col("label")), 6).alias("gradient"), (best != F.col("label")).cast("int").alias("wrong"))


@query(VEC + ", x AS (SELECT vec_id, unnest(e) AS p FROM v) SELECT vec_id, round(avg((p - round(p, 1)) * (p - round(p, 1))), 8) AS mse, round(avg(CASE WHEN p > 0 THEN -ln(1 / (1 + exp(-p))) ELSE -ln(1 - 1 / (1 + exp(-p))) END), 6) AS bce FROM x GROUP BY vec_id")
def losses(spark, d):
    p = F.col("p")
    x = vectors(spark, d).select("vec_id", F.explode("e").alias("p"))
    return x.groupBy("vec_id").agg(F.round(F.avg((p - F.round(p, 1)) * (p - F.round(p, 1))), 8).alias("mse"), F.round(F.avg(N.bce(N.sigmoid(p), (p > 0).cast("int"))), 6).alias("bce"))


@query(VEC + ", x AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM v), w AS (SELECT i, o, sin((i * 4 + o)::double) AS w FROM range(0, 64) a(i), range(0, 4) b(o)) SELECT vec_id, o, round(sum(x * w) + o * 0.1::double, 6) + 0 AS y FROM x JOIN w USING (i) GROUP BY vec_id, o")
def dense_layer(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode("e").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), "x")
    w = spark.range(64).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("o")).withColumn("w", F.sin((F.col("i") * 4 + F.col("o")).cast("double")))
    b = spark.range(4).select(F.col("id").alias("o"), (F.col("id") * 0.1).alias("b"))
    return N.dense(x, w, b, "vec_id").withColumn("y", r(F.col("y")))


_CHAIN = VEC + """, x AS MATERIALIZED (SELECT vec_id, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM v), w1 AS (SELECT i, o, sin((i * 4 + o)::double) / 8 AS w FROM range(0, 64) a(i), range(0, 4) b(o)), w2 AS (SELECT i, o, cos((i * 2 + o)::double) / 2 AS w FROM range(0, 4) a(i), range(0, 2) b(o)),
h AS MATERIALIZED (SELECT vec_id, o, sum(x * w) + o * 0.1::double AS z FROM x JOIN w1 USING (i) GROUP BY vec_id, o),
y AS MATERIALIZED (SELECT vec_id, w2.o, sum(tanh(z) * w) + w2.o * 0.1::double AS y FROM h JOIN w2 ON w2.i = h.o GROUP BY vec_id, w2.o),
d2 AS MATERIALIZED (SELECT vec_id, o, 2 * (y - CASE WHEN label % 2 = o THEN 1 ELSE 0 END) / (count(*) OVER ()) AS d FROM y JOIN v USING (vec_id)),
d1 AS MATERIALIZED (SELECT vec_id, h.o, sum(d * w) * (1 - tanh(any_value(z)) * tanh(any_value(z))) AS d FROM d2 JOIN w2 USING (o) JOIN h USING (vec_id) WHERE h.o = w2.i GROUP BY vec_id, h.o),
every AS (SELECT 1 AS layer, i, o, w - 0.5::double * g AS w FROM w1 JOIN (SELECT i, o, sum(x * d) AS g FROM x JOIN d1 USING (vec_id) GROUP BY i, o) USING (i, o)
UNION ALL SELECT 1, -1, o, o * 0.1::double - 0.5::double * sum(d) FROM d1 GROUP BY o
UNION ALL SELECT 2, i, o, w - 0.5::double * g FROM w2 JOIN (SELECT h.o AS i, d2.o, sum(tanh(z) * d) AS g FROM h JOIN d2 USING (vec_id) GROUP BY h.o, d2.o) USING (i, o)
UNION ALL SELECT 2, -1, o, o * 0.1::double - 0.5::double * sum(d) FROM d2 GROUP BY o)
SELECT layer, i, o, round(w, 6) + 0 AS w FROM every"""


@query(_CHAIN)
def chain_step(spark, d):
    """Weights after one step of gradient descent on the mean square error of two dense layers with tanh between them: 64 to 4 to 2, targets by the parity of the label. A bias has i = -1."""
    from tidewright.operators import network as W

    def layer(n: int, m: int, w) -> W.Dense:
        grid = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("o"))
        return W.Dense(grid.withColumn("w", w((F.col("i") * m + F.col("o")).cast("double"))), spark.range(m).select(F.col("id").alias("o"), (F.col("id") * 0.1).alias("b")))

    layers = [layer(64, 4, lambda a: F.sin(a) / 8), layer(4, 2, lambda a: F.cos(a) / 2)]
    net = W.Chain(layers[0], W.Activation("tanh"), layers[1])
    v = vectors(spark, d)
    x = v.select(F.col("vec_id").alias("key"), F.posexplode("e").alias("i", "x")).select("key", F.col("i").cast("long").alias("i"), "x")
    target = v.select(F.col("vec_id").alias("key"), F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("i"), (F.col("label") % 2 == o).cast("double").alias("t")) for o in range(2)))).alias("q")).select("key", "q.*")
    net.backward(W.mean_square(net.forward(x), target)[1])
    net.step(0.5)
    out = None
    for k, one in enumerate(layers, 1):
        rows = one.weights.unionAll(one.bias.select(F.lit(-1).cast("long"), "o", "b")).withColumn("layer", F.lit(k))
        out = rows if out is None else out.unionAll(rows)
    return out.select("layer", "i", "o", r(F.col("w")).alias("w"))


@query(VEC + ", n AS (SELECT vec_id, e, list_sum(e) / len(e) AS m FROM v), s AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / (len(e) - 1)) AS sd FROM n) SELECT vec_id, i - 1 AS i, round((e[i] - m) / (sd + 1e-6::double), 5) + 0 AS x FROM s, range(1, 65) r(i)")
def layer_norm(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode(N.layer_norm(F.col("e"))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r(F.col("x"), 5).alias("x"))


@query("SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), '') || ':' || len(embedding) || ':' || (len(embedding) + 10) AS coded FROM embeddings")
def one_hot(spark, d):
    hot = N.one_hot(F.col("label"), 10)
    both = F.concat(F.col("e"), hot.cast("array<double>"))
    return vectors(spark, d).select("vec_id", F.concat_ws(":", F.array_join(hot.cast("array<string>"), ""), F.size("e").cast("string"), F.size(both).cast("string")).alias("coded"))


@query(VEC + ", p AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, k, round(list_sum(list_transform(a, lambda x, i: x + (b[i] - x) * k / 15.0::double)), 5) + 0 AS total FROM p, range(0, 16) r(k)")
def interpolation(spark, d):
    """16 steps from each vector to the next."""
    v = vectors(spark, d)
    p = v.select("vec_id", F.col("e").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b")), "vec_id")
    steps = p.select("vec_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return steps.select("vec_id", F.col("k").cast("long").alias("k"), r(N.total(F.zip_with("a", "b", lambda x, y: x + (y - x) * F.col("k") / 15.0)), 5).alias("total"))


@query(VEC + " SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(e, lambda x: greatest(least(x, 0.1::double), -0.1::double))), 6) + 0 AS clipped, round(list_sum(list_transform(e, lambda x: x * 0.5::double)), 6) + 0 AS halved, round(list_sum(e) / len(e), 6) + 0 AS mean, round(exp(list_sum(list_transform(e, lambda x: abs(x))) / len(e)), 6) AS perplexity FROM v")
def tensor_operations(spark, d):
    e = F.col("e")
    return vectors(spark, d).select("vec_id", F.round(N.norm(e), 6).alias("norm"), r(N.total(F.transform(e, lambda x: N.clipped(x, 0.1)))).alias("clipped"), r(N.total(F.transform(e, lambda x: x * 0.5))).alias("halved"), r(N.total(e) / F.size(e)).alias("mean"), F.round(F.exp(N.total(F.transform(e, F.abs)) / F.size(e)), 6).alias("perplexity"))


@query(r"WITH c AS (SELECT conv_id, turn, [length(x) FOR x IN string_split_regex(trim(text), '\s+')] AS n FROM conversations), m AS (SELECT conv_id, max(len(n)) AS longest FROM c GROUP BY conv_id) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY len(n) DESC, turn) - 1 AS place, len(n) AS size, longest, longest - len(n) AS zeros, round(exp(list_sum(n)::double / longest / 10), 6) AS perplexity FROM c JOIN m USING (conv_id)")
def padded_batches(spark, d):
    """Each conversation is a batch: turns by falling size, padded to the longest; the loss is a mean over the padded shape."""
    from pyspark.sql import Window

    n = F.transform(F.split(F.trim("text"), r"\s+"), F.length)
    c = table(spark, d, "conversations").select("conv_id", "turn", n.alias("n"))
    batch = Window.partitionBy("conv_id")
    c = c.withColumns({"longest": F.max(F.size("n")).over(batch), "place": F.row_number().over(batch.orderBy(F.desc(F.size("n")), "turn")) - 1})
    c = c.withColumn("padded", N.padded(F.col("n"), F.col("longest"), F.lit(0)))
    zeros = F.size("padded") - F.size("n")
    loss = F.aggregate("padded", F.lit(0).cast("long"), lambda a, x: a + x).cast("double") / F.col("longest") / 10
    return c.select("conv_id", "turn", F.col("place").cast("long").alias("place"), F.size("n").cast("long").alias("size"), F.col("longest").cast("long").alias("longest"), zeros.cast("long").alias("zeros"), F.round(F.exp(loss), 6).alias("perplexity"))


@query("SELECT e AS epoch, round(0.1::double * pow(0.1::double, e // 1000), 9) AS rate FROM range(0, 4000, 250) r(e)")
def learning_rates(spark, d):
    return spark.range(0, 4000, 250).select(F.col("id").alias("epoch"), F.round(0.1 * F.pow(F.lit(0.1), F.floor(F.col("id") / 1000)), 9).alias("rate"))


@query("SELECT i, j, round(-1 + i * 0.2::double, 6) + 0 AS x, round(-1 + j * 0.2::double, 6) + 0 AS y FROM range(0, 11) a(i), range(0, 11) b(j)")
def mesh_grid(spark, d):
    g = spark.range(0, 11).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("j"))
    return g.select("i", "j", r(-1 + F.col("i") * 0.2).alias("x"), r(-1 + F.col("j") * 0.2).alias("y"))


@query("WITH x AS (SELECT event_id, value / 100 AS x FROM events) SELECT event_id, round(2 * x * sin(x) + x * x * cos(x), 4) + 0 AS exact, round(((x + 1e-6::double) * (x + 1e-6::double) * sin(x + 1e-6::double) - (x - 1e-6::double) * (x - 1e-6::double) * sin(x - 1e-6::double)) / 2e-6::double, 4) + 0 AS numeric FROM x")
def numeric_gradient(spark, d):
    x = F.col("value") / 100
    f = lambda t: t * t * F.sin(t)
    return table(spark, d, "events").select("event_id", r(N.OBJECTIVES["waves"][1](x), 4).alias("exact"), r(N.numeric_gradient(f, x), 4).alias("numeric"))


_G = {"bowl": "2 * {x}", "waves": "(2 * {x} * sin({x}) + {x} * {x} * cos({x}))", "ripples": "(2 * {x} * sin({x} * {x}) + 2 * {x} * {x} * {x} * cos({x} * {x}))"}
_F = {"bowl": "{x} * {x}", "waves": "{x} * {x} * sin({x})", "ripples": "{x} * {x} * sin({x} * {x})"}
_STEP = {
    "gd": lambda g: ("x - 0.1::double * " + g("x"), "m", "v"),
    "momentum": lambda g: (f"x - (0.9::double * m + 0.02::double * {g('x')})", f"0.9::double * m + 0.02::double * {g('x')}", "v"),
    "nag": lambda g: (f"x - (0.9::double * m + 0.02::double * {g('(x - 0.9::double * m)')})", f"0.9::double * m + 0.02::double * {g('(x - 0.9::double * m)')}", "v"),
    "adagrad": lambda g: (f"x - 0.5::double * {g('x')} / sqrt(v + {g('x')} * {g('x')} + 1e-8::double)", "m", f"v + {g('x')} * {g('x')}"),
    "adadelta": lambda g: (f"x - sqrt(m + 1e-6::double) / sqrt(0.9::double * v + 0.1::double * {g('x')} * {g('x')} + 1e-6::double) * {g('x')}", f"0.9::double * m + 0.1::double * pow(sqrt(m + 1e-6::double) / sqrt(0.9::double * v + 0.1::double * {g('x')} * {g('x')} + 1e-6::double) * {g('x')}, 2)", f"0.9::double * v + 0.1::double * {g('x')} * {g('x')}"),
    "adam": lambda g: (f"x - 0.1::double * ((0.9::double * m + 0.1::double * {g('x')}) / (1 - pow(0.9::double, t + 1))) / (sqrt((0.999::double * v + 0.001::double * {g('x')} * {g('x')}) / (1 - pow(0.999::double, t + 1))) + 1e-8::double)", f"0.9::double * m + 0.1::double * {g('x')}", f"0.999::double * v + 0.001::double * {g('x')} * {g('x')}"),
}


def _descent_sql() -> str:
    parts = []
    for o in _G:
        for m, step in _STEP.items():
            new = step(lambda x, o=o: _G[o].format(x=x))
            walk = f"WITH RECURSIVE w(c, t, x, m, v) AS (SELECT 'x', 0, 1.0::double, 0.0::double, 0.0::double UNION ALL SELECT 'y', 0, 2.0::double, 0.0::double, 0.0::double UNION ALL SELECT c, t + 1, {new[0]}, {new[1]}, {new[2]} FROM w WHERE t < 19)"
            parts.append(f"SELECT '{o}' AS objective, '{m}' AS method, t AS step, max(CASE WHEN c = 'x' THEN x END) AS px, max(CASE WHEN c = 'y' THEN x END) AS py FROM ({walk} SELECT * FROM w) GROUP BY t")
    loss = "CASE objective " + " ".join(f"WHEN '{o}' THEN {f.format(x='px')} + {f.format(x='py')}" for o, f in _F.items()) + " END"
    return f"SELECT objective, method, step, round(px, 5) + 0 AS x, round(py, 5) + 0 AS y, round({loss}, 5) + 0 AS loss FROM (" + " UNION ALL ".join(parts) + ")"


@query(_descent_sql())
def optimisers(spark, d):
    """20 points of each method on each objective."""
    out = None
    for o in N.OBJECTIVES:
        for m in N.RATES:
            t = N.trajectory(spark, o, m, 20)
            out = t if out is None else out.unionAll(t)
    return out.select("objective", "method", "step", *(r(F.col(c), 5).alias(c) for c in ("x", "y", "loss")))


@query()
def principal_components(spark, d):
    out, share = N.principal(vectors(spark, d), "e", 8)
    return out.select("vec_id", "pca", F.lit(float(share.sum())).alias("explained"))


@query()
def principal_sweep(spark, d):
    """For several numbers of components the share of variance up to there, and the mean square error of vectors restored from them."""
    out = None
    for k in (2, 8, 25, 64):
        rest, share = N.restored(vectors(spark, d), "e", k)
        one = rest.agg(F.round(F.avg("error"), 6).alias("mse")).select(F.lit(k).alias("k"), F.lit(round(float(share.sum()), 6)).alias("explained"), "mse")
        out = one if out is None else out.unionAll(one)
    return out


@query()
def digit_classifier(spark, d):
    """A multilayer perceptron over embeddings, as the dense nets."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, d).select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("e").alias("features"))
    model = MultilayerPerceptronClassifier(layers=[64, 16, 10], maxIter=20, seed=1).fit(rows)
    return model.transform(rows).select("vec_id", "label", "prediction")


@query()
def initial_weights(spark, d):
    """Normal, Xavier and He weights of a layer of 64 by 10."""
    w = spark.range(640, numPartitions=1).withColumn("z", F.randn(3))
    return w.select("id", F.col("z").alias("normal"), (F.col("z") * (2 / 74) ** 0.5).alias("xavier"), (F.col("z") * (2 / 64) ** 0.5).alias("he"))


@query(VEC + ", m AS (SELECT vec_id, e, list_max(e) AS top, ('0x' || left(md5('draw' || vec_id), 6))::BIGINT / 16777216.0::double AS u FROM v), z AS (SELECT *, list_sum(list_transform(e, lambda x: exp(x - top))) AS z FROM m), p AS (SELECT vec_id, u, unnest(e) AS x, generate_subscripts(e, 1) AS i, top, z FROM z), c AS (SELECT vec_id, u, round(sum(exp(x - top) / z) OVER (PARTITION BY vec_id ORDER BY i), 9) AS c FROM p) SELECT vec_id, least(sum(CASE WHEN c < u THEN 1 ELSE 0 END)::BIGINT, 63) AS drawn FROM c GROUP BY vec_id")
def sampled_classes(spark, d):
    """A class drawn from each vector's softmax, by a number that is a hash of its id."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("draw"), F.col("vec_id").cast("string"))), 1, 6), 16, 10).cast("double") / (1 << 24)
    below = F.aggregate("p", F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + (F.round(s["sum"] + x, 9) < F.col("u")).cast("long")).alias("n")))["n"]
    return vectors(spark, d).withColumn("p", N.softmax(F.col("e"))).withColumn("u", u).select("vec_id", F.least(below, (F.size("e") - 1).cast("long")).alias("drawn"))


@query()
def training_curves(spark, d):
    """Four networks that differ in their activation learn the embeddings' labels from four fifths of them: losses and accuracies by epoch, there and on the other fifth."""
    from tidewright.operators import training

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("x"), F.col("label").alias("y"))
    apart = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(5)) == 0
    nets = {name: [("dense", 32), name, ("dense", 10)] for name in ("sigmoid", "tanh", "relu", "elu")}
    _, curves = training.train(rows.where(~apart), rows.where(apart), nets, size=64, epochs=5, steps=8, rate=0.02, seed=1)
    out = spark.createDataFrame(curves, "net string, epoch int, train_loss double, train_accuracy double, test_loss double, test_accuracy double")
    return out.select("net", "epoch", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


def embedding_blocks(spark, d):
    """The embeddings as blocks of a matrix with a row for each; rows are numbered by hash parts, so that none is numbered twice and no task numbers all."""
    from tidewright.operators import matrix as M

    v = table(spark, d, "embeddings").where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("values"), F.col("vec_id"))
    numbered = v.select(F.monotonically_increasing_id().alias("row"), "values")  # any order of rows gives the same products
    return M.blocked(C.saved(numbered))


@query("WITH v AS (SELECT list_transform(embedding, lambda x: x::double) AS e FROM embeddings) SELECT i, j, round(sum(e[i + 1] * e[j + 1]), 5) + 0 AS v FROM v, range(0, 64) a(i), range(0, 64) b(j) GROUP BY i, j")
def gram_matrix(spark, d):
    """Products of all pairs of components, summed over the embeddings, as a product of block matrices."""
    from tidewright.operators import matrix as M

    x = embedding_blocks(spark, d)
    return M.cells(M.product(M.transposed(x), x)).select(F.col("r").alias("i"), F.col("c").alias("j"), r(F.col("v"), 5).alias("v"))


@query()
def explained_shares(spark, d):
    """Share and running share of variance of every principal component, from the matrix of products alone."""
    import numpy as np

    from tidewright.operators import matrix as M

    x = C.saved(embedding_blocks(spark, d))
    gram = np.zeros((M.SIZE, M.SIZE))
    for c in M.cells(M.product(M.transposed(x), x)).collect():  # 64 x 64 numbers
        gram[c.r, c.c] = c.v
    v = table(spark, d, "embeddings").where("embedding is not null").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("c", "x"))
    sums = {s.c: (s.x, s.n) for s in v.groupBy("c").agg(F.sum("x").alias("x"), F.count("*").alias("n")).collect()}  # 64 rows
    found = M.shares(gram, np.array([sums[k][0] for k in range(M.SIZE)]), max(n for _, n in sums.values()))
    return spark.createDataFrame([(k, round(p, 6), round(q, 6)) for k, p, q in found], "k int, share double, running double")
