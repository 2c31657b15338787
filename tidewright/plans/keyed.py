"""Queries of keyed state. An event is a command: its type is the verb, its user the key, its number the value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import keyed as K
from tidewright.plans.registry import query
from tidewright.sources.tables import table

VERBS = {"signup": "set", "click": "append", "view": "add", "purchase": "replace", "error": "delete"}
BASE = "WITH c AS (SELECT user_id::varchar AS key, event_id AS seq, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VERBS.items()) + """ END AS op, event_id::varchar AS body FROM events),
a AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('set', 'add') THEN true WHEN op = 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS present FROM c),
e AS (SELECT *, sum(CASE WHEN op = 'set' OR op = 'add' AND NOT present OR op = 'replace' AND present OR op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS era FROM a),
v AS (SELECT key, seq, op, present, CASE WHEN op IN ('set', 'add') OR (op <> 'delete' AND present) THEN string_agg(CASE WHEN op = 'set' OR op = 'add' AND NOT present OR op = 'replace' AND present OR op = 'append' AND present THEN body END, '') OVER (PARTITION BY key, era ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS value,
CASE op WHEN 'set' THEN 'STORED' WHEN 'add' THEN CASE WHEN present THEN 'NOT_STORED' ELSE 'STORED' END WHEN 'delete' THEN CASE WHEN present THEN 'DELETED' ELSE 'NOT_FOUND' END ELSE CASE WHEN present THEN 'STORED' ELSE 'NOT_STORED' END END AS reply FROM e),
f AS (SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM v) WHERE k = 1 AND value IS NOT NULL)
"""


def commands(spark, d):
    verb = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in VERBS.items()))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), verb.alias("op"), F.col("event_id").cast("string").alias("body"))


@query(BASE + "SELECT key, seq, op, reply, value FROM v")
def command_outcomes(spark, d):
    return K.outcomes(commands(spark, d)).select("key", "seq", "op", "reply", "value")


@query(BASE + "SELECT key, value FROM f")
def command_fold(spark, d):
    return K.final(commands(spark, d))


@query(BASE + ", r AS (SELECT i AS id, unnest([i, i + 7, i + 1000, i * 2]) AS k, unnest([0, 1, 2, 3]) AS pos FROM range(0, 50) x(i)), b AS (SELECT id, string_agg('VALUE ' || key || ' 0 ' || octet_length(encode(value)) || chr(13) || chr(10) || value || chr(13) || chr(10), '' ORDER BY pos) AS t FROM r JOIN f ON f.key = r.k::varchar GROUP BY id) SELECT i AS id, coalesce(t, '') || 'END' AS reply FROM range(0, 50) x(i) LEFT JOIN b ON b.id = i")
def multi_get(spark, d):
    keys = F.array(*(c.cast("string") for c in (F.col("id"), F.col("id") + 7, F.col("id") + 1000, F.col("id") * 2)))
    return K.multi_get(spark.range(50).select("id", keys.alias("keys")), K.final(commands(spark, d)))


LINES = "CASE event_id % 5 WHEN 0 THEN 'set k' || user_id || ' 0 60 ' || length(event_id::varchar) WHEN 1 THEN 'get k' || user_id || ' k' || event_id WHEN 2 THEN 'prepend k' || user_id || ' 1 -1 3' WHEN 3 THEN 'stats' ELSE 'incr k' || user_id || ' 5' END"


@query(rf"WITH l AS (SELECT event_id, {LINES} AS line FROM events), f AS (SELECT *, string_split(line, ' ') AS f, regexp_matches(line, '^(set|add|append|prepend) \S+ \d+ -?\d+ \d+$') AS st, regexp_matches(line, '^(get|gets)( \S+)+$') AS rd FROM l) SELECT event_id, f[1] AS verb, CASE WHEN st THEN f[2] WHEN rd THEN array_to_string(f[2:], ',') END AS keys, CASE WHEN st THEN f[3]::bigint END AS flags, CASE WHEN st THEN f[4]::int END AS exptime, CASE WHEN st THEN f[5]::bigint END AS bytes, CASE WHEN NOT (st OR rd OR line = 'stats') THEN 'ERROR' WHEN f[1] IN ('prepend', 'gets') THEN 'Unsupported command' END AS error FROM f")
def command_parse(spark, d):
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    line = F.when(k == 0, F.concat(F.lit("set k"), u, F.lit(" 0 60 "), F.length(e).cast("string"))).when(k == 1, F.concat(F.lit("get k"), u, F.lit(" k"), e)).when(k == 2, F.concat(F.lit("prepend k"), u, F.lit(" 1 -1 3"))).when(k == 3, F.lit("stats")).otherwise(F.concat(F.lit("incr k"), u, F.lit(" 5")))
    p = K.parsed(F.col("line"))
    rows = table(spark, d, "events").select("event_id", line.alias("line")).select("event_id", *(c.alias(n) for n, c in p.items()))
    return rows.withColumn("keys", F.when(F.col("keys").isNotNull(), F.array_join("keys", ",")))


@query("WITH l AS (SELECT event_type AS shard, user_id::varchar AS key, max(event_id) AS seq FROM events GROUP BY ALL), r AS (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY seq DESC) AS k FROM l) SELECT shard, key FROM r WHERE k * 40 <= 1024")
def cache_uniform(spark, d):
    """Each event type is a cache; every entry has 40 bytes."""
    t = table(spark, d, "events").select(F.col("event_type").alias("shard"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"))
    return K.uniform_cache(t, 40, 1024)


@query()
def cache_simulated(spark, d):
    """Each user is a cache; keys are event types, sizes differ."""
    verb = F.when(F.col("event_id") % 4 == 0, "get").otherwise("set")
    c = table(spark, d, "events").select(F.col("user_id").alias("shard"), F.col("event_id").alias("seq"), verb.alias("op"), F.col("event_type").alias("key"), F.repeat(F.lit("x"), (F.col("event_id") % 300).cast("int")).alias("body"))
    return K.cache(c).select("shard", "key", F.length("value").alias("size"), "place")


@query(BASE + "SELECT key, value FROM f")
def command_stream(spark, d):
    """The fold as a stream: events arrive, state is kept by key, and the last value of each key is what stays."""
    from tidewright.streaming import commands as stream

    return stream.fold_once(commands, spark, d)


def reads(spark, d):
    """conn, seq, data: an event is a command of one of 16 connections on its user's key. A read holds the second half of the connection's last command and the first half of the next."""
    e = table(spark, d, "events").where("event_id is not null and user_id is not null")
    u, body = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    verb = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in VERBS.items()))
    stores = F.concat(verb, F.lit(" k"), u, F.lit(" 0 60 "), F.length(body).cast("string"), F.lit("\r\n"), body, F.lit("\r\n"))
    asks = F.concat(F.lit("get k"), u, F.lit(" k"), (F.col("user_id") + 1).cast("string"), F.lit("\r\n"))
    text = F.when(F.col("event_id") % 3 == 0, asks).when(verb == "delete", F.concat(F.lit("delete k"), u, F.lit("\r\n"))).otherwise(stores)
    c = e.select((F.pmod("user_id", F.lit(16))).cast("string").alias("conn"), F.col("event_id").alias("seq"), text.alias("text"))
    w = Window.partitionBy("conn").orderBy("seq")
    half = F.floor(F.length("text") / 2).cast("int")
    c = c.select("conn", "seq", F.substring("text", F.lit(1), half).alias("head"), F.substring("text", half + 1, F.length("text")).alias("tail"))
    data = F.concat(F.coalesce(F.lag("tail").over(w), F.lit("")), F.col("head"), F.when(F.lead("seq").over(w).isNull(), F.col("tail")).otherwise(""))
    return c.select("conn", "seq", data.alias("data"))


_PARTS = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VERBS.items()) + " END"


@query(f"""WITH e AS (SELECT event_id, user_id, user_id % 16 AS conn, CASE WHEN event_id % 3 = 0 THEN 'get' ELSE {_PARTS} END AS op, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1 AS n FROM events),
x AS (SELECT *, coalesce(lead(event_id) OVER (PARTITION BY conn ORDER BY event_id), event_id) AS seq FROM e),
c AS (SELECT conn, n, seq, op, user_id AS key, 0 AS pos, event_id::varchar AS body FROM x UNION ALL SELECT conn, n, seq, op, user_id + 1, 1, NULL FROM x WHERE op = 'get'),
a AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('set', 'add') THEN true WHEN op = 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq, n, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS present FROM c),
g AS (SELECT *, sum(CASE WHEN op = 'set' OR op = 'add' AND NOT present OR op = 'replace' AND present OR op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq, n, pos ROWS UNBOUNDED PRECEDING) AS era FROM a),
v AS (SELECT *, string_agg(CASE WHEN op = 'set' OR op = 'add' AND NOT present OR op IN ('replace', 'append') AND present THEN body END, '') OVER (PARTITION BY key, era ORDER BY seq, n, pos ROWS UNBOUNDED PRECEDING) AS value FROM g),
t AS (SELECT conn, n, op, pos, CASE op WHEN 'set' THEN 'STORED' WHEN 'add' THEN CASE WHEN present THEN 'NOT_STORED' ELSE 'STORED' END WHEN 'delete' THEN CASE WHEN present THEN 'DELETED' ELSE 'NOT_FOUND' END
  WHEN 'get' THEN CASE WHEN present THEN 'VALUE k' || key || ' 0 ' || length(value) || chr(13) || chr(10) || value || chr(13) || chr(10) ELSE '' END ELSE CASE WHEN present THEN 'STORED' ELSE 'NOT_STORED' END END AS text FROM v)
SELECT conn::varchar AS conn, n, string_agg(text, '' ORDER BY pos) || CASE WHEN op = 'get' THEN 'END' ELSE '' END || chr(13) || chr(10) AS reply FROM t GROUP BY conn, n, op""")
def reply_stream(spark, d):
    """What each connection is answered, by chained stateful operators that stop and go on twice. A command arrives with the read that completes it."""
    from tidewright.streaming import replies

    return replies.answer(reads(spark, d))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total FROM events WHERE event_id IS NOT NULL GROUP BY event_type""")
def log_stream(spark, d):
    """Events as JSON lines of a log that grows, read by a stream that stops and goes on from its offsets: sums of what came through."""
    from tidewright.operators.control import shared_folder
    from tidewright.sources import linelog

    e = table(spark, d, "events").where("event_id is not null").select("event_id", "event_type", F.col("value").cast("string").alias("value"))
    cut = e.agg(F.percentile("event_id", 0.5)).first()[0] or 0
    place = shared_folder(spark, "log")
    for k, part in enumerate((e.where(F.col("event_id") <= cut), e.where(F.col("event_id") > cut))):
        part.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{place}/in/{k}")
        stream = linelog.stream(spark, f"{place}/in")
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    came = spark.read.schema(linelog.SCHEMA).parquet(f"{place}/out").select(F.from_json("value", "event_id long, event_type string, value string").alias("e")).select("e.*")
    return came.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))
