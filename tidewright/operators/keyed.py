"""Ordered commands over keyed state. Commands: (key, seq, op, body); op is set, add, append, prepend, replace, delete or get."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verbs of the text protocol that are understood, and those that are parsed but refused.
STORES, READS, REFUSED = ("set", "add", "append"), ("get",), ("prepend", "gets")
WRITES = ("set", "add", "append", "replace", "delete")
LIMIT = 1024


def outcomes(commands: DataFrame) -> DataFrame:
    """Every command with present (the key is there before it), value (after it) and reply.

    Presence is settled by the last set, delete, or add before a command (an add always leaves the key there), so it is a window, not a
    loop. A value is what was last stored anew, with what was appended since: appended pieces are numbered by the store they follow.
    """
    w = Window.partitionBy("key").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    settles = F.when(F.col("op").isin("set", "add"), F.lit(True)).when(F.col("op") == "delete", F.lit(False))
    there = F.coalesce(F.last(settles, True).over(before), F.lit(False))
    c = commands.withColumn("present", there)
    anew = (F.col("op") == "set") | (F.col("op") == "add") & ~F.col("present") | (F.col("op") == "replace") & F.col("present") | (F.col("op") == "delete")
    c = c.withColumn("_era", F.sum(anew.cast("int")).over(upto))
    era = Window.partitionBy("key", "_era").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    adds = anew & (F.col("op") != "delete") | (F.col("op") == "append") & F.col("present")
    pieces = F.collect_list(F.when(adds, F.col("body"))).over(era)
    alive = F.when(F.col("op").isin("set", "add"), True).when(F.col("op") == "delete", False).otherwise(F.col("present"))
    c = c.withColumn("value", F.when(alive, F.array_join(pieces, "")))
    reply = F.when(F.col("op") == "set", "STORED").when(F.col("op") == "add", F.when(F.col("present"), "NOT_STORED").otherwise("STORED")).when(F.col("op").isin("append", "replace"), F.when(F.col("present"), "STORED").otherwise("NOT_STORED")).when(F.col("op") == "delete", F.when(F.col("present"), "DELETED").otherwise("NOT_FOUND")).otherwise(F.when(F.col("present"), "VALUE").otherwise("END"))
    return c.withColumn("reply", reply).drop("_era")


def final(commands: DataFrame) -> DataFrame:
    """key, value of the keys that are there in the end."""
    last = outcomes(commands).groupBy("key").agg(F.max_by(F.struct("value"), "seq").getField("value").alias("value"))
    return last.where("value is not null")


def multi_get(requests: DataFrame, store: DataFrame) -> DataFrame:
    """requests (id, keys) to id, reply: the blocks of the keys that are there, in order of the request, and END."""
    asked = requests.select("id", F.posexplode("keys").alias("pos", "key"))
    block = F.concat_ws(" ", F.lit("VALUE"), F.col("key"), F.lit("0"), F.octet_length("value").cast("string"))
    found = asked.join(store, "key").select("id", "pos", F.concat(block, F.lit("\r\n"), F.col("value"), F.lit("\r\n")).alias("text"))
    text = found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("blocks"))
    return requests.select("id").join(text, "id", "left").select("id", F.concat(F.coalesce("blocks", F.lit("")), F.lit("END")).alias("reply"))


def parsed(line: Column) -> dict[str, Column]:
    """Fields of a complete command line; error where it isn't one that is understood."""
    f = F.split(line, " ")
    verb = f[0]
    stores = line.rlike(r"^(set|add|append|prepend) \S+ \d+ -?\d+ \d+$")
    reads = line.rlike(r"^(get|gets)( \S+)+$")
    return {
        "verb": verb,
        "keys": F.when(stores, F.slice(f, 2, 1)).when(reads, F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))),
        "flags": F.when(stores, F.get(f, F.lit(2)).cast("long")),
        "exptime": F.when(stores, F.get(f, F.lit(3)).cast("int")),
        "bytes": F.when(stores, F.get(f, F.lit(4)).cast("long")),
        "error": F.when(~(stores | reads | (line == "stats")), "ERROR").when(verb.isin(*REFUSED), "Unsupported command"),
    }


def uniform_cache(touches: DataFrame, size: int, limit: int) -> DataFrame:
    """Keys that an LRU cache of limit bytes holds in the end, all entries of one size, after (shard, seq, key) puts and reads that hit."""
    last = touches.groupBy("shard", "key").agg(F.max("seq").alias("seq"))
    order = Window.partitionBy("shard").orderBy(F.desc("seq"))
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") * size <= limit).select("shard", "key")


def cache(commands: DataFrame, limit: int = LIMIT) -> DataFrame:
    """shard, key, value, place (0 is the most recent) of LRU caches of limit bytes after their commands. Recency is an order over all keys of a shard, so a shard is one group; there must be many."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict[str, str] = OrderedDict()
        used = 0
        for op, key, body in frame.sort_values("seq")[["op", "key", "body"]].itertuples(index=False):
            old = held.get(key)
            if op == "get":
                if old is not None:
                    held.move_to_end(key)
                continue
            if op == "delete":
                if old is not None:
                    used -= len(key.encode()) + len(held.pop(key).encode())
                continue
            if op == "add" and old is not None or op in ("append", "replace") and old is None:
                continue
            new = old + body if op == "append" else body
            room = len(key.encode()) + len(new.encode())
            if room > limit:
                continue
            if old is not None:
                used -= len(key.encode()) + len(held.pop(key).encode())
            while used + room > limit:
                k, v = held.popitem(last=False)
                used -= len(k.encode()) + len(v.encode())
            held[key] = new
            used += room
        shard = frame["shard"].iloc[0]
        return pd.DataFrame([(shard, k, v, i) for i, (k, v) in enumerate(reversed(held.items()))], columns=["shard", "key", "value", "place"])

    return commands.select("shard", "seq", "op", "key", "body").groupBy("shard").applyInPandas(run, "shard long, key string, value string, place long")
