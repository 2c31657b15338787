"""Command logs as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.control import saved

OUT = "key string, seq long, reply string, value string"
COMMANDS = "conn string, n long, verb string, args array<string>, body string, error string"
#: Verbs of the protocol that carry a body, and the others.
STORING, PLAIN = ("set", "add", "append", "prepend", "replace"), ("get", "gets", "stats", "delete")
END = "\r\n"


def applied(value: str | None, op: str, body: str) -> tuple[str | None, str]:
    """A key's value after a command, and the reply."""
    if op == "set" or op == "add" and value is None or op == "replace" and value is not None:
        return body, "STORED"
    if op == "append" and value is not None:
        return value + body, "STORED"
    if op == "delete":
        return None, "NOT_FOUND" if value is None else "DELETED"
    if op == "get":
        return value, "END" if value is None else "VALUE"
    return value, "NOT_STORED"


def complete(buffer: str) -> tuple[list[tuple], str]:
    """The commands (verb, args, body, error) that a connection's bytes hold so far, and what is left of them. A body that lacks its end, or a line, waits for more."""
    out, at = [], 0
    while (stop := buffer.find(END, at)) >= 0:
        verb, *args = buffer[at:stop].split(" ")
        after, body, error = stop + len(END), None, None
        if verb in STORING:
            if len(args) != 4 or not args[3].isdigit():
                error = "CLIENT_ERROR"
            else:
                close = after + int(args[3])
                if len(buffer) < close + len(END):
                    break
                body, after = buffer[after:close], close + len(END)
                error = None if buffer[close:after] == END else "CLIENT_ERROR"
        elif verb not in PLAIN:
            error = "ERROR"
        out.append((verb, args, body, error))
        at = after
    return out, buffer[at:]


def read_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rest, n = state.get if state.exists else ("", 0)
    rows = []
    for data in pd.concat(frames).sort_values("seq")["data"]:
        found, rest = complete(rest + data)
        for command in found:
            rows.append((key[0], n, *command))
            n += 1
    state.update((rest, n))
    yield pd.DataFrame(rows, columns=["conn", "n", "verb", "args", "body", "error"])


def parsed_reads(reads: DataFrame) -> DataFrame:
    """A stream of partial reads (conn, seq, data) to the commands they complete, numbered by connection: several in a read, or one over several reads and batches."""
    return reads.groupBy("conn").applyInPandasWithState(read_on, COMMANDS, "rest string, n long", "append", GroupStateTimeout.NoTimeout)


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, last = state.get if state.exists else (None, None)
    frame = pd.concat(frames).sort_values("seq")
    if last is not None and len(frame) and frame["seq"].iloc[0] < last:
        raise ValueError(f"a command of {key[0]} came after a later one was applied")
    rows = []
    for seq, op, body in frame[["seq", "op", "body"]].itertuples(index=False):
        value, reply = applied(value, op, body)
        rows.append((key[0], seq, reply, value))
    state.update((value, int(frame["seq"].iloc[-1]) if len(frame) else last))
    yield pd.DataFrame(rows, columns=["key", "seq", "reply", "value"])


def replies(commands: DataFrame) -> DataFrame:
    """A stream of commands (key, seq, op, body) to a stream of replies and values; commands of a batch apply in order of seq. A key's commands must come in order
    from batch to batch: one that is late fails the stream, as no fold would be right."""
    return commands.groupBy("key").applyInPandasWithState(step, OUT, "value string, last long", "append", GroupStateTimeout.NoTimeout)


def corrected(lines: DataFrame, correct) -> DataFrame:
    """A stream of lines (value) through a column function."""
    return lines.select("value", correct(F.col("value")).alias("fixed"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP source, for development."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("text").load(path)


def fold_once(commands_of, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the events that are there now through the stream and returns key, value of what is left. Checkpoints and results go to the shared folder."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        saved(spark.range(1))
        base = spark.sparkContext.getCheckpointDir()
    place = f"{base}/stream-{uuid.uuid4().hex}"

    class Reader:  # the table read as a stream, for the query's own table function
        class read:  # noqa: N801
            @staticmethod
            def parquet(path: str) -> DataFrame:
                return spark.readStream.schema(source.schema).parquet(f"{place}/in")

    source.write.parquet(f"{place}/in")
    stream = replies(commands_of(Reader, sf_dir))
    run = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.schema(OUT).parquet(f"{place}/out")
    return done.groupBy("key").agg(F.max_by(F.struct("value"), "seq").getField("value").alias("value")).where("value is not null")
