"""What a key-value server answers on each connection, as three chained stateful operators.

reads (conn, seq, data) are what arrives, in order of seq over all connections; a read may hold part of a command, or several. The first operator, by connection, completes commands
and numbers them. The second, by groups of keys, is the store: it applies what a batch brings in order of arrival, through the table of handlers, and answers each part of a command. The
third, by connection, holds answers back until all parts of the next command are there, and emits replies in the order of the requests, each ending in CR LF.

As on a server, what counts between connections is arrival: batch by batch, and by seq within a batch. Rows without conn or data are left out; an unknown verb, a malformed line and a verb that
is parsed but not supported are answered by an error and the connection goes on. State is kept by RocksDB: see state_by_rocksdb(). A call for it costs about as much as ten rows, so rows come as
frames, and a batch reads and writes each key's value once.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from tidewright.operators.control import saved, shared_folder
from tidewright.streaming.commands import END, complete

OUT = "conn string, n long, reply string"
PARTS = "conn string, n long, at long, pos int, of int, place string, verb string, key string, body string"
ANSWERS = "conn string, n long, pos int, of int, verb string, text string"
#: Rows of a frame that an operator emits.
FRAME = 10_000


class Store(Protocol):
    """Where values of keys are."""

    def get(self, key: str) -> str | None: ...
    def put(self, key: str, value: str) -> None: ...
    def delete(self, key: str) -> bool: ...


class Held:
    """The store of one process."""

    def __init__(self):
        self.values: dict[str, str] = {}

    def get(self, key: str) -> str | None:
        return self.values.get(key)

    def put(self, key: str, value: str) -> None:
        self.values[key] = value

    def delete(self, key: str) -> bool:
        return self.values.pop(key, None) is not None


def stored(store: Store, key: str, body: str, when: Callable[[str | None], bool], value: Callable[[str | None], str]) -> str:
    old = store.get(key)
    if not when(old):
        return "NOT_STORED"
    store.put(key, value(old))
    return "STORED"


def block(store: Store, key: str, body: str) -> str:
    """A key's part of the answer to get: nothing where it isn't there."""
    value = store.get(key)
    return "" if value is None else f"VALUE {key} 0 {len(value.encode())}{END}{value}{END}"


#: What each verb does to a key, and its answer or part of one.
HANDLERS: dict[str, Callable[[Store, str, str], str]] = {
    "set": lambda store, key, body: stored(store, key, body, lambda old: True, lambda old: body),
    "add": lambda store, key, body: stored(store, key, body, lambda old: old is None, lambda old: body),
    "replace": lambda store, key, body: stored(store, key, body, lambda old: old is not None, lambda old: body),
    "append": lambda store, key, body: stored(store, key, body, lambda old: old is not None, lambda old: old + body),
    "delete": lambda store, key, body: "DELETED" if store.delete(key) else "NOT_FOUND",
    "get": block,
}


def parts(verb: str, args: list[str], body: str | None, error: str | None) -> list[tuple[str, str | None, str | None]]:
    """verb, key and body of each part of a command. A part without key is answered as it is: by its body."""
    if error or verb in ("stats", "get") and not args:
        return [("say", None, error or "END")]
    if verb == "stats":
        return [("say", None, "END")]
    if verb not in HANDLERS:
        return [("say", None, "ERROR Unsupported command")]
    return [(verb, key, body) for key in (args if verb == "get" else args[:1])] or [("say", None, "CLIENT_ERROR")]


def reply(verb: str, texts: list[str]) -> str:
    return "".join(texts) + ("END" if verb == "get" else "") + END


def served(chunks: list[tuple[str, int, str]], store: Store | None = None) -> dict[str, list[str]]:
    """The replies of each connection by one loop over all reads: what the stream must give."""
    store, rest, out = store or Held(), {}, {}
    for conn, _, data in sorted(chunks, key=lambda c: c[1]):
        found, rest[conn] = complete(rest.get(conn, "") + data)
        for command in found:
            own = parts(*command)
            out.setdefault(conn, []).append(reply(own[0][0], [body if key is None else HANDLERS[verb](store, key, body) for verb, key, body in own]))
    return out


def framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == FRAME:
            yield pd.DataFrame(some, columns=columns)
            some = []
    yield pd.DataFrame(some, columns=columns)


class Commands(StatefulProcessor):
    """By connection: what its bytes complete."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest string, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from framed(self.found(key[0], pd.concat(rows).sort_values("seq", kind="stable")), ["conn", "n", "at", "pos", "of", "place", "verb", "key", "body"])

    def found(self, conn: str, frame: pd.DataFrame) -> Iterator[tuple]:
        rest, n = self.rest.get() if self.rest.exists() else ("", 0)
        for seq, data in zip(frame["seq"], frame["data"], strict=True):
            found, rest = complete(rest + data)
            for verb, args, body, error in found:
                own = parts(verb, args, body, error)
                for pos, (does, name, text) in enumerate(own):
                    place = f"-{conn}" if name is None else f"={name}"  # what needs no key goes by its connection
                    yield conn, n, seq, pos, len(own), place, does, name, text
                n += 1
        self.rest.update((rest, n))

    def close(self) -> None:
        pass


class Loaded(Held):
    """The store that handlers see during a batch: values are read from state when they are first asked for, and those that changed go back at the end."""

    def __init__(self, state: MapState):
        super().__init__()
        self.state, self.before = state, {}

    def load(self, key: str) -> None:
        if key not in self.before:
            found = self.state.getValue((key,))
            self.before[key] = None if found is None else found[0]
            if found is not None:
                self.values[key] = found[0]

    def get(self, key: str) -> str | None:
        self.load(key)
        return super().get(key)

    def put(self, key: str, value: str) -> None:
        self.load(key)
        super().put(key, value)

    def delete(self, key: str) -> bool:
        self.load(key)
        return super().delete(key)

    def save(self) -> None:
        for key, old in self.before.items():
            new = self.values.get(key)
            if new is None and old is not None:
                self.state.removeKey((key,))
            elif new != old:
                self.state.updateValue((key,), (new,))


class Keys(StatefulProcessor):
    """By groups of keys: their values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "key string", "value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame, store = pd.concat(rows).sort_values(["at", "n", "pos"]), Loaded(self.values)
        texts = [body if verb == "say" else HANDLERS[verb](store, name, body) for verb, name, body in zip(frame["verb"], frame["key"], frame["body"], strict=True)]
        store.save()
        yield frame[["conn", "n", "pos", "of", "verb"]].assign(text=texts)

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """By connection: answers wait until theirs is the next reply and all its parts are there. Beside the next one's number is how many wait: as a rule none, and then none is looked for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "n long, held long")
        self.waiting = handle.getMapState("waiting", "n long", "parts string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from framed(((key[0], n, text) for n, text in self.given(pd.concat(rows).sort_values(["n", "pos"]))), ["conn", "n", "reply"])

    def given(self, frame: pd.DataFrame) -> Iterator[tuple[int, str]]:
        n, held = self.next.get() if self.next.exists() else (0, 0)
        for k, own in groupby(zip(*(frame[c].tolist() for c in ("n", "pos", "of", "verb", "text")), strict=True), key=lambda r: r[0]):
            got = [r[1:] for r in own]
            if held and (before := self.taken(k)):
                got, held = got + before, held - 1
            while k == n and got and len(got) == got[0][1]:
                yield n, reply(got[0][2], [text for _, _, _, text in sorted(got)])
                k, n = n + 1, n + 1
                got = self.taken(n) if held else []  # what waited for this one
                held -= bool(got)
            if got:
                self.waiting.updateValue((k,), (json.dumps(got),))
                held += 1
        self.next.update((n, held))

    def taken(self, n: int) -> list[tuple[int, int, str, str]]:
        """The parts that wait for the n-th reply, which do so no more."""
        found = self.waiting.getValue((n,))
        if found is None:
            return []
        self.waiting.removeKey((n,))
        return [tuple(x) for x in json.loads(found[0])]

    def close(self) -> None:
        pass


def replies(reads: DataFrame, groups: int = 64) -> DataFrame:
    """A stream of reads (conn, seq, data) to a stream of conn, n (from 0) and reply; the store's keys are in so many groups, as long as the stream lives."""
    known = reads.where("conn is not null and data is not null").select("conn", "seq", "data")
    found = known.groupBy("conn").transformWithStateInPandas(Commands(), PARTS, "Append", "None")
    dealt = found.withColumn("place", F.pmod(F.xxhash64("place"), F.lit(groups)))
    answers = dealt.groupBy("place").transformWithStateInPandas(Keys(), ANSWERS, "Append", "None")
    return answers.groupBy("conn").transformWithStateInPandas(InOrder(), OUT, "Append", "None")


@contextlib.contextmanager
def state_by_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that start inside keep their state as transformWithState needs it, in so many partitions if given. Each partition of each operator is a database of some 4 MB at least; those of a stream
    that has stopped go at the next maintenance."""
    set_to = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.maintenanceInterval": "5s"}
    if partitions:
        set_to["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in set_to}
    for name, value in set_to.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def answer(reads: DataFrame, starts: int = 3, part_rows: int = 25_000, most_rows: int = 200_000) -> DataFrame:
    """The replies to the reads (conn, seq, data) of a table, which reach the stream in about so many equal pieces, by seq; the stream stops after each and goes on from its checkpoint. State has a partition
    for about part_rows reads or, beyond two for each core, for most_rows, as a stream keeps its number of partitions and each costs a task of each operator in each piece. Runs the stream."""
    spark = reads.sparkSession
    place = shared_folder(spark, "replies")
    reads = saved(reads)
    n, cuts = reads.agg(F.count("*"), F.percentile_approx("seq", [k / starts for k in range(1, starts)], 1000) if starts > 1 else F.lit(None)).first()
    piece = sum(((F.col("seq") > c).cast("int") for c in cuts or []), F.lit(0))
    partitions = max(2, min(-(-n // part_rows), 2 * spark.sparkContext.defaultParallelism), -(-n // most_rows))
    with state_by_rocksdb(spark, partitions):
        for k in range(starts):
            reads.where(piece == k).write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(reads.schema).parquet(f"{place}/in")
            run = replies(stream, 8 * partitions).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{place}/out")
