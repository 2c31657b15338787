"""Replies by connection against one loop over all reads."""

import random

import pandas as pd
import pytest

from tidewright.plans import keyed
from tidewright.streaming import replies as R


def log(seed, conns=4, n=60):
    """Reads that cut commands anywhere, and what they hold."""
    rng, texts = random.Random(seed), {}
    for c in range(conns):
        out = []
        for _ in range(n):
            key, body = f"k{rng.randrange(5)}", rng.choice(["", "x", "line\r\nend", "é€", "z" * rng.randrange(30)])
            verb = rng.choice(["set", "add", "append", "replace", "prepend"])
            out.append(rng.choice([f"{verb} {key} 0 0 {len(body)}\r\n{body}\r\n"] * 4 + [f"get {key}\r\n", f"get {key} k9 k1\r\n", "stats\r\n", "fly\r\n", f"delete {key}\r\n", "gets k1\r\n", "get\r\n", "set k1 0 0 x\r\n"]))
        texts[f"c{c}"] = "".join(out)
    reads, seq = [], 0
    while any(texts.values()):
        conn = rng.choice([c for c, t in texts.items() if t])
        cut = rng.choice([1, 3, 7, 40, 200])
        reads.append((conn, seq, texts[conn][:cut]))
        texts[conn], seq = texts[conn][cut:], seq + 1
    return reads


def by_conn(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.n):
        assert r.n == len(out.setdefault(r.conn, []))
        out[r.conn].append(r.reply)
    return out


def test_one_loop_answers_as_the_protocol_says():
    text = "set a 0 0 5\r\nab\r\nc\r\nget a b\r\nfly\r\nappend a 0 0 1\r\n!\r\nadd a 0 0 1\r\nx\r\ndelete b\r\nget a\r\nstats\r\ngets a\r\n"
    assert R.served([("c", 0, text)]) == {"c": ["STORED\r\n", "VALUE a 0 5\r\nab\r\nc\r\nEND\r\n", "ERROR\r\n", "STORED\r\n", "NOT_STORED\r\n", "NOT_FOUND\r\n", "VALUE a 0 6\r\nab\r\nc!\r\nEND\r\n", "END\r\n", "ERROR Unsupported command\r\n"]}


def test_pipelined_reads_in_several_batches(spark):
    reads = log(1)
    df = spark.createDataFrame([*reads, (None, 5, "stats\r\n"), ("c0", 6, None)], "conn string, seq long, data string")
    got = by_conn(R.answer(df, 3).collect())
    assert got == R.served(reads) and sum(map(len, got.values())) > 200


def test_state_provider_is_left_as_it_was(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with R.state_by_rocksdb(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_query_against_the_loop(spark):
    d = "/root/testdata/sf0.001"
    reads = [(r.conn, r.seq, r.data) for r in keyed.reads(spark, d).collect()]
    assert by_conn(keyed.reply_stream(spark, d).collect()) == R.served(reads)


class Kept:
    """State of one group, which counts its calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValueState(self, name, schema):
        return One(self, name)

    def getMapState(self, name, key, value):
        return Many(self, name)


class One:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def exists(self):
        self.kept.calls += 1
        return self.name in self.kept.values

    def get(self):
        self.kept.calls += 1
        return self.kept.values.get(self.name)

    def update(self, value):
        self.kept.calls += 1
        self.kept.values[self.name] = value


class Many:
    def __init__(self, kept, name):
        self.kept, self.values = kept, kept.values.setdefault(name, {})

    def getValue(self, key):
        self.kept.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.kept.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.kept.calls += 1
        del self.values[key]


def test_a_batch_reads_and_writes_a_value_once():
    kept, keys = Kept(), R.Keys()
    keys.init(kept)
    rows = [("c", n, n, 0, 1, "append" if n else "set", "a", "x") for n in range(50)] + [("c", 50, 50, 0, 1, "set", "b", "y"), ("c", 51, 51, 0, 1, "delete", "b", None), ("c", 52, 52, 0, 1, "say", None, "END")]
    frame = pd.DataFrame(rows[::-1], columns=["conn", "n", "at", "pos", "of", "verb", "key", "body"])
    out = pd.concat(keys.handleInputRows((0,), iter([frame[:20], frame[20:]]), None)).set_index("n")["text"]
    assert list(out.sort_index()) == ["STORED"] * 51 + ["DELETED", "END"] and kept.values["values"] == {("a",): ("x" * 50,)} and kept.calls == 3
    again = pd.DataFrame([("c", 53, 53, 0, 2, "get", "a", None), ("c", 53, 53, 1, 2, "get", "b", None), ("c", 54, 54, 0, 1, "delete", "a", None)], columns=frame.columns)
    assert list(pd.concat(keys.handleInputRows((0,), iter([again]), None))["text"]) == [f"VALUE a 0 50\r\n{'x' * 50}\r\n", "", "DELETED"] and kept.values["values"] == {}


@pytest.mark.parametrize("seed", range(6))
def test_answers_out_of_order_wait(seed):
    rng = random.Random(seed)
    rows = [("c", n, pos, 3, "get", f"{n}.{pos};") if n % 2 else ("c", n, 0, 1, "set", "STORED") for n in range(40) for pos in range(3 if n % 2 else 1)]
    rng.shuffle(rows)
    kept, out = Kept(), []
    order = R.InOrder()
    order.init(kept)
    while rows:
        cut = rng.randrange(1, 12)
        frame, rows = pd.DataFrame(rows[:cut], columns=["conn", "n", "pos", "of", "verb", "text"]), rows[cut:]
        out += pd.concat(order.handleInputRows(("c",), iter([frame]), None)).values.tolist()
    assert out == [["c", n, f"{n}.0;{n}.1;{n}.2;END\r\n" if n % 2 else "STORED\r\n"] for n in range(40)]
    assert kept.values == {"next": (40, 0), "waiting": {}}


def test_answers_in_order_look_for_none_that_wait():
    kept, order = Kept(), R.InOrder()
    order.init(kept)
    frame = pd.DataFrame([("c", n, 0, 1, "set", "STORED") for n in range(100)], columns=["conn", "n", "pos", "of", "verb", "text"])
    assert len(pd.concat(order.handleInputRows(("c",), iter([frame]), None))) == 100 and kept.calls < 5
