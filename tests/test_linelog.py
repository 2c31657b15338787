"""Line logs: every line once, whatever the ranges, batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.sources import linelog as L


def run(spark, folder, state, range_bytes=50):
    stream = L.stream(spark, f"{folder}/log", range_bytes)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/{state}").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_ranges_deal_every_line_once(tmp_path, monkeypatch, size):
    rng = random.Random(3)
    for piece in (4, 1 << 20):
        monkeypatch.setattr(L, "PIECE", piece)
        for ends in ("\n", ""):
            rows = ["", "a", "é", "x" * 90, "", *("y" * rng.randrange(12) for _ in range(30)), "last"]
            (tmp_path / "s").write_bytes(("\n".join(rows) + ends).encode())
            total = (tmp_path / "s").stat().st_size
            got = [x for k in range(0, total, size) for x in L.lines(str(tmp_path), L.Range("s", k, min(k + size, total)))]
            assert [v.decode() for _, v in got] == rows
            body = (tmp_path / "s").read_bytes()
            assert all(body[a : a + len(v)] == v and (a == 0 or body[a - 1 : a] == b"\n") for a, v in got)
            assert L.whole_lines(str(tmp_path), "s", total) == (total if ends else body.rfind(b"\n") + 1)


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    log, want = tmp_path / "log", []
    log.mkdir()

    def more(name, text):
        (log / name).parent.mkdir(exist_ok=True)
        with open(log / name, "a", newline="") as f:
            f.write(text)

    def check():
        got = spark.read.schema(L.SCHEMA).parquet(f"file://{tmp_path}/out").orderBy("segment", "at").collect()
        assert [(r.segment, r.value) for r in got] == want

    more("a1", "one\ntwo\nthr")
    run(spark, tmp_path, "state")
    want += [("a1", "one"), ("a1", "two")]
    check()
    run(spark, tmp_path, "state")  # nothing new
    check()
    more("a1", "ee\n" + "x" * 120 + "\nend")
    more("a2", "\n\nfour\nfi")  # the first segment is closed: its last line needs no end
    more("_not", "hidden\n")
    run(spark, tmp_path, "state")
    want += [("a1", "three"), ("a1", "x" * 120), ("a1", "end"), ("a2", ""), ("a2", ""), ("a2", "four")]
    check()
    more("a2", "ve\n")
    more("b/0", "six\n")
    run(spark, tmp_path, "state")
    want += [("a2", "five"), ("b/0", "six")]
    check()


def test_a_batch_that_fails_is_read_again_whole(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a").write_text("".join(f"line {k}\n" for k in range(500)))
    seen = {}

    def sink(fails):
        def put(df, batch):
            rows = sorted((r.at, r.value) for r in df.collect())
            if fails:
                raise RuntimeError("lost")
            seen.setdefault(batch, []).append(rows)

        return put

    def start(fails):
        q = L.stream(spark, str(log), 64).writeStream.foreachBatch(sink(fails)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        start(True)
    with open(log / "a", "a") as f:  # what came meanwhile isn't in the batch that is read again
        f.write("late\n")
    start(False)
    assert [v for _, v in seen[0][0]] == [f"line {k}" for k in range(500)]
    assert [v for rows in seen.values() for r in rows for _, v in r].count("late") == (1 if len(seen) > 1 else 0)
    start(False)
    every = [v for rows in seen.values() for r in rows for _, v in r]
    assert every == [*(f"line {k}" for k in range(500)), "late"]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "log").mkdir()
    run(spark, tmp_path, "state")
    assert spark.read.schema(L.SCHEMA).parquet(f"file://{tmp_path}/out").agg(F.count("*")).first()[0] == 0
