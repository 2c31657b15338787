"""Rolling distinct users against a count of every window."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest

from tidewright.llm import queries, rolling

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, minute string, n int"  # extra columns clash with inner names


def brute(rows, windows, hot):
    one = {}
    for k, (i, ts, user, kind, *_) in enumerate(rows):
        if ts is not None and kind is not None:
            click = (kind, int((ts - datetime(1970, 1, 1)) // timedelta(minutes=1)), user)
            key = ("none", k) if i is None else i
            one[key] = min(one.get(key, click), click, key=lambda c: (c[0], c[1], c[2] is not None, c[2] or 0))
    by = defaultdict(list)
    for kind, minute, user in one.values():
        by[kind].append((minute, user))
    out = []
    for kind, clicks in by.items():
        for m in {c[0] for c in clicks}:
            inside = {n: [u for t, u in clicks if m - length < t <= m and u is not None] for n, length in windows.items()}
            longest = inside[max(windows, key=windows.get)]
            out.append((kind, m, *(len(set(inside[n])) for n in windows), len({u for u in longest if longest.count(u) >= hot})))
    return sorted(out)


def clicks(seed, n, minutes, users, start=datetime(2024, 1, 1)):
    rng, rows = random.Random(seed), []
    for k in range(n):
        ts = start + timedelta(minutes=rng.randrange(minutes), seconds=rng.randrange(60), microseconds=rng.randrange(1_000_000))
        user = None if rng.random() < 0.05 else 0 if rng.random() < 0.33 else rng.randrange(users)
        rows.append((k, None if rng.random() < 0.03 else ts, user, rng.choice(["a", "b", "b", None]), "x", 1))
    rows += rng.sample(rows, n // 10)
    rows += [(None, *r[1:]) for r in rng.sample(rows, 5)] * 2  # each without an id is a click of its own
    return rows


@pytest.mark.parametrize(("seed", "n", "minutes", "users", "windows", "hot", "span", "start"), [
    (1, 400, 300, 5, {"short": 3, "middle": 10, "long": 40}, 2, 40, datetime(2024, 1, 1)),
    (2, 400, 200, 3, {"short": 1, "middle": 7, "long": 30}, 3, 64, datetime(1969, 12, 31, 22)),
    (3, 300, 60, 2, {"one": 1}, 1, 7, datetime(2024, 2, 29, 23, 59)),
    (4, 300, 5000, 40, {"a": 15, "b": 180, "c": 1440}, 2, rolling.SPAN, datetime(2024, 1, 3)),
])
def test_against_every_window(spark, seed, n, minutes, users, windows, hot, span, start):
    rows = clicks(seed, n, minutes, users, start)
    got = rolling.distinct_users(spark.createDataFrame(rows, SCHEMA), windows, hot, span)
    assert got.columns == ["kind", "minute", *(f"users_{w}" for w in windows), "hot_users"]
    assert sorted(map(tuple, got.collect())) == brute(rows, windows, hot)


def test_empty_and_only_broken_rows(spark):
    for rows in ([], [(1, None, 2, "a", "", 1), (2, datetime(2024, 1, 1), 2, None, "", 1)]):
        assert rolling.distinct_users(spark.createDataFrame(rows, SCHEMA), {"long": 5}).count() == 0


def test_times_with_a_zone_and_another_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(1, datetime(2024, 3, 10, 2, 30), 1, "a", "", 1)], SCHEMA)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # has no such time
        assert rolling.distinct_users(df, {"long": 5}).first().minute == (datetime(2024, 3, 10, 2, 30) - datetime(1970, 1, 1)) // timedelta(minutes=1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    aware = df.selectExpr("click_id", "cast(ts as timestamp) ts", "client_id", "kind")
    assert rolling.distinct_users(aware, {"long": 5}).collect() == rolling.distinct_users(df, {"long": 5}).collect()


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view clicks as select * from '{d}/clicks.parquet'")
    want = con.execute(f"select kind, minute, users_short, users_middle, users_long, hot_users from ({queries.ORACLES['op13_rolling_users']}) order by all").fetchall()
    got = queries.QUERIES["op13_rolling_users"](spark, d)
    assert all(t == "bigint" for c, t in got.dtypes if c != "kind")
    assert sorted(map(tuple, got.collect())) == want
