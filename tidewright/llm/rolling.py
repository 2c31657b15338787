"""Distinct users over trailing windows, as vertices minus edges.

Within a kind, a user's active minutes are vertices, and two that follow each other are an edge. A window that holds c > 0 active minutes of a user holds c - 1 of
the user's edges whole, so vertices less edges count the user once. Likewise, of a user with at least h clicks in a window, runs of h clicks less runs
of h + 1 clicks leave one. What starts at minute a and ends at b lies wholly in the windows of L minutes that end at b to a + L - 1: so each count is a running sum
of +1 at b and -1 at a + L.

Minutes are dealt into spans of `SPAN` minutes, at least as long as the longest window. A user's rows meet by (kind, user, span): at most SPAN minutes, and those at
the end of the span before, of which what starts there may still lie in a window. What is still in a window as a span ends is entered again at the next one's
first minute, so running sums begin anew with each span and need nothing from before. No task holds a user, a kind or the whole time.

Clicks without a minute or kind take no part; of rows of one click_id that differ, the least by (kind, minute, user) counts, and a row without click_id is a click by
itself. A click without user counts for no one, but its kind and minute have a row. Repeated rows, ties and an empty table need nothing special. Minutes before 1970 are
negative. Other columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes of a span, about; what a window has from the span before is read twice.
SPAN = 2 * 1440
#: Days from 0001-01-01 to 1970-01-01.
DAYS = 719_162


def minute_of(df: DataFrame, column: str) -> Column:
    """Whole minutes since 1970. A time without a zone is taken as UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.expr(f"(unix_micros(`{column}`) - pmod(unix_micros(`{column}`), 60000000)) div 60000000")
    since = f"(CAST(`{column}` AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ '0001-01-01 00:00:00')"  # never negative, so its parts needn't be rounded
    return F.expr(f"(CAST(extract(DAY FROM {since}) AS BIGINT) - {DAYS}) * 1440 + extract(HOUR FROM {since}) * 60 + extract(MINUTE FROM {since})").cast("long")


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """kind, minute and user of each click."""
    rows = clicks.select(F.col("click_id").alias("id"), F.col("kind").cast("string").alias("kind"), minute_of(clicks, "ts").alias("minute"), F.col("client_id").cast("long").alias("user")).where("kind is not null and minute is not null")
    one = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("kind", "minute", "user")).alias("click")).select("click.*")
    return one.unionByName(rows.where("id is null").drop("id"))


def count(holds: Column) -> Column:
    return F.coalesce(holds, F.lit(False)).cast("long")


def entered(kept: DataFrame, windows: dict[str, int], hot: int, span: int) -> DataFrame:
    """What users' rows enter at each kind and minute: on_<name> counts from there, off_<name> a window's length later."""
    long, names = max(windows.values()), [*windows, "hot"]
    home = F.floor(F.col("minute") / span).cast("long")
    spans = F.when(F.pmod("minute", F.lit(span)) > span - long, F.array(home, home + 1)).otherwise(F.array(home))  # the next span may still need it
    # more than `hot` clicks in one minute make no run of other ends
    clicks = kept.where("user is not null").select("kind", "user", "minute", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(hot)).cast("int"))).alias("k")).withColumn("span", F.explode(spans))
    order = Window.partitionBy("kind", "user", "span").orderBy("minute", "k")
    runs = {"before": 1, "first": hot - 1, "outer": hot}
    own = clicks.select("kind", "span", "minute", "k", *(F.lag("minute", n).over(order).alias(name) if n else F.col("minute").alias(name) for name, n in runs.items())).where(F.col("span") == home)

    t, before, first, outer, end = F.col("minute"), F.col("before"), F.col("first"), F.col("outer"), (F.col("span") + 1) * span
    vertex, run, longer = F.col("k") == 1, t - F.col("first") < long, t - F.col("outer") < long
    edge = {n: vertex & (t - before < length) for n, length in windows.items()}

    def entry(at: Column, clicks: int = 0, **values: Column) -> Column:
        cells = (values.get(f"{side}_{n}", F.lit(0).cast("long")).alias(f"{side}_{n}") for side in ("on", "off") for n in names)
        return F.struct(at.alias("minute"), F.lit(clicks).cast("long").alias("clicks"), *cells)

    here = {f"on_{n}": count(vertex) - count(edge[n]) for n in windows} | {f"off_{n}": -count(vertex) for n in windows} | {"on_hot": count(run) - count(longer)}
    over = {f"on_{n}": count(vertex & (t + length >= end)) - count(edge[n] & (before + length >= end)) for n, length in windows.items()}
    over["on_hot"] = count(run & (first + long >= end)) - count(longer & (outer + long >= end))
    entries = F.array(
        entry(t, 1, **here),
        F.when(vertex & (t - before < long), entry(before, **{f"off_{n}": count(edge[n]) for n in windows})),
        F.when(run, entry(first, off_hot=-count(run))),
        F.when(longer, entry(outer, off_hot=count(longer))),
        F.when(t + long >= end, entry(end, **over)),  # still in a window as the span ends
    )
    return own.select("kind", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("kind", "e.*")


def distinct_users(clicks: DataFrame, windows: dict[str, int], hot: int = 2, span: int = SPAN) -> DataFrame:
    """A row for each kind and minute with a click: users_<name> for each of windows (name: minutes), hot_users (at least `hot` clicks in the longest window)."""
    long = max(windows.values())
    span = max(span, long)
    kept = distinct_clicks(clicks).groupBy("kind", "user", "minute").agg(F.count("*").alias("n"))
    names = [*windows, "hot"]
    zeros = [F.lit(0).cast("long").alias(f"{side}_{n}") for side in ("on", "off") for n in names]
    nobody = kept.where("user is null").select("kind", "minute", F.lit(1).cast("long").alias("clicks"), *zeros)
    sums = entered(kept, windows, hot, span).unionByName(nobody).groupBy("kind", "minute").agg(F.sum("clicks").alias("clicks"), *(F.sum(f"{side}_{n}").alias(f"{side}_{n}") for side in ("on", "off") for n in names))
    lengths = windows | {"hot": long}
    steps = [F.struct(F.col("minute").alias("minute"), F.col("clicks").alias("clicks"), *(F.col(f"on_{n}").alias(n) for n in names))]
    for length in sorted(set(lengths.values())):
        steps.append(F.struct((F.col("minute") + length).alias("minute"), F.lit(0).cast("long").alias("clicks"), *((F.col(f"off_{n}") if lengths[n] == length else F.lit(0).cast("long")).alias(n) for n in names)))
    deltas = sums.select("kind", F.explode(F.array(*steps)).alias("e")).select("kind", "e.*").groupBy("kind", "minute").agg(F.sum("clicks").alias("clicks"), *(F.sum(n).alias(n) for n in names))
    running = Window.partitionBy("kind", F.floor(F.col("minute") / span)).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    counted = deltas.select("kind", "minute", "clicks", *(F.sum(n).over(running).alias(f"users_{n}" if n != "hot" else "hot_users") for n in names))
    return counted.where("clicks > 0").drop("clicks")
