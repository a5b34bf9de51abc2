"""Streams over several micro-batches: order, late rows, repeats and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from finegrid.session import scratch_path
from finegrid.streaming import streams as St


def in_files(spark, rows, schema, number="n"):
    df = spark.createDataFrame(rows, schema)
    path = St.files_in_order(df, F.col(number))
    return St.read_stream(spark, path, "*.parquet", df.schema, files_per_trigger=1)


def streaks_of(spark, files, wet=(), delay="4 days", keys=("a", "b")):
    start = dt.date(2031, 3, 1)
    rows = [(k, start + dt.timedelta(days=i), i not in wet, n) for n, held in enumerate(files) for i in held for k in keys]
    src = in_files(spark, rows, "k string, d date, ok boolean, n int")
    got = St.run_available(St.streaks(src, "k", "d", F.col("ok"), delay), rocks=True).collect()
    return sorted((r.key, (r.day - start).days, r.run) for r in got)


def test_streaks_count_in_day_order(spark):
    """Days of a key in three files, the middle ones last; one comes after the watermark has passed it."""
    got = streaks_of(spark, [[0, 1, 5], [3, 2, 4], [8, 7, 6], [20], [21], [10, 9], [40]], wet={4, 9})
    runs = {0: 1, 1: 2, 2: 3, 3: 4, 4: 0, 5: 1, 6: 2, 7: 3, 8: 4, 20: 1, 21: 2}  # 9 and 10 were late, 40 still waits
    assert got == sorted((k, i, run) for k in ("a", "b") for i, run in runs.items())


@pytest.mark.parametrize("files", [[[0, 1], [4], [5]], [[0, 1, 4, 5]], [[1], [0], [5], [4]]])
def test_a_day_that_ends_at_the_watermark_comes_out(spark, files):
    """The newest day less three is the end of day 1: days 0 and 1 come out, however the input is cut."""
    assert streaks_of(spark, files, delay="3 days", keys=("a",)) == [("a", 0, 1), ("a", 1, 2)]


@pytest.mark.parametrize("seed", range(3))
def test_streaks_at_random_cuts(spark, seed):
    """Days in any order within the delay; a last day of nobody brings out all of them."""
    rng = random.Random(seed)
    held = {k: sorted(rng.sample(range(30), 20)) for k in "abcde"}
    wet = set(rng.sample(range(30), 6))
    start, rows = dt.date(2031, 3, 1), []
    cuts = sorted(rng.sample(range(30), 4))
    for k, days in held.items():
        for d in days:
            rows.append((k, start + dt.timedelta(days=d), d not in wet, sum(c <= min(d + rng.randint(0, 2), 29) for c in cuts)))
    rows.append((None, start + dt.timedelta(days=60), True, 9))
    got = St.run_available(St.streaks(in_files(spark, rows, "k string, d date, ok boolean, n int"), "k", "d", F.col("ok"), "3 days"), rocks=True).collect()
    want = []
    for k, days in held.items():
        run, last = 0, None
        for d in days:
            run = (run if last == d - 1 else 0) + 1 if d not in wet else 0
            last = d
            want.append((k, d, run))
    assert sorted((r.key, (r.day - start).days, r.run) for r in got) == sorted(want)


def test_latest_goes_on_after_a_restart(spark):
    rows = [(k, t, f"{k}-{t}") for t in range(6) for k in range(t, t + 9)]
    df = spark.createDataFrame(rows, "k int, t int, v string")
    folder, state = scratch_path(spark, "in"), scratch_path(spark, "state")
    for part in (df.where("t < 3"), df.where("t >= 3 and k <> 5")):
        part.write.mode("append").parquet(folder)
        out = St.run_latest(St.read_stream(spark, folder, "*.parquet", df.schema, files_per_trigger=1), ["k"], ["t"], path=state)
    want = {k: f"{k}-{min(k, 5) if k != 5 else 2}" for k in range(14)}
    assert {r.k: r.v for r in out.collect()} == want


def test_forecasts_that_nobody_observed_come_out_once(spark):
    t = lambda h: dt.datetime(2031, 5, 1) + dt.timedelta(hours=h)
    f = in_files(spark, [("a", t(0), 1, 0), ("a", t(1), 2, 0), ("b", t(2), 3, 1), (None, t(3), 4, 1), ("a", t(200), 5, 2)], "k string, issued timestamp, f int, n int").drop("n")
    o = in_files(spark, [("a", t(5), 10, 0), ("a", t(6), 11, 1), ("b", t(90), 12, 1), (None, t(3), 13, 1), ("z", t(200), 14, 2)], "k string, seen timestamp, o int, n int").drop("n")
    got = St.run_available(St.verify_live(f, o, "k", "issued", "seen", "1 hour", "5 hours").select("f", "o"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 10), (2, 10), (2, 11), (3, None), (4, None)], key=str)


def test_daily_drops_late_rows(spark):
    t = lambda d, h: dt.datetime(2031, 5, d, h)
    rows = [("a", t(1, 3), 1.0, 0), ("a", t(2, 4), 2.0, 1), ("a", t(1, 23), 4.0, 2), ("a", t(9, 1), 8.0, 3), ("a", t(9, 4), 0.5, 4), ("a", t(1, 5), 16.0, 5), ("a", t(9, 2), 32.0, 6), ("a", t(20, 1), 64.0, 7)]
    src = in_files(spark, rows, "k string, ts timestamp, v double, n int")
    got = {str(r.d): (r.total, r.n) for r in St.run_available(St.daily(src, ["k"], "ts", "v", "12 hours", 1)).collect()}
    assert got == {"2031-05-01": (5.0, 2), "2031-05-02": (2.0, 1), "2031-05-09": (40.5, 3)}
