import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import series

T0 = datetime(2024, 1, 1)
HOUR = 3600 * 10**9


def cpu_rows(spark, rows):
    """rows: (cpu, minute, user, idle)"""
    df = spark.createDataFrame([("h", c, T0 + timedelta(minutes=m), u, i) for c, m, u, i in rows],
                               "host STRING, cpu STRING, ts TIMESTAMP, user BIGINT, idle BIGINT")
    return df.select("host", "cpu", "ts", "user", "idle", *[F.lit(0).cast("bigint").alias(s) for s in series.CPU_STATES
                                                            if s not in ("user", "idle")])


def test_utilization(spark):
    rows = [("cpu0", 0, 100, 100), ("cpu0", 1, 130, 170), ("cpu0", 2, 130, 170), ("cpu0", 3, 10, 10), ("cpu0", 4, 20, 20)]
    got = series.cpu_utilization(cpu_rows(spark, rows), slice_ns=60 * 10**9).orderBy("ts").collect()
    assert [(r["user_pct"], r["idle_pct"], r["busy_pct"], r["counter_reset"]) for r in got] == [
        (30.0, 70.0, 30.0, False), (0.0, 0.0, 0.0, False), (None, None, None, True), (50.0, 50.0, 50.0, False)]


def test_total_only(spark):
    rows = [("cpu", 0, 0, 0), ("cpu", 1, 1, 1), ("cpu0", 0, 0, 0), ("cpu0", 1, 1, 1)]
    assert [r["type"] for r in series.cpu_utilization(cpu_rows(spark, rows), per_core=False).collect()] == ["cpu_total"]


@pytest.mark.parametrize("hours", [None, 1, 7])
def test_ema_equals_recurrence(spark, hours):
    rnd = random.Random(4)
    data = {k: [rnd.random() * 100 if rnd.random() > 0.05 else None for _ in range(n)] for k, n in (("hot", 900), ("a", 40), ("b", 1))}
    rows = [(k, T0 + timedelta(minutes=7 * i), x) for k, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k STRING, ts TIMESTAMP, x DOUBLE")
    slices = None if hours is None else series.time_slice("ts", hours * HOUR)
    got = {(r["k"], r["ts"]): r["x_ema"] for r in series.ema(df, ["k"], ["ts"], ["x"], 0.3, slices).collect()}
    for k, xs in data.items():
        state = None
        for i, x in enumerate(xs):
            if x is not None:
                state = x if state is None else 0.3 * x + 0.7 * state
            value = got[(k, T0 + timedelta(minutes=7 * i))]
            assert (value is None or value != value) if state is None else value == pytest.approx(state, rel=1e-12)


def proc_rows(spark, rows):
    """rows: (minute, pid, utime, total_jiffies)"""
    return spark.createDataFrame([("h", T0 + timedelta(minutes=m), p, f"c{p}", "S", u, 0, p, 1, 2048, 2, j, 4) for m, p, u, j in rows],
                                 "host STRING, ts TIMESTAMP, pid BIGINT, comm STRING, state STRING, utime BIGINT, stime BIGINT, "
                                 "starttime BIGINT, num_threads BIGINT, vsize BIGINT, rss_pages BIGINT, total_jiffies BIGINT, num_cpus BIGINT")


def test_process_cpu_needs_the_previous_snapshot(spark):
    rows = [(0, 1, 0, 0), (0, 2, 50, 0), (1, 1, 10, 100), (2, 1, 30, 200), (2, 2, 90, 200), (3, 1, 20, 300), (3, 2, 95, 300)]
    got = series.process_cpu(proc_rows(spark, rows)).orderBy("ts", "pid").collect()
    # pid 2 is missing in snapshot 1, so it has no predecessor in snapshot 2; a falling counter counts as 0
    assert [(r["ts"].minute, r["pid"], r["cpu_user_pct"]) for r in got] == [(1, 1, 40.0), (2, 1, 80.0), (3, 1, 0.0), (3, 2, 20.0)]
    assert got[0]["rss_kb"] == 8 and got[0]["vsize_kb"] == 2


def test_cut_happens_before_rows_without_predecessor_go(spark):
    rows = [(0, 5, 0, 0), (1, 1, 0, 100), (1, 5, 0, 100)]
    # both rank as 0; pid 1 comes first, takes the only place and is then dropped
    assert series.process_cpu(proc_rows(spark, rows), top_n=1).count() == 0


def test_pid_reuse_option(spark):
    df = proc_rows(spark, [(0, 1, 10, 0), (1, 1, 50, 100)]).withColumn(
        "starttime", F.when(F.minute("ts") == 0, 1).otherwise(2).cast("bigint"))
    assert series.process_cpu(df).count() == 1
    assert series.process_cpu(df, key_starttime=True).count() == 0


def test_downsample(spark):
    df = spark.createDataFrame([("h", T0 + timedelta(minutes=i)) for i in range(130)] * 2, "host STRING, ts TIMESTAMP")
    got = [r["ts"] for r in series.downsample_times(df, 60, slice_ns=600 * 10**9).orderBy("ts").collect()]
    assert got == [T0 + timedelta(minutes=i) for i in range(0, 130, 3)]
    assert series.downsample_times(df.drop("host"), 60, by=(), slice_ns=600 * 10**9).count() == len(got)


def brute_nearest(times, points):
    return {g: min(points, key=lambda p: (abs(p[0] - g), p[0]))[1] for g in times}


def test_nearest_and_heatmap(spark):
    rnd = random.Random(8)
    points = sorted(rnd.sample(range(0, 5000), 300))
    util = spark.createDataFrame([("h", f"cpu{c}", T0 + timedelta(seconds=p), float(p + c)) for p in points for c in (0, 10)],
                                 "host STRING, cpu STRING, ts TIMESTAMP, busy_pct DOUBLE")
    grid_s = rnd.sample(range(-50, 5100), 80)
    grid = spark.createDataFrame([("h", "cpu0", T0 + timedelta(seconds=g)) for g in grid_s], "host STRING, cpu STRING, ts TIMESTAMP")
    got = {int((r["ts"] - T0).total_seconds()): r["busy_pct"] for r in series.nearest_join(grid, util, slice_ns=200 * 10**9).collect()}
    assert got == brute_nearest(grid_s, [(p, float(p)) for p in points])
    heat = series.core_heatmap(util, max_cols=25, slice_ns=300 * 10**9).collect()
    kept = points[::12]
    assert sorted((r["core"], int((r["ts"] - T0).total_seconds()), r["busy_pct"]) for r in heat) == sorted(
        (c, t, float(t + c)) for t in kept for c in (0, 10))


def test_retention_of_series(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=i)) for i in range(100)], "k STRING, ts TIMESTAMP")
    now = T0 + timedelta(minutes=99)
    assert series.retain_series(df, ["k"], 1800, 30 * 60_000, now).count() == 31
    assert series.retain_series(df, ["k"], 10, 30 * 60_000, now).count() == 10


def test_system_rates(spark):
    df = spark.createDataFrame([("h", T0, 0, 0), ("h", T0 + timedelta(seconds=4), 100, 8), ("h", T0 + timedelta(seconds=5), 50, 9)],
                               "host STRING, ts TIMESTAMP, ctxt BIGINT, intr BIGINT")
    assert [(r[2], r[3]) for r in series.system_rates(df).orderBy("ts").collect()] == [(25.0, 2.0), (None, 1.0)]
    assert [(r[2], r[3]) for r in series.system_rates(df, 2.0).orderBy("ts").collect()] == [(50.0, 4.0), (None, 0.5)]
