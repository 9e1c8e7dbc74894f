"""Pairing against a replay of the keyed dictionary the probes keep."""
import random

import pytest

from hostpulse.operators import pairing, sched

NS = 10**6


@pytest.fixture(scope="module")
def events():
    rnd = random.Random(11)
    out, t = [], 0
    for seq in range(4000):
        t += rnd.randrange(0, 90) * NS // 100
        pid = 1 if rnd.random() < 0.4 else rnd.randrange(0, 25)      # pid 1 holds a third of all rows
        kind = rnd.choices(["switch", "wakeup", "migrate"], [6, 3, 1])[0]
        out.append(("h", seq, t, kind, rnd.randrange(0, 25), pid, f"c{rnd.randrange(4)}", f"n{pid}", seq % 4))
    return out


@pytest.fixture(scope="module")
def table(spark, events):
    return spark.createDataFrame(events, "host STRING, seq BIGINT, timestamp_ns BIGINT, event_type STRING, "
                                         "prev_pid BIGINT, next_pid BIGINT, prev_comm STRING, next_comm STRING, cpu BIGINT")


SLICES = [None, 5 * NS, 400 * NS]


@pytest.mark.parametrize("slice_ns", SLICES)
def test_runqueue_latency(table, events, slice_ns):
    pending, want = {}, {}
    for _, seq, t, kind, _, nxt, *_ in events:
        want[seq] = 0
        if kind == "wakeup":
            pending[nxt] = t
        elif kind == "switch" and nxt in pending:
            want[seq] = t - pending.pop(nxt)
    got = {r["seq"]: r["latency_ns"] for r in pairing.runqueue_latency(table, slice_ns).collect()}
    assert got == want


@pytest.mark.parametrize("slice_ns", SLICES)
def test_offcpu(table, events, slice_ns):
    left, want = {}, []
    for _, seq, t, kind, prev, nxt, pc, _, cpu in events:
        if kind != "switch":
            continue
        if prev:
            left[prev] = (t, pc)
        if nxt and nxt in left:
            start, comm = left.pop(nxt)
            if t - start >= 100_000:
                want.append((nxt, start, comm, cpu, t - start))
    got = pairing.offcpu_intervals(table, slice_ns=slice_ns).collect()
    assert sorted((r["pid"], r["timestamp_ns"], r["comm"], r["cpu"], r["duration_ns"]) for r in got) == sorted(want)


def test_short_interval_uses_up_its_leave(spark):
    rows = [("h", 1, 0, "switch", 5, 6, "a", "b", 0), ("h", 2, 50_000, "switch", 6, 5, "b", "a", 0),
            ("h", 3, 900_000, "switch", 7, 5, "c", "a", 0)]
    df = spark.createDataFrame(rows, "host STRING, seq BIGINT, timestamp_ns BIGINT, event_type STRING, prev_pid BIGINT, "
                                     "next_pid BIGINT, prev_comm STRING, next_comm STRING, cpu BIGINT")
    assert pairing.offcpu_intervals(df).count() == 0
    # exactly the minimum is kept
    assert pairing.offcpu_intervals(df, 50_000).select("pid", "duration_ns").collect()[0]["duration_ns"] == 50_000


@pytest.mark.parametrize("slice_ns", SLICES)
def test_gantt(table, events, slice_ns):
    running, want = {}, []
    for _, seq, t, kind, _, nxt, _, comm, cpu in events:
        if kind == "switch":
            if cpu in running and running[cpu][0] != 0:
                want.append((cpu, *running[cpu], t))
            running[cpu] = (nxt, comm, t)
    got = sched.gantt(table, slice_ns).collect()
    assert sorted((r["cpu"], r["pid"], r["comm"], r["start_ns"], r["end_ns"]) for r in got) == sorted(want)


@pytest.mark.parametrize("slice_ns", SLICES)
def test_allocations(spark, slice_ns):
    rnd = random.Random(5)
    rows = [("h", i, i * NS, 1, 1, "app", rnd.choice(["alloc", "free"]), str(rnd.choice([0, 2**63 + 1, *range(1, 9)])), i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "host STRING, seq BIGINT, timestamp_ns BIGINT, pid BIGINT, tid BIGINT, comm STRING, "
                                     "op STRING, addr STRING, size BIGINT")
    df = df.withColumn("addr", df["addr"].cast("decimal(20,0)"))
    held, want = {}, {}
    for _, seq, t, _, _, _, op, addr, size in rows:
        if addr == "0":
            continue
        if op == "alloc":
            held[addr] = (seq, size)
            want[seq] = size
        elif addr in held:
            want[seq] = held.pop(addr)[1]
    assert {r["seq"]: r["size"] for r in pairing.pair_allocations(df, slice_ns=slice_ns).collect()} == want
    live = {r["seq"] for r in pairing.live_allocations(df, slice_ns=slice_ns).collect()}
    assert live == {seq for seq, _ in held.values()}
    aged = pairing.live_allocations(df, as_of_ns=300 * NS, slice_ns=slice_ns)
    assert aged.where("age_ns < 0").count() == 0


def test_block_io_key_options(spark):
    rows = [("h", 1, 10, "issue", 1, 7, 8, 100, 100, "w", "R"), ("h", 2, 30, "complete", 2, 7, 8, 0, 0, "k", "WS"),
            ("h", 3, 40, "complete", 1, 7, 8, 0, 0, "k", "R")]
    df = spark.createDataFrame(rows, "host STRING, seq BIGINT, timestamp_ns BIGINT, phase STRING, dev BIGINT, sector BIGINT, "
                                     "nr_sector BIGINT, pid BIGINT, tid BIGINT, comm STRING, rwbs STRING")
    one = pairing.block_io_latency(df).collect()
    assert [(r["seq"], r["latency_ns"], r["pid"], r["comm"], r["rwflag"]) for r in one] == [(2, 20, 100, "w", 1)]
    two = pairing.block_io_latency(df, ("dev", "sector")).collect()
    assert [(r["seq"], r["latency_ns"]) for r in two] == [(3, 30)]
