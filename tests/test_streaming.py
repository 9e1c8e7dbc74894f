"""Streams over several micro-batches give what the batch form gives."""
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hostpulse.operators import pairing, sched, series, stats
from hostpulse.plans import registry
from hostpulse.session import durable_dir
from hostpulse.streaming import run, windows

T0 = 1_700_000_000 * 10**9
SCHEMA = ("host STRING, seq BIGINT, timestamp_ns BIGINT, ts TIMESTAMP, event_type STRING, prev_pid BIGINT, next_pid BIGINT, "
          "prev_comm STRING, next_comm STRING, cpu BIGINT")


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(21)
    rows, t = [], T0
    for seq in range(900):
        t += rnd.randrange(1, 10**9 // 2)
        pid = 1 if rnd.random() < 0.4 else rnd.randrange(0, 12)
        rows.append(("h", seq, t, datetime.fromtimestamp(t // 1000 / 10**6, timezone.utc), rnd.choice(["switch", "wakeup", "migrate"]),
                     rnd.randrange(12), pid, "p", f"n{pid}", seq % 4))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, events):
    """Three files with growing times, read one per micro-batch."""
    path = durable_dir(spark, "events")
    for i in range(3):
        events.where((F.col("seq") >= i * 300) & (F.col("seq") < (i + 1) * 300)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_latency_over_micro_batches(spark, events, folder):
    got = run.to_table(pairing.runqueue_latency(stream(spark, folder)))
    assert rows(got, "seq", "latency_ns", "ts") == rows(pairing.runqueue_latency(events), "seq", "latency_ns", "ts")


def test_offcpu_over_micro_batches(spark, events, folder):
    cols = ("pid", "timestamp_ns", "duration_ns", "comm", "cpu")
    assert rows(run.to_table(pairing.offcpu_intervals(stream(spark, folder))), *cols) == rows(pairing.offcpu_intervals(events), *cols)


@pytest.fixture(scope="module")
def shuffled(spark, events):
    """The same rows in files that overlap in time by up to 100 rows, with two rows that come far too late."""
    path = durable_dir(spark, "shuffled")
    own = F.when(F.col("seq") < 100, 0).when(F.col("seq").isin(5, 6), 2).otherwise(
        F.floor((F.col("seq") - 50 + F.pmod(F.xxhash64("seq"), F.lit(100))) / 300)).cast("int")
    parted = events.withColumn("__f", F.when(F.col("seq").isin(5, 6), 2).otherwise(F.greatest(F.lit(0), F.least(F.lit(2), own))))
    for i in range(3):
        parted.where(F.col("__f") == i).drop("__f").coalesce(1).write.mode("append").parquet(path)
    return path


def test_rows_out_of_order_give_the_batch_answer(spark, events, shuffled):
    """Late within the watermark: waited for. Later than it: dropped, counted, and never a negative latency."""
    delay = 60
    marked = stream(spark, shuffled).withWatermark("ts", f"{delay} seconds")
    path = durable_dir(spark, "ordered")
    q = (pairing.runqueue_latency(marked).writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", durable_dir(spark, "chk")).trigger(availableNow=True))
    run.counter_of(spark)
    q = q.start()
    q.awaitTermination()
    got = spark.read.parquet(path)
    closed = events.agg(F.max("timestamp_ns")).first()[0] - delay * 10**9
    kept = events.where(~F.col("seq").isin(5, 6))
    want = pairing.runqueue_latency(kept).where(F.col("timestamp_ns") <= closed)
    assert rows(got.where("event_type != 'migrate'"), "seq", "latency_ns") == rows(want.where("event_type != 'migrate'"), "seq", "latency_ns")
    assert got.agg(F.min("latency_ns")).first()[0] >= 0
    total = run.progress_rows(spark, q).agg(F.max("dropped"), F.max("records")).first()
    lost = events.where(F.col("seq").isin(5, 6) & (F.col("event_type") != "migrate")).count()
    assert total[0] >= lost > 0 and total[1] == 900


def test_without_watermark_no_negative_latency(spark, shuffled):
    got = run.to_table(pairing.runqueue_latency(stream(spark, shuffled)))
    assert got.agg(F.min("latency_ns")).first()[0] >= 0 and got.count() == 900


def test_totals_outlive_spark_s_reports(spark, folder):
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        q = run.run_available(stream(spark, folder), [lambda df, i: df.count()])
        assert len(q.recentProgress) <= 2
        assert run.progress_rows(spark, q).agg(F.max("records"), F.max("batches")).first()[0] == 900
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)


def test_stats_and_history_chained(spark, events, folder):
    latency = pairing.runqueue_latency(stream(spark, folder).withWatermark("ts", "5 seconds"))
    s = windows.stream_sched_stats(latency, "10 seconds", None)
    got = run.to_table(windows.window_start(s))
    batch = sched.sched_stats(pairing.runqueue_latency(events), "10 seconds")
    closed = events.agg(F.max("timestamp_ns")).first()[0] - 5 * 10**9
    want = batch.where(F.col("window_ns") + 10 * 10**9 <= closed)
    cols = ("window_ns", "pid", "switch_count", "total_runqueue_latency_ns", "migrate_count")
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 20
    history = run.to_table(windows.window_start(windows.stream_sched_history(s)))
    known = {r["window_ns"]: r["total_switches"] for r in sched.sched_history(batch, None).collect()}
    seen = history.collect()
    assert len(seen) > 5 and all(known[r["window_ns"]] == r["total_switches"] for r in seen)


def test_window_stats(spark, events, folder):
    def shape(df):
        return df.select("host", "timestamp_ns", "ts", F.create_map(F.lit("type"), F.col("event_type")).alias("labels"),
                         F.create_map(F.lit("pid"), F.col("next_pid").cast("double")).alias("fields"))
    got = run.to_table(windows.stream_window_stats(shape(stream(spark, folder)), "20 seconds", "5 seconds"))
    closed = events.agg(F.max("timestamp_ns")).first()[0] - 5 * 10**9
    want = stats.window_stats(shape(events), "20 seconds").where(F.col("window_ns") + 20 * 10**9 <= closed)
    cols = ("window_ns", "field", "avg", "count", "p50", "p99", F.col("labels")[0]["value"])
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 5


def test_ema_over_micro_batches(spark, events, folder):
    got = run.to_table(series.ema(stream(spark, folder), ["next_pid"], ["timestamp_ns", "seq"], ["cpu"], 0.3))
    want = series.ema(events, ["next_pid"], ["timestamp_ns", "seq"], ["cpu"], 0.3)
    a, b = rows(got, "seq", "cpu_ema"), rows(want, "seq", "cpu_ema")
    assert [x[0] for x in a] == [x[0] for x in b]
    assert all(x[1] == pytest.approx(y[1], rel=1e-12) for x, y in zip(a, b))


def test_no_next_row_on_streams(spark, folder):
    with pytest.raises(ValueError):
        sched.gantt(stream(spark, folder))


def test_declared_stream_with_failing_sink_and_restart(spark, events, folder):
    out, checkpoint = durable_dir(spark, "out"), durable_dir(spark, "chk")
    registry.register_source("sched_stream", lambda s: stream(s, folder))

    @registry.register_sink("broken")
    def broken(df, batch_id):
        raise RuntimeError("down")

    spec = {"name": "sched", "source": "sched_stream", "processors": [{"type": "allow_pids", "options": {"pids": [1], "cols": ["next_pid"]}}],
            "sinks": ["broken", {"type": "parquet", "options": {"path": out}}], "checkpoint": checkpoint}
    want = events.where("next_pid = 1").count()
    for _ in range(2):      # the second run finds nothing new
        registry.run_available(spark, spec)
        assert spark.read.parquet(out).count() == want


def test_progress(spark, folder):
    import time
    counter = run.ProgressCounter()
    spark.streams.addListener(counter)
    try:
        q = run.run_available(stream(spark, folder), [lambda df, i: df.count()])
        got = stats.stage_health(run.progress_rows(spark, q)).first()
        assert (got["records"], got["batches"], got["errors"], got["total"]) == (900, 3, 0, 1)
        for _ in range(50):
            if sum(t["records"] for t in counter.totals.values()) == 900:
                break
            time.sleep(0.2)
        assert list(counter.totals.values()) == [{"batches": 3, "records": 900, "dropped": 0, "errors": 0}]
    finally:
        spark.streams.removeListener(counter)


def test_late_rows_are_dropped(spark):
    base = datetime(2024, 1, 1)
    path = durable_dir(spark, "late")
    schema = "host STRING, ts TIMESTAMP, labels MAP<STRING,STRING>, fields MAP<STRING,DOUBLE>"
    for minutes in ([0, 30], [31], [1, 60]):
        spark.createDataFrame([("h", base + timedelta(minutes=m), {"k": "v"}, {"x": float(m)}) for m in minutes], schema).coalesce(1) \
            .write.mode("append").parquet(path)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run.to_table(windows.stream_window_stats(s, "5 minutes", "10 minutes"))
    # minute 1 arrives after the watermark passed its window
    assert sorted((r["max"], r["count"]) for r in got.collect()) == [(0.0, 1), (31.0, 2)]


@pytest.mark.parametrize("by", [None, "comm", "global"])
def test_profile_windows(spark, events, folder, by):
    from hostpulse.functions import columns as C
    from hostpulse.operators import profiles

    def shape(df):
        return df.select("host", "ts", "timestamp_ns", F.col("next_pid").alias("pid"), F.col("cpu").alias("tid"),
                         F.col("next_comm").alias("comm"), F.lit(2).cast("bigint").alias("count"),
                         F.lit(5).cast("bigint").alias("duration_ns"),
                         C.frames_from_names(F.array("event_type")).alias("user_stack"),
                         C.frames_from_addresses(F.array("cpu")).alias("kernel_stack"))

    got = run.to_table(windows.stream_profile(shape(stream(spark, folder)), "20 seconds", "5 seconds", by))
    closed = events.agg(F.max("timestamp_ns")).first()[0] - 5 * 10**9
    batch = shape(events).withColumn("window_ns", C.floor_to("timestamp_ns", 20 * 10**9)).where(
        F.col("window_ns") + 20 * 10**9 <= closed)
    total = {r[0]: r[1] for r in batch.groupBy("window_ns").agg(F.sum("count")).collect()}
    assert {r[0]: r[1] for r in got.groupBy("window_ns").agg(F.sum("count")).collect()} == total
    one = batch.where(F.col("window_ns") == min(total))
    want = profiles.window_profile(one, "20 seconds") if by is None else profiles.merge_stacks(one, by)
    assert sorted(r["count"] for r in got.where(F.col("window_ns") == min(total)).collect()) == sorted(r["count"] for r in want.collect())


def test_pair_with_ttl(spark, events, folder):
    from hostpulse.streaming.live import stream_pair
    with pytest.raises(ValueError):
        stream_pair(stream(spark, folder), ["next_pid"], ["seq"], F.lit(True), F.lit(False), ["seq"], ttl_ms=1)
    marked = stream(spark, folder).withWatermark("ts", "5 seconds")
    closed = events.agg(F.max("timestamp_ns")).first()[0] - 5 * 10**9
    got = run.to_table(stream_pair(marked, ["next_pid"], ["timestamp_ns", "seq"], F.col("event_type") == "wakeup",
                                   F.col("event_type") == "switch", ["seq"], ttl_ms=3_600_000).select("seq", F.col("opened.seq").alias("o")))
    want = pairing.pair_events(events, ["next_pid"], ["timestamp_ns", "seq"], F.col("event_type") == "wakeup",
                               F.col("event_type") == "switch", ["seq"]).where(F.col("timestamp_ns") <= closed).select("seq", F.col("opened.seq").alias("o"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_process_cpu_live(spark):
    from hostpulse.streaming.live import stream_process_cpu
    base = datetime(2024, 1, 1)
    schema = "host STRING, ts TIMESTAMP, pid BIGINT, utime BIGINT, stime BIGINT, rss_pages BIGINT, vsize BIGINT, total_jiffies BIGINT, num_cpus BIGINT"
    path = durable_dir(spark, "procs")
    for snap, pids in enumerate([(1, 2), (1,), (1, 2)]):
        spark.createDataFrame([("h", base + timedelta(seconds=2 * snap), p, snap * 10, 0, 1, 4096, snap * 100, 4) for p in pids], schema) \
            .coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run.to_table(stream_process_cpu(s, 2000)).orderBy("ts", "pid").collect()
    assert [(r["pid"], r["cpu_user_pct"], r["vsize_kb"]) for r in got] == [(1, 40.0, 4), (1, 40.0, 4)]


def test_gauge_board_keeps_series_of_earlier_batches(spark, tmp_path):
    from hostpulse.sinks.tables import GaugeBoard
    schema = "timestamp_ns BIGINT, seq BIGINT, labels MAP<STRING,STRING>, fields MAP<STRING,DOUBLE>"
    board = GaugeBoard(str(tmp_path / "board"), "x")
    batches = [[(1, 1, {"n": "a"}, {"t": 1.0}), (1, 2, {"n": "b"}, {"t": 2.0})], [(2, 3, {"n": "a"}, {"t": 5.0})], [(3, 4, {"n": "c"}, {"t": 7.0})]]
    for i, b in enumerate(batches):
        for _ in range(2):      # a repeated batch changes nothing
            board(spark.createDataFrame(b, schema), i)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "board" / "exposition")).collect()]
    assert lines == ["# HELP x_t gauge of x_t", "# TYPE x_t gauge", 'x_t{n="a"} 5.0', 'x_t{n="b"} 2.0', 'x_t{n="c"} 7.0']


def test_stream_from_another_folder(tmp_path):
    """A script elsewhere ships the package; the stream's Python workers find it."""
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parents[1]
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(root)!r})
from hostpulse.operators import pairing
from hostpulse.session import build_session, ship_package
from hostpulse.streaming import run
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
ship_package(spark)
schema = "host STRING, seq BIGINT, timestamp_ns BIGINT, event_type STRING, prev_pid BIGINT, next_pid BIGINT, prev_comm STRING, next_comm STRING, cpu BIGINT"
path = {str(tmp_path / "events")!r}
spark.createDataFrame([("h", 1, 10, "wakeup", 0, 5, "a", "b", 0), ("h", 2, 30, "switch", 0, 5, "a", "b", 0)], schema).write.parquet(path)
got = run.to_table(pairing.runqueue_latency(spark.readStream.schema(schema).parquet(path)))
print("LATENCY", [r["latency_ns"] for r in got.where("event_type = 'switch'").collect()])
""")
    env = {**{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, "PATH": __import__("os").environ["PATH"], "HOME": str(tmp_path)}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "LATENCY [20]" in done.stdout, done.stderr[-2000:]


class Timers:
    """A state handle in plain Python that counts what is read."""

    class Value:
        def __init__(self):
            self.row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

        def clear(self):
            self.row = None

    class Map:
        def __init__(self, owner):
            self.rows, self.owner = {}, owner

        def containsKey(self, key):
            return key in self.rows

        def getValue(self, key):
            self.owner.read += len(str(self.rows[key]))
            return self.rows[key]

        def updateValue(self, key, value):
            self.owner.written += len(str(value))
            self.rows[key] = value

        def removeKey(self, key):
            del self.rows[key]

    def __init__(self):
        self.read = self.written = 0
        self.timers, self.maps = set(), {}

    def getValueState(self, name, schema):
        return Timers.Value()

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Timers.Map(self))

    def registerTimer(self, at):
        self.timers.add(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.ms


@pytest.mark.parametrize("bucket_ms", [1, 50, 10_000])
def test_work_of_a_hot_key_follows_its_rows(bucket_ms):
    """Twenty times the micro-batches of one key, out of order within the watermark, cost twenty times as much, in order."""
    import pandas as pd

    from hostpulse.streaming.stateful import _Previous

    def work(batches):
        rnd, handle = random.Random(2), Timers()
        keyed = _Previous(["ord0"], "ts", None, 1, bucket_ms)
        keyed.init(handle)
        out, mark, newest = [], 0, 0
        for b in range(batches):
            at = [b * 100_000 + rnd.randrange(-40_000, 100_000) for _ in range(30)]     # microseconds
            at = [a for a in at if a > mark * 1000]
            newest = max(newest, *at)
            frame = pd.DataFrame({"ord0": at, "row_text": [str(a) for a in at], "payload_text": [str(a) for a in at], "ts": pd.to_datetime(at, unit="us")})
            assert list(keyed.handleInputRows(("k",), iter([frame]), Mark(mark))) == []
            mark = max(mark, (newest - 50_000) // 1000)
            while handle.timers and min(handle.timers) <= mark:
                at = min(handle.timers)
                handle.timers.remove(at)
                for pdf in keyed.handleExpiredTimer(("k",), Mark(mark), Mark(at)):
                    out += list(zip(pdf["row_text"].astype(int), pdf["before_text"]))
        rows = [r for r, _ in out]
        assert rows == sorted(rows) and all(r <= mark * 1000 for r in rows)
        assert [b for _, b in out][1:] == [str(r) for r in rows][:-1] or len(set(rows)) < len(rows)
        waiting = sum(len(eval(v[0].replace("null", "None"))) for v in handle.maps["pending"].rows.values())
        assert waiting == keyed.open.get()[0]
        return handle.read + handle.written
    few, many = work(10), work(200)
    assert many < 2 * 20 * few


def test_key_is_forgotten_after_its_ttl(spark):
    from hostpulse.streaming import live
    path = durable_dir(spark, "ttl")
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for i, (secs, op) in enumerate([(0, "open"), (100, "other"), (200, "other"), (201, "close")]):
        spark.createDataFrame([("k" if op != "other" else "z", i, base + timedelta(seconds=secs), op)], "k STRING, seq BIGINT, ts TIMESTAMP, op STRING").coalesce(1).write.mode("append").parquet(path)
    for ttl, matched in ((60_000, 0), (600_000, 1)):
        stream = spark.readStream.schema("k STRING, seq BIGINT, ts TIMESTAMP, op STRING").option("maxFilesPerTrigger", 1).parquet(path)
        closing = run.Closing(spark, durable_dir(spark, "end"), "1 second", "1 minute")
        out = durable_dir(spark, "pairs")
        paired = live.stream_pair(closing.attach(stream).where("op <> 'none'"), ["k"], ["ts", "seq"], F.col("op") == "open", F.col("op") == "close", ["seq"], ttl_ms=ttl)
        run.run_available(paired, [lambda df, i, out=out: df.write.mode("overwrite").parquet(f"{out}/b={i}")], closing=closing)
        got = [r for r in spark.read.parquet(out).collect() if r["op"] == "close"]
        assert len(got) == 1 and (got[0]["opened"] is not None) == bool(matched)


def test_state_calls_follow_shards_not_rows():
    """Rows of many keys, far apart in event time, share the chunks and the timer of their shard; each key keeps its own order."""
    import pandas as pd

    from hostpulse.streaming.stateful import _Previous
    handle, out, rnd = Timers(), {}, random.Random(3)
    keyed = _Previous(["ord0"], "ts", None, 1)
    keyed.init(handle)
    at = sorted(rnd.sample(range(1, 10**9), 3000))
    times = pd.to_datetime([a * 1000 for a in at], unit="us")
    frame = pd.DataFrame({"pair_key": [f"k{i % 700}" for i in range(3000)], "ord0": at, "row_text": [str(a) for a in at], "payload_text": [str(a) for a in at], "ts": times})
    assert list(keyed.handleInputRows((1,), iter([frame]), Mark(0))) == []
    assert len(handle.maps["pending"].rows) == 3 and len(handle.timers) == 1
    fired = 0
    for mark in (5 * 10**8, 10**9):
        while handle.timers and min(handle.timers) <= mark:
            first = min(handle.timers)
            handle.timers.remove(first)
            fired += 1
            for pdf in keyed.handleExpiredTimer((1,), Mark(mark), Mark(first)):
                out |= dict(zip(pdf["row_text"].astype(int), pdf["before_text"]))
    assert fired == 2 and keyed.open.get()[0] == 0
    assert out == {a: str(at[i - 700]) if i >= 700 else None for i, a in enumerate(at)}


def test_parts_of_a_stream_are_several_files(spark):
    from hostpulse.plans.queries_cases import write_parts
    path = durable_dir(spark, "many")
    rows = spark.range(3000).withColumn("file", F.when(F.col("id") < 2000, 0).otherwise(1))
    assert write_parts(spark, rows, path, 500) == 4
    files = spark.read.parquet(path).select("id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_modification_time").alias("t"))
    per = files.groupBy("f").agg(F.min("t").alias("t"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).orderBy("t").collect()
    assert len(per) == 8 and sum(r["n"] for r in per) == 3000 and all((r["hi"] < 2000) == (i < 4) and (r["lo"] >= 2000) == (i >= 4) for i, r in enumerate(per))


def test_last_rows_of_many_keys_share_cells(monkeypatch):
    """A later row of every key costs some calls of the state for each cell, not for each key, and cells stay small."""
    import pandas as pd

    from hostpulse.streaming import stateful
    monkeypatch.setattr(stateful, "CELL_KEYS", 50)
    handle, calls, out = Timers(), [], {}
    for name in ("containsKey", "getValue", "updateValue", "removeKey"):
        own = getattr(Timers.Map, name)
        monkeypatch.setattr(Timers.Map, name, lambda self, *a, own=own: calls.append(a) or own(self, *a))
    keyed = stateful._Previous(["ord0"], None, None, 1)
    keyed.init(handle)
    for b, keys in enumerate(([0, 1], range(700), range(700), [3], range(300, 1000))):
        calls.clear()
        frame = pd.DataFrame({"pair_key": [f"k{k}" for k in keys], "ord0": [b] * len(keys), "row_text": [f"{k} {b}" for k in keys], "payload_text": [f"{k} {b}" for k in keys]})
        for pdf in keyed.handleInputRows((1,), iter([frame]), Mark(0)):
            out |= dict(zip(pdf["row_text"], pdf["before_text"]))
        assert len(calls) < len(keys) / 2 + 4
    cells = [eval(v[0]) for v in handle.maps["last"].rows.values()]
    assert sum(map(len, cells)) == 1000 and max(map(len, cells)) <= 100 and len({k for c in cells for k in c}) == 1000
    seen = {}
    for b, keys in enumerate(([0, 1], range(700), range(700), [3], range(300, 1000))):
        for k in keys:
            assert out[f"{k} {b}"] == seen.get(k)
            seen[k] = f"{k} {b}"


def test_keyed_state_has_a_store_per_core(spark, folder):
    """Of 64 shuffle partitions a keyed stream uses as many as there are cores (eight at least); others keep them, as does the session."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        used = []
        for df in (pairing.runqueue_latency(stream(spark, folder)), stream(spark, folder).withWatermark("ts", "1 minute").dropDuplicates(["seq", "ts"])):
            q = run.run_available(df, [lambda b, i: b.count()])
            used.append(int(q.lastProgress.stateOperators[0].numShufflePartitions))
        assert used == [8, 64] and spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
