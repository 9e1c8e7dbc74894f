"""Counters of stages, closed runs, user aggregators, Python data sources and table functions in SQL."""
import json
import random
import sys
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from hostpulse.operators import pairing, profiles
from hostpulse.operators.aggregators import Aggregator, aggregate
from hostpulse.plans import registry
from hostpulse.plans import sql as S
from hostpulse.session import durable_dir
from hostpulse.sources import datasource as D
from hostpulse.streaming import stages

# workers can't import a test module: its classes travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
DAY0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def numbers(spark, path, files, per=50):
    for i in range(files):
        spark.range(i * per, (i + 1) * per).select("id", (F.lit(DAY0) + F.make_dt_interval(secs=F.col("id") * 10)).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    return path


def source(spark, path, name="numbers"):
    registry.register_source(name, lambda s: s.readStream.schema("id BIGINT, ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(path))
    return name


def test_sink_that_fails_in_some_batches(spark):
    """Counts of each stage; what a sink missed waits in the spool, is found after a restart, and is given to it once."""
    path, out, spool = numbers(spark, durable_dir(spark, "in"), 4), durable_dir(spark, "out"), durable_dir(spark, "spool")
    down = {1, 3}

    @registry.register_sink("sometimes")
    def sometimes(df, batch_id):
        if batch_id in down:
            raise RuntimeError("down")
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    registry.register_sink("steady", lambda df, batch_id: df.count())
    registry.register_processor("even", lambda df: df.where("id % 2 = 0"))
    registry.register_processor("big", lambda df: df.where("id >= 10"))
    spec = {"name": "some", "source": source(spark, path), "processors": ["even", "big"], "sinks": ["sometimes", "steady"], "count": True,
            "spool": spool, "checkpoint": durable_dir(spark, "checkpoint")}
    chain = registry.Pipeline(spec)
    chain.run(spark, available_now=True)
    cols = ("name", "batches", "records", "dequeued", "dropped", "errors")
    assert [tuple(r) for r in chain.counts.frame(spark).orderBy("ord").select(*cols).collect()] == [
        ("some.numbers", 4, 200, 200, 0, 0), ("some.even", 4, 200, 100, 0, 0), ("some.big", 4, 100, 95, 0, 0),
        ("some.sometimes", 4, 95, 45, 50, 2), ("some.steady", 4, 95, 95, 0, 0)]
    again = registry.Pipeline(spec)      # as after a restart: nothing is remembered but what lies in the spool
    assert again.fan_out.waiting(spark) == {1: [0], 3: [0]} and again.fan_out.replay(spark) == 2
    down.remove(1)
    assert again.fan_out.replay(spark) == 1 and again.fan_out.waiting(spark) == {3: [0]}
    down.clear()
    assert again.fan_out.replay(spark) == 0 and again.fan_out.waiting(spark) == {}
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [i for i in range(10, 200) if i % 2 == 0]
    assert registry.Pipeline(spec).run(spark, available_now=True).exception() is None


def test_repeated_batch_counts_once():
    counts = stages.StageCounts("x")
    counts.stages = [("a", "source")]

    class Progress:
        batchId, stateOperators = 4, []
        observedMetrics = {"x.0": {"n": 7}, "other.0": {"n": 99}}
    for _ in range(2):
        counts.progress(Progress)
    counts.took(4, "s", False)
    counts.took(4, "s", True)
    assert counts.rows() == [("a", "source", 0, 1, 7, 0, 7, 7, 0), ("s", "sink", 1, 1, 7, 0, 7, 7, 0)]


def test_closed_run_and_later_rows(spark):
    """All windows come out; rows of later windows that come in a later run come out too, none twice."""
    path, out, checkpoint = numbers(spark, durable_dir(spark, "in"), 2), durable_dir(spark, "out"), durable_dir(spark, "checkpoint")
    registry.register_aggregator("minutes", lambda df: df.groupBy(F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("n")).select("window.start", "n"))
    spec = {"name": "minutes", "source": source(spark, path), "aggregator": "minutes", "flush": {"delay": "30 seconds", "window": "1 minute"},
            "checkpoint": checkpoint, "sinks": [{"type": "parquet", "options": {"path": out}}]}

    def result():
        return sorted((round((r["start"].replace(tzinfo=timezone.utc) - DAY0).total_seconds()), r["n"]) for r in spark.read.parquet(out).collect())

    def want(n):
        return sorted({60 * m: sum(1 for i in range(n) if i // 6 == m) for m in range((n + 5) // 6)}.items())
    for _ in range(2):
        registry.run_available(spark, spec)
        assert result() == want(100)
    spark.range(120, 150).select("id", (F.lit(DAY0) + F.make_dt_interval(secs=F.col("id") * 10)).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    registry.run_available(spark, spec)
    assert result() == want(100) + [(60 * m, 6) for m in range(20, 25)]


class Spread(Aggregator):
    columns, schema = ("x",), "low BIGINT, high BIGINT, n BIGINT"

    def zero(self):
        return [None, None, 0]

    def add(self, state, rows):
        return self.merge(state, [int(rows["x"].min()), int(rows["x"].max()), len(rows)])

    def merge(self, a, b):
        return b if not a[2] else a if not b[2] else [min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2]]

    def flush(self, state):
        return [tuple(state)] if state[2] > 1 else []


@pytest.mark.parametrize("held", [1, 20_000])
def test_user_aggregator(spark, monkeypatch, held):
    """Null keys, a hot key, more keys than a task holds; a flush may give no row."""
    from hostpulse.operators import aggregators
    monkeypatch.setattr(aggregators, "HELD", held)
    rnd = random.Random(4)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", i % 2 == 0, rnd.randrange(1000), "y") for i in range(3000)] + [("once", True, 5, "y")]
    want = {}
    for k, b, x, _ in rows:
        want.setdefault((k, b), []).append(x)
    got = aggregate(spark.createDataFrame(rows, "k STRING, b BOOLEAN, x BIGINT, state STRING").repartition(5), Spread(), ["k", "b"])
    assert {tuple(r) for r in got.collect()} == {(*k, min(x), max(x), len(x)) for k, x in want.items() if len(x) > 1}
    empty = aggregate(spark.createDataFrame([], "k STRING, x BIGINT"), Spread(), ["k"])
    assert empty.collect() == [] and empty.columns == ["k", "low", "high", "n"]


def test_dump_source(spark, tmp_path):
    """A partition for each file, tags from folders, hidden files left out, last line without a newline."""
    for host in ("a", "b"):
        (tmp_path / f"host={host}").mkdir()
        (tmp_path / f"host={host}" / "k.txt").write_text(f"ffff000000000001 T start_{host}\nffff000000000002 D data\nffff000000000003 t stop")
    (tmp_path / "_tmp.txt").write_text("ffff000000000001 T no")
    got = D.read_dumps(spark, str(tmp_path), "kallsyms")
    assert sorted((r["host"], r["ord"], r["name"]) for r in got.collect()) == [("a", 0, "start_a"), ("a", 2, "stop"), ("b", 0, "start_b"), ("b", 2, "stop")]
    assert got.rdd.getNumPartitions() == 2
    assert D.read_dumps(spark, f"file://{tmp_path}", "kallsyms").count() == 4


def test_stat_dumps_as_a_source(spark, tmp_path):
    (tmp_path / "host=a").mkdir()
    (tmp_path / "host=a" / "stat").write_text("cpu 1 2 3 4 5 6 7 8\ncpu0 1 0 0 0\nctxt 9\nbtime 3\n")
    cpu, system = D.read_dumps(spark, str(tmp_path), "stat")
    assert sorted((r["cpu"], r["user"], r["steal"]) for r in cpu.collect()) == [("cpu", 1, 8), ("cpu0", 1, 0)]
    assert [(r["host"], r["ctxt"]) for r in system.collect()] == [("a", 9)]


def test_store_shows_committed_batches_once(spark, tmp_path):
    path, columns = str(tmp_path / "store"), "id BIGINT, name STRING, tags MAP<STRING,STRING>"
    spark.dataSource.register(D.StoreSource)
    rows = [(1, "x", {"a": "b"}), (2, None, None)]
    spark.createDataFrame(rows, columns).write.format(D.STORE).mode("append").save(path)
    assert sorted(tuple(r) for r in D.read_store(spark, path, columns).collect()) == rows
    # a job that fails in one task commits nothing
    bad = spark.range(8).repartition(4).select("id", F.when(F.col("id") < 7, "y").otherwise(F.raise_error(F.lit("broken"))).cast("string").alias("name"), F.lit(None).cast("map<string,string>").alias("tags"))
    with pytest.raises(Exception):
        bad.write.format(D.STORE).mode("append").save(path)
    assert D.read_store(spark, path, columns).count() == 2
    # a micro-batch that is repeated after its commit adds nothing and leaves no file
    from pyspark.sql import Row
    writer = D.StoreStreamWriter({"path": path}, ["id"])
    for _ in range(2):
        writer.commit([writer.write([Row(id=9)]), writer.write([]), None], 0)
    aborted = writer.write([Row(id=10)])
    writer.abort([aborted, None], 1)
    assert sorted(r["id"] for r in D.read_store(spark, path, columns).collect()) == [1, 2, 9]
    listed = {f for m in (tmp_path / "store" / "commits").glob("*.json") for f in json.loads(m.read_text())["files"]}
    assert "data/" + aborted.path.split("/")[-1] not in listed and not [m for m in (tmp_path / "store" / "commits").glob("_*")]
    assert {f"data/{p.name}" for p in (tmp_path / "store" / "data").glob("*")} >= listed


def test_dump_offsets(tmp_path):
    """Files come in order of time, at most so many a batch, each once."""
    import os
    for i, name in enumerate("cab"):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (i + 1, i + 1))
    reader = D.DumpStreamReader({"path": str(tmp_path), "maxFiles": "2"})
    start = reader.initialOffset()
    one = reader.latestOffset()
    two = reader.latestOffset()
    assert [p.path[-1] for p in reader.partitions(start, one)] == ["c", "a"]
    assert [p.path[-1] for p in reader.partitions(one, two)] == ["b"] and reader.latestOffset() == two
    fresh = D.DumpStreamReader({"path": str(tmp_path), "maxFiles": "1"})     # restarted from a stored offset
    assert fresh.partitions(start, one) and fresh.latestOffset() == two


def test_table_functions(spark):
    rows = spark.createDataFrame([("h", 1, 10, "wakeup", 0, 5, "p", "n"), ("h", 2, 30, "switch", 0, 5, "p", "n")],
                                 "host STRING, seq BIGINT, timestamp_ns BIGINT, event_type STRING, prev_pid BIGINT, next_pid BIGINT, prev_comm STRING, next_comm STRING")
    S.register_views(spark, tables={"ev1": rows})
    want = sorted(map(str, pairing.runqueue_latency(rows).collect()))
    for text in ("select * from runqueue_latency(TABLE(ev1))", "SELECT * FROM Runqueue_Latency ( table ( select * from ev1 where event_type <> ')' ) )",
                 "with a as (select * from runqueue_latency(TABLE(ev1))) select * from a -- runqueue_latency(TABLE(nothing))"):
        assert sorted(map(str, S.run_sql(spark, text).collect())) == want
    # text inside strings and names stays as it is, other functions too
    assert S.run_sql(spark, "select 'flame_tree(TABLE(x))' as a, `b` from (select concat('(', ')') as b)").first() == ("flame_tree(TABLE(x))", "()")
    S.register_table_function("twice", lambda df, n, by="seq": df.select((F.col(by) * n).alias("v")))
    got = S.run_sql(spark, "select sum(v) as s from twice(TABLE(ev1), 2 + 1, by => 'timestamp_ns') union all select sum(v) from twice(TABLE(select 7 as seq), n => 2)")
    assert sorted(r["s"] for r in got.collect()) == [14, 120]
    plan = S.run_sql(spark, "select * from twice(TABLE(ev1), 2) where v > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan
    with pytest.raises(ValueError):
        S.run_sql(spark, "select * from twice(TABLE(ev1), 2")
    with pytest.raises(Exception):
        S.run_sql(spark, "select * from twice(TABLE(drop table ev1), 2)")
    assert spark.table("ev1").count() == 2


def test_profiles_from_sql(spark):
    frame = "array<struct<address:decimal(20,0),function_name:string,module_name:string,file_name:string,line_number:int>>"
    schema = f"host STRING, timestamp_ns BIGINT, pid BIGINT, tid BIGINT, comm STRING, count BIGINT, duration_ns BIGINT, user_stack {frame}, kernel_stack {frame}"

    def row(comm, names, count, at):
        return ("h", at, 1, 1, comm, count, 0, [(Decimal(1), n, "", "", 0) for n in names], [])
    df = spark.createDataFrame([row("a", ["leaf", "main"], 3, 1), row("a", ["other", "main"], 2, 2), row("b", ["main"], 1, 3)], schema)
    S.register_views(spark, tables={"stacks1": df})
    got = S.run_sql(spark, "select array_join(path, ';') as p, value from flame_tree(TABLE(stacks1))")
    want = profiles.flame_tree(df).select(F.array_join("path", ";").alias("p"), "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
