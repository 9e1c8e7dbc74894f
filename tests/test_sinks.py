import json

import pytest
from pyspark.sql import functions as F

from hostpulse.plans import registry, sql
from hostpulse.sinks import tables, text
from hostpulse.sources import readers

RECORD = ("host STRING, pipeline STRING, batch_id BIGINT, seq BIGINT, timestamp_ns BIGINT, labels MAP<STRING,STRING>, "
          "fields MAP<STRING,DOUBLE>, fields_str MAP<STRING,STRING>, fields_bool MAP<STRING,BOOLEAN>")
MIN = 60 * 10**9


def rec(spark, *rows):
    """rows: (labels, fields[, text fields[, flags]])"""
    full = [("h", "p", i // 2, i, i * MIN, *(list(r) + [{}, {}])[:4]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RECORD)


def exposition(df, prefix="pfx"):
    return [r["line"] for r in text.prometheus_exposition(df, prefix).orderBy("metric", "ord", "labels_text").collect()]


def test_prometheus_names_labels_and_last_value(spark):
    df = rec(spark, ({"node": "n1"}, {"bad@key#mode": 10.5}), ({"node": "n1"}, {"bad@key#mode": 42.125}),
             ({"job": 'agent"'}, {"t": 1.0}), ({}, {"t": 2.0}, {"s": "x"}, {"b": True}))
    assert exposition(df) == [
        "# HELP pfx_b gauge of pfx_b", "# TYPE pfx_b gauge", "pfx_b 1.0",
        "# HELP pfx_bad_key_mode gauge of pfx_bad_key_mode", "# TYPE pfx_bad_key_mode gauge", 'pfx_bad_key_mode{node="n1"} 42.125',
        "# HELP pfx_s gauge of pfx_s", "# TYPE pfx_s gauge", "pfx_s 0.0",
        "# HELP pfx_t gauge of pfx_t", "# TYPE pfx_t gauge", "pfx_t 2.0", 'pfx_t{job="agent\\""} 1.0']
    numbers = [r["line_no"] for r in text.numbered_lines(text.prometheus_exposition(df, "pfx")).collect()]
    assert numbers == sorted(numbers) and len(set(numbers)) == 13


def test_json_lines(spark):
    df = rec(spark, ({"svc": "unit"}, {"value": 2.25}), ({}, {"value": -7.0}))
    got = [json.loads(r["value"]) for r in text.export_jsonl(df).collect()]
    assert got == [{"fields": {"value": 2.25}, "labels": {"svc": "unit"}}, {"fields": {"value": -7.0}, "labels": {}}]


def test_otlp_is_valid_json(spark):
    df = rec(spark, ({"q": 'quo"te'}, {"a": 1.5}), ({}, {"a": 2.0}, {}, {"f": True}))
    docs = [json.loads(r["payload"]) for r in text.otlp_payload(df).collect()]
    metrics = docs[0]["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]
    assert [(m["name"], m["gauge"]["dataPoints"][0]["asDouble"]) for m in metrics] == [("a", 1.5), ("a", 2.0), ("f", 1.0)]
    point = metrics[0]["gauge"]["dataPoints"][0]
    assert point["attributes"] == [{"key": "q", "value": {"stringValue": 'quo"te'}}] and point["timeUnixNano"] == 0
    assert "attributes" not in metrics[1]["gauge"]["dataPoints"][0]


def test_oversized_batch_is_split_and_whole(spark):
    df = spark.range(1000).select(F.lit("h").alias("host"), F.lit("p").alias("pipeline"), F.lit(1).cast("bigint").alias("batch_id"),
                                  F.col("id").alias("seq"), F.col("id").alias("timestamp_ns"), F.create_map(F.lit("a"), F.lit("b")).alias("labels"),
                                  F.create_map(F.lit("v"), F.col("id").cast("double")).alias("fields"))
    docs = text.batch_json(df, max_items=100).collect()
    assert len(docs) > 5
    values = sorted(int(r["fields"]["v"]) for d in docs for r in json.loads(d["document"])["records"])
    assert values == list(range(1000))


def test_batch_document_without_samples(spark):
    docs = text.batch_json(rec(spark, ({}, {"a": 1.0}))).collect()
    assert json.loads(docs[0]["document"]) == {"pipeline": "p", "records": [{"fields": {"a": 1.0}, "labels": {}}]}


def test_console_text(spark):
    df = rec(spark, ({"k": "v"}, {"x": 1.0}, {"s": "t", "n": None}, {"b": False}))
    assert text.format_records(df).first()[0] == "[0] {k=v} x=1.000 s=t b=false"


def test_recent_batches(spark):
    df = spark.createDataFrame([(k, i, j) for k in ("pipe_a", "pipe_b", None) for i in range(5) for j in range(3)],
                               "pipeline STRING, batch_id BIGINT, j INT")
    got = tables.recent_batches(df, n=3)
    assert {(r["pipeline"], r["batch_id"]) for r in got.collect()} == {(k, i) for k in ("pipe_a", "pipe_b", "default") for i in (2, 3, 4)}
    assert got.count() == 27
    assert [r["batch_id"] for r in tables.recent_batches(df.where("pipeline = 'pipe_a'"), n=2).collect()] == [3] * 3 + [4] * 3
    assert {r["batch_id"] for r in tables.latest_batch(df).collect()} == {4}


def test_store_range_and_retention(spark, tmp_path):
    path = str(tmp_path / "records")
    day = 1440 * MIN
    rows = [("h", p, 0, i, 5 * day + i * 10 * 10**9, {"source": "s", "cpu": "0"}, {"user_pct": 42.5, "idle_pct": 57.5}, {}, {})
            for p in ("a", "b") for i in range(5)]
    tables.write_records(spark.createDataFrame(rows, RECORD), path)
    old = [("h", "a", 0, 100 + i, i * day, {}, {}, {}, {}) for i in range(5)]
    tables.write_records(spark.createDataFrame(old, RECORD), path)
    stored = readers.read_table(spark, path)
    s = 10**9
    hit = readers.query_records(stored, "a", 5 * day + 10 * s, 5 * day + 30 * s)
    assert [r["seq"] for r in hit.collect()] == [3, 2, 1]
    assert hit.first()["fields"] == {"user_pct": 42.5, "idle_pct": 57.5}
    assert "PartitionFilters: [isnotnull(pipeline" in hit._jdf.queryExecution().executedPlan().toString()
    assert readers.query_records(stored, "a", limit=4, descending=False).count() == 4
    tables.prune_table(spark, path, 0, 10 * day)
    assert readers.read_table(spark, path).count() == 15
    tables.prune_table(spark, path, 2 * day, 5 * day + 20 * s)     # cutoff in the middle of day 3
    left = readers.read_table(spark, path)
    assert sorted(r["seq"] for r in left.where("pipeline = 'a'").collect()) == [0, 1, 2, 3, 4, 104]
    tables.prune_table(spark, path, 10 * s, 5 * day + 40 * s)      # strict: the row at the cutoff stays
    assert sorted(r["seq"] for r in readers.read_table(spark, path).where("pipeline = 'b'").collect()) == [3, 4]
    tables.compact_table(spark, path)
    assert readers.read_table(spark, path).count() == 4


def test_profiles_overlap(spark):
    df = spark.createDataFrame([("p", "cpu", 1000 * i, 1000 * i + 500, 1) for i in range(1, 5)],
                               "pipeline STRING, profile_type STRING, start_ns BIGINT, end_ns BIGINT, sample_count BIGINT")
    assert [r["start_ns"] for r in readers.list_profiles(df, "p", 1000, 2500).collect()] == [2000, 1000]
    assert readers.list_profiles(df, "p").count() == 4


def test_decode_bad_json(spark):
    df = spark.createDataFrame([('{"a":"b"}', '{"i":1,"d":2.5,"b":true,"s":"x","n":null}'), ("{", "["), (None, None)],
                               "labels_json STRING, fields_json STRING")
    got = [(r["labels"], r["fields"], r["fields_str"], r["fields_bool"]) for r in readers.decode_records(df).collect()]
    assert got == [({"a": "b"}, {"i": 1.0, "d": 2.5}, {"s": "x"}, {"b": True}), ({}, {}, {}, {}), ({}, {}, {}, {})]


@pytest.mark.parametrize("bad", ["DROP TABLE t", "delete from t", "INSERT INTO t VALUES (1)", "update t set a=1", "", "  ",
                                 "PRAGMA journal_mode", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"])
def test_sql_refuses(spark, bad):
    with pytest.raises(Exception):
        sql.run_sql(spark, bad)


def test_sql_allows(spark):
    sql.register_views(spark, tables={"nums": spark.range(2000)})
    assert sql.run_sql(spark, " select id from nums").count() == 2000        # no silent cut
    assert sql.run_sql(spark, " select id from nums", limit=1000).count() == 1000
    assert sql.run_sql(spark, "with a as (select 1 as x) select * from a;").first()[0] == 1
    assert sql.run_sql(spark, "EXPLAIN SELECT 1").count() == 1
    assert sql.run_sql(spark, "PRAGMA table_info(nums)").first()[0] == "id"
    row = sql.run_sql(spark, "select cast('x' as binary) as b, cast(null as binary) as n").first()
    assert (row["b"], row["n"]) == ("[blob]", None)


def test_chain_errors(spark):
    with pytest.raises(registry.SpecError):
        registry.Pipeline({"sinks": ["console"]})
    with pytest.raises(registry.SpecError):
        registry.Pipeline({"source": "events"})
    with pytest.raises(registry.SpecError):
        registry.Pipeline({"source": "events", "sinks": ["console"], "processors": ["no_such_stage"]})


def test_chain_runs_and_counts_failing_sinks(spark):
    seen = []
    registry.register_source("ten", lambda s: s.range(10))
    registry.register_processor("even", lambda df: df.where("id % 2 = 0"))
    registry.register_aggregator("total", lambda df: df.agg(F.sum("id").alias("t")))

    @registry.register_sink("keep")
    def keep(df, batch_id):
        seen.append(df.first()["t"])

    @registry.register_sink("fail")
    def fail(df, batch_id):
        raise RuntimeError("down")

    errors = registry.start_pipeline(spark, {"source": "ten", "processors": ["even"], "aggregator": "total", "sinks": ["fail", "keep"]})
    assert seen == [20] and sum(errors.values()) == 1


def test_equal_column_names_and_stored_views(spark, tmp_path):
    assert tuple(sql.run_sql(spark, "select 1 as a, 2 as a, 3 as `count(1)`").first()) == (2, 3)
    tables.write_records(rec(spark, ({"k": "v"}, {"x": 1.0})), str(tmp_path / "records"))
    assert sql.register_views(spark, str(tmp_path)) == ["records"]
    assert sql.run_sql(spark, "SELECT pipeline, fields['x'] AS x FROM records").first()["x"] == 1.0


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    tables.write_profiles(spark.createDataFrame([("h", "p", "cpu", 1, 2, 3, b"x")], "host STRING, pipeline STRING, "
                          "profile_type STRING, start_ns BIGINT, end_ns BIGINT, sample_count BIGINT, data BINARY"), str(tmp_path / "profiles"))
    plan = readers.list_profiles(spark.read.parquet(str(tmp_path / "profiles")), "p", 1)._jdf.queryExecution().executedPlan().toString()
    assert "data:binary" not in plan and "GreaterThanOrEqual(end_ns,1)" in plan


ODD = ["1", "007", "a/b", "c:d", None]


def odd_store(spark, path):
    day = 1440 * MIN
    rows = [("h", p, 0, 10 * d + k, d * day + k * 10 * 10**9, {}, {"x": 1.0}, {}, {}) for p in ODD for d in range(3) for k in range(5)]
    tables.write_records(spark.createDataFrame(rows, RECORD), path)
    return day


def test_retention_keeps_odd_pipelines(spark, tmp_path):
    path = str(tmp_path / "odd")
    day = odd_store(spark, path)
    tables.prune_table(spark, path, 10**9, day + 20 * 10**9 + 10**9)      # day 1 from its third row on
    left = readers.read_table(spark, path)
    assert sorted(str(r[0]) for r in left.select("pipeline").distinct().collect()) == sorted(map(str, ODD))
    for p in ODD:
        assert sorted(r["seq"] for r in left.where(F.col("pipeline").eqNullSafe(p)).collect()) == [12, 13, 14, 20, 21, 22, 23, 24]
    tables.prune_table(spark, path, 10**9, 2 * day + 60 * 10**9)          # nothing of day 2 is left: its folders go
    assert readers.read_table(spark, path).count() == 0 if list((tmp_path / "odd").glob("*/*/*.parquet")) else True


def test_compaction_makes_few_files(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(60_000).select(F.lit("h").alias("host"), F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("pipeline"),
                                      (F.col("id") * 86400 * 10**9 % (3 * 86400 * 10**9)).alias("timestamp_ns"), F.sha2(F.col("id").cast("string"), 512).alias("data"))
    for _ in range(2):
        tables.write_records(rows.repartition(10), path)
    before = readers.read_table(spark, path)
    want = before.agg(F.count("*"), F.sum(F.xxhash64("pipeline", "data", "timestamp_ns") % 1000)).first()
    tables.compact_table(spark, path, 64)
    files = list((tmp_path / "many").rglob("*.parquet"))
    assert len(files) <= 6 + 2 and not list(tmp_path.glob("many.*"))      # six pipeline-dates
    assert readers.read_table(spark, path).agg(F.count("*"), F.sum(F.xxhash64("pipeline", "data", "timestamp_ns") % 1000)).first() == want


def test_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "batches")
    frame = lambda i: spark.createDataFrame([("h", p, 0, i, i * 10**9, {}, {"x": 1.0}, {}, {}) for p in ODD], RECORD)
    for i in (0, 1, 1, 0, 2):
        tables.write_records(frame(i), path, batch_id=i)
    assert sorted(r["seq"] for r in readers.read_table(spark, path).collect()) == [i for i in range(3) for _ in ODD]
    flat = str(tmp_path / "flat")
    for i in (0, 1, 1):
        tables.publish(spark.range(3), flat, i)
    assert spark.read.parquet(flat).count() == 6


def test_failed_sink_gets_its_batches_later(spark, tmp_path):
    got, down = [], [True]

    def sometimes(df, batch_id):
        if down[0]:
            raise RuntimeError("down")
        got.append((batch_id, df.count()))

    steady = []
    fan = tables.fan_out([sometimes, lambda df, i: steady.append(df.count())], str(tmp_path / "spool"))
    for i in range(2):
        fan(spark.range(5 + i), i)
    assert steady == [5, 6] and fan.errors["sometimes"] == 2 and fan.replay(spark) == 2
    down[0] = False
    assert fan.replay(spark) == 0 and got == [(0, 5), (1, 6)] and not list((tmp_path / "spool").glob("batch=*"))


def test_recent_batches_stage(spark, tmp_path):
    keep = tables.RecentBatches(str(tmp_path / "recent"), 2)
    for i in (0, 1, 1, 2, 3):
        keep(spark.createDataFrame([("p", i)], "pipeline STRING, n BIGINT"), i)
    assert sorted(r["n"] for r in keep.read(spark).collect()) == [2, 3]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from hostpulse.session import durable_dir
    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        durable_dir(cluster, "x")
