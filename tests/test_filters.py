import pytest
from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import filters, rank, sched


def labelled(spark, *maps):
    return spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i INT, labels MAP<STRING,STRING>")


def test_exclude_label_keeps_records_without_it(spark):
    df = labelled(spark, {"host": "h1"}, {"host": "h2", "cpu": "cpu0"}, None)
    assert sorted(r["i"] for r in filters.exclude_label(df, "cpu", "cpu0").collect()) == [0, 2]
    assert filters.exclude_label(df, "", "cpu0").count() == 3


def test_allow_lists_agree(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(3000)], "prev_pid BIGINT, next_pid BIGINT")
    cols = ("prev_pid", "next_pid")
    few = filters.allow_pids(df, [5, 6], cols)
    assert sorted(r[0] for r in few.collect()) == [4, 5, 6]
    many = filters.allow_pids(df, range(10, 1510), cols)
    assert sorted(r[0] for r in many.collect()) == list(range(9, 1510))
    assert many.columns == df.columns
    assert filters.allow_pids(df, []).count() == 3000


def test_cpu_sample_filter_long_names(spark):
    df = spark.createDataFrame([(1, "twentycharacterslong"), (2, "twentycharacte")], "pid BIGINT, comm STRING")
    assert [r["pid"] for r in filters.filter_cpu_samples(df, comms=["twentycharacterslong"]).collect()] == [1]


def test_comm_patterns_are_java_s(spark, caplog):
    df = spark.createDataFrame([(1, "abc"), (2, "a1")], "pid BIGINT, comm STRING")
    pids = lambda **how: [r["pid"] for r in filters.filter_comm(df, **how).collect()]
    assert pids(include=r"^\p{L}+$") == [1]
    assert pids(include="(?P<x>a)") == [1, 2] and "not valid" in caplog.text
    assert pids(exclude="[") == [1, 2]


def test_cpu_sample_filter(spark):
    df = spark.createDataFrame([(0, "a"), (1, "averyveryverylo"), (2, "b")], "pid BIGINT, comm STRING")
    assert [r["pid"] for r in filters.filter_cpu_samples(df, comms=["averyveryverylongname"]).collect()] == [1]
    assert filters.filter_cpu_samples(df).count() == 2
    assert filters.filter_cpu_samples(df, [2], ["a"]).count() == 0


def test_comm_regex(spark):
    df = spark.createDataFrame([("nginx",), ("kworker/0",), ("java",)], "comm STRING")
    assert filters.filter_comm(df, ".*").count() == 3
    assert filters.filter_comm(df, "work").count() == 1          # unanchored
    assert filters.filter_comm(df, "(", "[").count() == 3        # invalid patterns are ignored
    assert filters.filter_comm(df, None, "^k").count() == 2


def test_recent_events_ascending(spark):
    df = spark.createDataFrame([(i, i, i % 3, i % 5) for i in range(50)], "seq BIGINT, timestamp_ns BIGINT, prev_pid BIGINT, next_pid BIGINT")
    assert [r["seq"] for r in filters.recent_events(df, 0, 3).collect()] == [47, 48, 49]
    got = [r["seq"] for r in filters.recent_events(df, 4, 2).collect()]
    assert got == [44, 49]


def test_decode_sched_codes(spark):
    df = spark.createDataFrame([(0, 1999), (1, 0), (2, 5), (7, 1000)], "event_type INT, latency_ns BIGINT")
    assert [tuple(r) for r in filters.decode_sched(df).select("event_type", "latency_us").collect()] == [
        ("switch", 1), ("wakeup", 0), ("migrate", 0), ("switch", 1)]


def test_sockets(spark):
    df = spark.createDataFrame([(2, 1, 16777343, 1), (2, 7, 1, 1), (2, 4, 1, 1), (10, 1, 1, 1)],
                               "family INT, newstate INT, saddr BIGINT, daddr BIGINT")
    got = [(r["event_name"], r["saddr_text"]) for r in filters.classify_sockets(df).collect()]
    assert got == [("connect", "127.0.0.1"), ("close", "1.0.0.0")]


def test_normalize_labels(spark):
    rows = ['[{"key":"a","value":"1"},{"name":"b","val":"2"},{"x":"y"}]', '{"a":"1","b":null}', "nonsense", None]
    df = spark.createDataFrame([(r,) for r in rows], "j STRING").select(filters.normalize_labels("j").alias("m"))
    assert [r["m"] for r in df.collect()] == [{"a": "1", "b": "2"}, {"a": "1", "b": ""}, {}, {}]


def test_allow_list_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id").alias("pid"), F.lit("c").alias("comm")).write.parquet(path)
    plan = filters.allow_pids(spark.read.parquet(path), [3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(pid), EqualTo(pid,3)]" in plan


def test_latency_histogram_has_every_bucket(spark):
    s = spark.createDataFrame([(9.99,), (10.0,), (5000.0,)], "avg_runqueue_latency_us DOUBLE")
    got = [(r["range"], r["count"]) for r in sched.latency_histogram(s).orderBy("ord").collect()]
    assert got == [("<10us", 1), ("10-50us", 1), ("50-100us", 0), ("100-500us", 0), ("500us-1ms", 0), ("1-5ms", 0), (">5ms", 1)]
    empty = sched.latency_histogram(s.where("false"))
    assert empty.count() == 7 and empty.agg(F.sum("count")).first()[0] == 0


def test_overview_of_nothing(spark):
    s = spark.createDataFrame([], "switch_count BIGINT, avg_runqueue_latency_us DOUBLE, max_runqueue_latency_us DOUBLE")
    assert tuple(sched.sched_overview(s).first()) == (0, 0.0, 0.0)


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x INT"), spark.createDataFrame([("q",)], "y STRING")
    assert sorted(map(tuple, rank.union_pipelines([a, b]).collect()), key=str) == [(1, None), (None, "q")]


@pytest.mark.parametrize("text,want", [("cpu12", 12), ("node1-cpu3x", 3), ("cpu", 0)])
def test_core_sort_key(spark, text, want):
    assert spark.range(1).select(C.core_sort_key(F.lit(text))).first()[0] == want


def test_hex_and_lists(spark):
    row = spark.range(1).select(
        C.address_hex(F.lit("18446744073709551615").cast(C.ADDRESS)), C.address_hex(F.lit("255").cast(C.ADDRESS)),
        C.parse_hex(F.lit("ffffffff81000000")).cast("string"), C.parse_csv_list(F.lit(" 1, x,,3 "), "int"),
        C.parse_csv_list(F.lit(" a ,,b")), C.round_half_up(F.lit(-0.5)), C.escape_label(F.lit('a\\"\n'))).first()
    assert list(row) == ["ffffffffffffffff", "ff", "18446744071578845184", [1, 3], ["a", "b"], 0, 'a\\\\\\"\\n']
