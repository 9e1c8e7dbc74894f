import math
import random

import pytest
from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import stats

SCHEMA = "host STRING, timestamp_ns BIGINT, labels MAP<STRING,STRING>, fields MAP<STRING,DOUBLE>"


def records(spark, labels, field, values):
    return spark.createDataFrame([("h", i, labels, {field: v}) for i, v in enumerate(values)], SCHEMA)


def test_small_group_has_no_percentiles(spark):
    row = stats.window_stats(records(spark, {"host": "a"}, "load", [10.0, 30.0, 20.0])).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["avg"], r["min"], r["max"], r["count"], r["p50"], r["p99"]) == (20.0, 10.0, 30.0, 3, None, None)


def test_percentile_interpolation(spark):
    r = stats.window_stats(records(spark, {"q": "1"}, "x", [4.0, 2.0, 1.0, 3.0])).collect()[0]
    assert r["p50"] == pytest.approx(2.5, abs=1e-9) and r["p99"] == pytest.approx(3.97, abs=1e-9)


def test_empty_and_zero_window(spark):
    assert stats.window_stats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert stats.window_stats(records(spark, {}, "t", [1.0]), 0).count() == 1


def test_label_order_does_not_matter(spark):
    a = spark.createDataFrame([("h", 1, {"a": "1", "b": "2"}, {"t": 100.0}), ("h", 2, {"b": "2", "a": "1"}, {"t": 200.0})], SCHEMA)
    r = stats.window_stats(a).collect()
    assert len(r) == 1 and r[0]["avg"] == 150.0 and r[0]["count"] == 2


def test_wide_records(spark):
    out = stats.window_stats(records(spark, {"q": "1"}, "x", [1.0, 2.0, 3.0, 4.0]), wide=True).collect()[0]
    assert out["fields"] == pytest.approx({"x_avg": 2.5, "x_min": 1.0, "x_max": 4.0, "x_p50": 2.5, "x_p99": 3.97, "x_count": 4.0})


def percentile(values, p):
    values = sorted(values)
    i = p * (len(values) - 1)
    lo, hi = math.floor(i), math.ceil(i)
    return values[lo] * (1 - (i - lo)) + values[hi] * (i - lo) if lo != hi else values[lo]


@pytest.mark.parametrize("hot_rows", [5, 40, 10**6])
def test_split_percentiles_equal_plain_ones(spark, hot_rows):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 50}", rnd.choice([5.0, 5.0, rnd.random() * 100])) for i in range(3000)]
    rows += [(None, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r["k"]: r for r in stats.exact_percentiles(df, ["k"], "v", [0.0, 0.5, 0.99, 1.0], hot_rows).collect()}
    assert len(got) == len({k for k, _ in rows})
    for k, r in got.items():
        values = [v for kk, v in rows if kk == k]
        assert r["count"] == len(values)
        for name, p in (("p0", 0.0), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0)):
            assert r[name] == pytest.approx(percentile(values, p), abs=1e-9), (k, name)


def test_gauge_and_aggregate_coercions_differ(spark):
    df = spark.sql("""select parse_json(j) as v from values ('true'), ('false'), ('2'), ('2.5'), ('"7"'), ('null') t(j)""")
    got = [(r[0], r[1]) for r in df.select(C.to_gauge("v"), C.agg_numeric("v")).collect()]
    assert got == [(1.0, None), (0.0, None), (2.0, 2.0), (2.5, 2.5), (0.0, None), (0.0, None)]


def test_internal_metrics(spark):
    rows = [("a", "counter", 2.0, 1, 1), ("a", "counter", 3.0, 2, 2), ("g", "gauge", 9.0, 1, 1), ("g", "gauge", 1.5, 2, 2),
            ("l", "latency", 10.0, 1, 1), ("l", "latency", 15.0, 2, 2)]
    df = spark.createDataFrame(rows, "name STRING, kind STRING, value DOUBLE, timestamp_ns BIGINT, seq BIGINT")
    got = {(r["name"], r["stat"]): r["value"] for r in stats.internal_metrics(df).collect()}
    assert got == {("a", "value"): 5.0, ("g", "value"): 1.5, ("l", "count"): 2.0, ("l", "sum"): 25.0, ("l", "avg"): 12.0,
                   ("l", "min"): 10.0, ("l", "max"): 15.0}
    lines = [r["line"] for r in stats.internal_metrics_text(stats.internal_metrics(df), "x").orderBy("name", "ord").collect()]
    assert lines[:4] == ["# TYPE x_a counter", "x_a 5", "# TYPE x_g gauge", "x_g 1.5"]


def test_stage_health_classes(spark):
    rows = [("h", "a", 1, True, 10, 100, 1, 100, 81, 5), ("h", "a", 2, True, 20, 200, 1, 100, 80, 6), ("h", "b", 1, False, 1, 1, 0, 0, 9, 0)]
    df = spark.createDataFrame(rows, "host STRING, name STRING, t BIGINT, running BOOLEAN, batches BIGINT, records BIGINT, "
                                     "errors BIGINT, capacity BIGINT, size BIGINT, dropped BIGINT")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    r = stats.stage_health(df).collect()[0]
    assert (r["running"], r["total"], r["batches"], r["records"], r["dropped"], r["critical"], r["warning"]) == (1, 2, 21, 201, 6, 0, 1)
