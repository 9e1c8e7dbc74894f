"""Sliced primitives against brute force, with one key holding most rows."""
import bisect
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators.ordered import asof, asof_both, rank_in_order, top_per_key, with_neighbor, with_neighbors


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for seq in range(3000):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(40)}"
        out.append((key, rnd.randrange(20_000), seq, rnd.choice("ab")))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k STRING, t BIGINT, seq BIGINT, v STRING")


def neighbours(rows, step):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = {}
    for group in by.values():
        group.sort(key=lambda r: (r[1], r[2]))
        for i, r in enumerate(group):
            j = i + step
            want[r[2]] = group[j][2] if 0 <= j < len(group) else None
    return want


@pytest.mark.parametrize("width", [None, 10, 700, 10**6])
@pytest.mark.parametrize("forward", [False, True])
def test_neighbor(spark, rows, width, forward):
    slices = None if width is None else C.int_div("t", width)
    df = with_neighbor(frame(spark, rows), ["k"], ["t", "seq"], ["seq", "v"], "n", slices, forward)
    got = {r["seq"]: (r["n"]["seq"] if r["n"] else None) for r in df.collect()}
    assert got == neighbours(rows, 1 if forward else -1)


def test_both_neighbors(spark, rows):
    df = with_neighbors(frame(spark, rows), ["k"], ["t", "seq"], ["seq"], "b", "a", C.int_div("t", 300))
    got = {r["seq"]: (r["b"] and r["b"]["seq"], r["a"] and r["a"]["seq"]) for r in df.collect()}
    back, ahead = neighbours(rows, -1), neighbours(rows, 1)
    assert got == {s: (back[s], ahead[s]) for s in back}


def test_neighbor_of_input_already_partitioned_by_key(spark, rows):
    """A union of equally partitioned inputs must still be shuffled before the window."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    try:
        counted = frame(spark, rows).groupBy("k", "t").agg(F.max("seq").alias("seq"))
        upstream = counted.withColumn("run", F.sum("seq").over(
            __import__("pyspark").sql.Window.partitionBy("k").orderBy("t")))
        df = with_neighbor(upstream, ["k"], ["t"], ["t"], "n", C.int_div("t", 50))
        got = {(r["k"], r["t"]): (r["n"]["t"] if r["n"] else None) for r in df.distinct().collect()}
        distinct = sorted({(r[0], r[1]) for r in rows})
        want = {x: (distinct[i - 1][1] if i and distinct[i - 1][0] == x[0] else None) for i, x in enumerate(distinct)}
        assert got == want
    finally:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")


@pytest.mark.parametrize("width", [None, 64, 5000])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, rows, width, direction):
    rnd = random.Random(3)
    marks = [("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", rnd.randrange(20_000), f"m{i:04d}") for i in range(400)]
    points = frame(spark, rows).select("k", "t", "seq")
    m = spark.createDataFrame(marks, "k STRING, at BIGINT, name STRING")
    got = {r["seq"]: r["hit"]["name"] if r["hit"] else None
           for r in asof(points, m, ["k"], "t", "at", ["name"], "hit", width, direction).collect()}
    by = defaultdict(list)
    for k, at, name in marks:
        by[k].append((at, name))
    want = {}
    for k, t, seq, _ in rows:
        known = sorted(by[k])
        if direction == "backward":
            i = bisect.bisect_right(known, (t, "z")) - 1
            want[seq] = known[i][1] if i >= 0 else None
        else:
            i = bisect.bisect_left(known, (t, ""))
            want[seq] = known[i][1] if i < len(known) else None
    assert got == want


@pytest.mark.parametrize("width", [64, 5000])
def test_asof_both_equals_two_asofs(spark, rows, width):
    rnd = random.Random(5)
    marks = [("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", rnd.randrange(20_000), f"m{i:04d}") for i in range(300)]
    points, m = frame(spark, rows).select("k", "t", "seq"), spark.createDataFrame(marks, "k STRING, at BIGINT, name STRING")
    got = asof_both(points, m, ["k"], "t", "at", ["name"], "b", "a", width).select("seq", "b.name", "a.name").collect()
    back = {r[0]: r[1] for r in asof(points, m, ["k"], "t", "at", ["name"], "x").select("seq", "x.name").collect()}
    ahead = {r[0]: r[1] for r in asof(points, m, ["k"], "t", "at", ["name"], "x", None, "forward").select("seq", "x.name").collect()}
    assert {r[0]: (r[1], r[2]) for r in got} == {q: (back[q], ahead[q]) for q in back}


def test_asof_above_signed_range(spark):
    base = 2**63
    points = spark.createDataFrame([(str(base - 5),), (str(base + 5),), (str(2**64 - 1),)], "a STRING").select(
        F.lit("h").alias("host"), F.col("a").cast(C.ADDRESS).alias("a"))
    marks = spark.createDataFrame([(str(base - 10), "low"), (str(base), "high")], "at STRING, name STRING").select(
        F.lit("h").alias("host"), F.col("at").cast(C.ADDRESS).alias("at"), "name")
    got = [r[0] for r in asof(points, marks, ["host"], "a", "at", ["name"], "s", 16).orderBy("a").select("s.name").collect()]
    assert got == ["low", "high", "high"]


def test_rank_in_order(spark, rows):
    df = rank_in_order(frame(spark, rows), ["k"], ["t", "seq"], C.int_div("t", 100), "pos")
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1], r[2]))
    want = {seq: i for g in by.values() for i, (_, seq) in enumerate(sorted(g))}
    assert {r["seq"]: r["pos"] for r in df.collect()} == want


@pytest.mark.parametrize("n", [3, 1100])
def test_top_per_key(spark, rows, n):
    df = top_per_key(frame(spark, rows), ["k"], [F.col("t").desc(), F.col("seq")], n)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((-r[1], r[2]))
    want = {seq for g in by.values() for _, seq in sorted(g)[:n]}
    assert {r["seq"] for r in df.collect()} == want


def test_small_top_limits_before_the_shuffle(spark, rows):
    df = top_per_key(frame(spark, rows), ["k"], [F.col("t").desc(), F.col("seq")], 5)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
