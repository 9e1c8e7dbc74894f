"""Scheduler reports: per-process interval statistics, history, histograms, lanes, wakeup graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostpulse.functions import columns as C
from hostpulse.operators.ordered import top_per_key, with_neighbor
from hostpulse.operators.pairing import SLICE_NS, _slice


# Upper bounds (microseconds) and names of the latency buckets.
LATENCY_BUCKETS = (
    (10, "<10us"), (50, "10-50us"), (100, "50-100us"), (500, "100-500us"),
    (1000, "500us-1ms"), (5000, "1-5ms"), (None, ">5ms"),
)


def stats_aggregates():
    """Aggregates of one (interval, pid); shared by the batch and the streaming form."""
    switch = (F.col("event_type") == "switch") & (F.col("next_pid") != 0)
    comm = F.max(F.when(switch, F.struct("timestamp_ns", "seq", F.col("next_comm").alias("comm"))))
    return [
        F.count_if(switch).alias("switch_count"),
        F.coalesce(F.sum(F.when(switch, F.col("latency_ns"))), F.lit(0)).alias("total_runqueue_latency_ns"),
        F.coalesce(F.max(F.when(switch, F.col("latency_ns"))), F.lit(0)).alias("max_runqueue_latency_ns"),
        F.count_if(F.col("event_type") == "migrate").alias("migrate_count"),
        comm.alias("__comm"),
    ]


def counted_events(sched: DataFrame) -> DataFrame:
    """Events that count towards a process: switches to a real task and migrations."""
    return sched.where(((F.col("event_type") == "switch") & (F.col("next_pid") != 0))
                       | (F.col("event_type") == "migrate"))


def sched_stats(sched: DataFrame, window="5 seconds") -> DataFrame:
    """Switches, run-queue latency and migrations per process and interval.

    ``sched`` carries ``latency_ns`` (see ``pairing.runqueue_latency``).
    """
    start = C.floor_to("timestamp_ns", C.duration_ns(window))
    out = (counted_events(sched).groupBy("host", start.alias("window_ns"), F.col("next_pid").alias("pid"))
           .agg(*stats_aggregates()))
    return out.withColumn("comm", F.col("__comm.comm")).drop("__comm")


def history_aggregates():
    avg_us = C.ratio(F.sum("total_runqueue_latency_ns"), F.sum("switch_count")) / 1000.0
    return [
        F.sum("switch_count").alias("total_switches"), avg_us.alias("avg_latency_us"),
        F.max("max_runqueue_latency_ns").alias("max_latency_ns"),
        F.sum("migrate_count").alias("total_migrations"), F.count(F.lit(1)).alias("process_count"),
    ]


def sched_history(stats: DataFrame, keep: int | None = None) -> DataFrame:
    """Totals per interval and host; with ``keep`` the last so many intervals."""
    points = stats.groupBy("host", "window_ns").agg(*history_aggregates())
    return points if keep is None else top_per_key(points, ["host"], [F.col("window_ns").desc()], keep)


def sched_summary(stats: DataFrame) -> DataFrame:
    """Average and maximum run-queue latency in microseconds per row of ``stats``."""
    name = F.coalesce(F.nullif("comm", F.lit("")), F.concat(F.lit("pid:"), F.col("pid").cast("string")))
    keep = [c for c in ("host", "window_ns") if c in stats.columns]
    return stats.select(
        *keep, "pid", name.alias("comm"), "switch_count",
        (C.ratio("total_runqueue_latency_ns", "switch_count") / 1000.0).alias("avg_runqueue_latency_us"),
        (F.col("max_runqueue_latency_ns") / 1000.0).alias("max_runqueue_latency_us"), "migrate_count")


def latency_histogram(summary: DataFrame, buckets=LATENCY_BUCKETS) -> DataFrame:
    """Processes per latency bucket; buckets nobody falls into are present with 0."""
    lat = F.col("avg_runqueue_latency_us")
    counted, lower = [], None
    for upper, name in buckets:
        inside = C.all_of([c for c in (lat >= lower if lower is not None else None,
                                       lat < upper if upper is not None else None) if c is not None])
        counted.append(F.struct(F.lit(name).alias("range"), F.count_if(inside).alias("count")))
        lower = upper
    # one global aggregate with a counter per bucket: no empty bucket can be lost
    one = summary.agg(F.array(*counted).alias("b"))
    return one.select(F.posexplode("b").alias("ord", "bucket")).select(
        F.col("ord").cast("bigint").alias("ord"), "bucket.range", "bucket.count")


def sched_overview(summary: DataFrame) -> DataFrame:
    """Total switches, unweighted mean of the averages, largest maximum."""
    return summary.agg(
        F.coalesce(F.sum("switch_count"), F.lit(0)).alias("total_switches"),
        F.coalesce(F.avg("avg_runqueue_latency_us"), F.lit(0.0)).alias("avg_latency_us"),
        F.coalesce(F.max("max_runqueue_latency_us"), F.lit(0.0)).alias("max_latency_us"))


def wakeup_graph(sched: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (waker, wakee, count) of the last ``limit`` wakeups (None: all) and their endpoints."""
    wakeups = sched.where(F.col("event_type") == "wakeup")
    if limit is not None:
        wakeups = wakeups.orderBy(F.col("timestamp_ns").desc(), F.col("seq").desc()).limit(limit)
    edges = (wakeups.groupBy(F.col("prev_comm").alias("waker"), F.col("next_comm").alias("wakee"))
             .agg(F.count(F.lit(1)).alias("count")))
    nodes = edges.select(F.explode(F.array("waker", "wakee")).alias("comm")).distinct()
    return edges, nodes


def gantt(sched: DataFrame, slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Run blocks per cpu: from a switch to the next switch on that cpu, idle task left out."""
    switches = sched.where(F.col("event_type") == "switch")
    rows = with_neighbor(switches, ["host", "cpu"], ["timestamp_ns", "seq"], ["timestamp_ns"], "__next",
                         _slice(slice_ns), forward=True)
    return (rows.where((F.col("next_pid") != 0) & F.col("__next").isNotNull())
            .select("host", "cpu", F.col("next_comm").alias("comm"), F.col("next_pid").alias("pid"),
                    F.col("timestamp_ns").alias("start_ns"), F.col("__next.timestamp_ns").alias("end_ns")))


def migrations(sched: DataFrame) -> DataFrame:
    """Migration points: time, destination cpu and task."""
    comm = F.coalesce(F.nullif("next_comm", F.lit("")), F.col("prev_comm"))
    return (sched.where(F.col("event_type") == "migrate")
            .select("host", "timestamp_ns", "cpu", F.col("next_pid").alias("pid"), comm.alias("comm")))
