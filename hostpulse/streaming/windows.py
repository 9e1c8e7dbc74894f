"""Windowed stream aggregations (append mode: a window is emitted once the watermark passes its end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import sched as S
from hostpulse.operators.profiles import MERGE_KEYS
from hostpulse.operators.stats import _basic, percentile_name


def _watermarked(stream: DataFrame, watermark: str | None) -> DataFrame:
    return stream if watermark is None else stream.withWatermark("ts", watermark)


def _start_ns():
    return (F.unix_micros("window.start") * 1000).alias("window_ns")


def stream_window_stats(stream: DataFrame, window: str = "10 seconds", watermark: str = "10 seconds",
                        percentiles=(0.5, 0.99), min_n: int = 4) -> DataFrame:
    """Window statistics of ``stats.window_stats`` on a stream.

    Late rows are dropped by the watermark.  The state of a group holds its distinct values of one window.
    """
    rows = _watermarked(stream, watermark).select(
        "host", "ts", C.labels_key("labels").alias("labels"), F.explode("fields").alias("field", "value"))
    quantiles = F.percentile("value", F.array(*[F.lit(float(p)) for p in percentiles])).alias("__q")
    out = (rows.where(F.col("value").isNotNull()).groupBy(F.window("ts", window), "host", "labels", "field")
           .agg(*_basic("value"), quantiles))
    named = [F.when(F.col("count") >= min_n, F.col("__q")[i]).alias(percentile_name(p)) for i, p in enumerate(percentiles)]
    return out.select("host", _start_ns(), "labels", "field", "avg", "min", "max", "count", *named)


def stream_profile_counts(stream: DataFrame, window: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """Samples per process, thread, stack pair and comm and window."""
    keys = ["host", "pid", "tid", "kernel_stack_id", "user_stack_id", "comm"]
    out = _watermarked(stream, watermark).groupBy(F.window("ts", window), *keys).agg(F.count(F.lit(1)).alias("count"))
    return out.select(_start_ns(), *keys, "count")


def stream_profile(stream: DataFrame, window: str = "10 seconds", watermark: str = "10 seconds",
                   by: str | None = None) -> DataFrame:
    """Stack samples per window: by thread and addresses (default), or merged by names like ``merge_stacks``."""
    stream = _watermarked(stream, watermark)
    if by is None:
        keys, frame = ["host", "pid", "tid"], lambda kind: (lambda f: f["address"])
    else:
        keys, frame = MERGE_KEYS[by], lambda kind: (lambda f: C.frame_label(f, kind))
    keyed = stream.withColumn("__u", F.transform("user_stack", frame("u"))).withColumn(
        "__k", F.transform("kernel_stack", frame("k")))
    first = F.struct("timestamp_ns", "pid", "tid")
    kept = [c for c in ("pid", "tid", "comm", "user_stack", "kernel_stack") if c not in keys]
    out = keyed.groupBy(F.window("ts", window), *keys, "__u", "__k").agg(
        F.sum("count").alias("count"), F.min_by(F.struct(*kept), first).alias("__first"))
    return out.select(_start_ns(), *keys, "count", "__first.*")


def stream_sched_stats(stream: DataFrame, window: str = "5 seconds", watermark: str | None = "10 seconds") -> DataFrame:
    """Per-process scheduler statistics; ``stream`` carries ``latency_ns``."""
    out = (S.counted_events(_watermarked(stream, watermark))
           .groupBy(F.window("ts", window), "host", F.col("next_pid").alias("pid")).agg(*S.stats_aggregates()))
    return out.withColumn("comm", F.col("__comm.comm")).drop("__comm")


def stream_sched_history(stats: DataFrame) -> DataFrame:
    """Totals per window over ``stream_sched_stats`` (a second windowed aggregation on the same window)."""
    return stats.groupBy("window", "host").agg(*S.history_aggregates())


def window_start(df: DataFrame) -> DataFrame:
    """Replace the window struct by its start in nanoseconds."""
    return df.select(_start_ns(), *[c for c in df.columns if c != "window"])
