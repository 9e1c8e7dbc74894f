"""Live forms of pairing and counter rates.

Operators built on the previous row of a key run on streams as they are (run-queue latency, off-CPU
intervals, block I/O latency, allocations, utilization, system rates, averages); here are the forms that
need an extra argument on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import pairing, series
from hostpulse.operators.ordered import with_neighbor


def stream_pair(stream: DataFrame, keys, order, is_open: Column, is_close: Column, carry, out: str = "opened",
                ttl_ms: int | None = None) -> DataFrame:
    """Pairing that forgets a key once the watermark is ``ttl_ms`` past its last event (needs a watermark)."""
    return pairing.pair_events(stream, keys, order, is_open, is_close, carry, out, ttl_ms=ttl_ms)


def stream_rates(counters: DataFrame, per_core: bool = True) -> DataFrame:
    """Utilization per cpu between consecutive snapshots."""
    return series.cpu_utilization(counters, per_core)


def stream_process_cpu(counters: DataFrame, interval_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """CPU percent per process between consecutive snapshots.

    A stream cannot look at a whole snapshot, so a predecessor counts if it is at most one and a half
    ``interval_ms`` old.  The top of a snapshot is taken per micro-batch (``series.top_n_per``).
    """
    rows = with_neighbor(counters, ["host", "pid"], ["ts"], ["ts", "utime", "stime", "total_jiffies"], "__p", ttl_ms=ttl_ms)
    age = F.unix_micros("ts") - F.unix_micros("__p.ts")
    rows = rows.where(F.col("__p").isNotNull() & (age <= interval_ms * 1500))
    delta = F.col("total_jiffies") - F.col("__p.total_jiffies")
    rows = rows.withColumn("delta_total", F.when(delta == 0, 1).otherwise(delta))
    return (series.with_cpu_pct(rows).withColumn("rss_kb", F.col("rss_pages") * 4)
            .withColumn("vsize_kb", C.int_div("vsize", 1024)).drop("__p", "delta_total"))
