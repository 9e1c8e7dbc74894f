"""Event pairing: the latest open event of a key is consumed by the next close event.

Among the open and close rows of one key in time order, a close matches exactly when the row
before it is an open, so each operator here is one neighbour lookup, never a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostpulse.functions import columns as C
from hostpulse.operators.ordered import with_neighbor

# A key is cut every minute of event time: one year of one key is 525,600 border rows, while the
# rows of one task are what one key produces in a minute.
SLICE_NS = 60 * 10**9


def _slice(slice_ns: int | None, ts: str = "timestamp_ns") -> Column | None:
    return None if slice_ns is None else C.int_div(ts, slice_ns)


def pair_events(df: DataFrame, keys, order, is_open: Column, is_close: Column, carry,
                out: str = "opened", slice_ns: int | None = SLICE_NS, ts: str = "timestamp_ns",
                ttl_ms: int | None = None) -> DataFrame:
    """Close rows with struct ``out`` holding ``carry`` of the matching open row (NULL: unmatched).

    On a stream an open row waits as state of its key, for at most ``ttl_ms`` if given.
    """
    rows = df.where(is_open | is_close).withColumn("__open", F.coalesce(is_open, F.lit(False)))
    rows = with_neighbor(rows, keys, order, [*carry, "__open"], "__before", _slice(slice_ns, ts),
                         ttl_ms=ttl_ms)
    matched = F.when(F.col("__before.__open"), F.struct(*[F.col(f"__before.{c}").alias(c) for c in carry]))
    return rows.where(~F.col("__open")).withColumn(out, matched).drop("__before", "__open")


def runqueue_latency(sched_raw: DataFrame, slice_ns: int | None = SLICE_NS) -> DataFrame:
    """All scheduler events with ``latency_ns``: switch minus the pending wakeup of next_pid, else 0."""
    waits = F.col("event_type").isin("switch", "wakeup")
    rows = sched_raw.withColumn("__waits", waits)
    rows = with_neighbor(rows, ["host", "next_pid", "__waits"], ["timestamp_ns", "seq"],
                         ["timestamp_ns", "event_type"], "__before", _slice(slice_ns))
    woken = (F.col("event_type") == "switch") & (F.col("__before.event_type") == "wakeup")
    latency = F.when(woken, F.col("timestamp_ns") - F.col("__before.timestamp_ns")).otherwise(F.lit(0).cast("bigint"))
    return rows.withColumn("latency_ns", latency).drop("__before", "__waits")


def _event_time(df: DataFrame) -> list[str]:
    """The column of a stream's watermark, if it has one."""
    if not df.isStreaming:
        return []
    from hostpulse.streaming.stateful import event_time_column
    name = event_time_column(df)
    return [name] if name else []


def offcpu_intervals(switches: DataFrame, min_duration_ns: int = 100_000,
                     slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Intervals a task spent off CPU: leave (as prev_pid) to return (as next_pid).

    Stacks and comm come from the leave, cpu from the return; intervals shorter than
    ``min_duration_ns`` are dropped but still use up their leave.
    """
    has_stacks = "kernel_stack_id" in switches.columns
    time = _event_time(switches)        # a stream's rows wait for its watermark
    stack = {c: F.col(c) if has_stacks else F.lit(0) for c in ("kernel_stack_id", "user_stack_id")}
    leave = F.struct(F.lit(0).alias("ord"), F.col("prev_pid").alias("pid"), F.col("prev_comm").alias("comm"))
    back = F.struct(F.lit(1).alias("ord"), F.col("next_pid").alias("pid"), F.col("next_comm").alias("comm"))
    rows = (switches.where(F.col("event_type") == "switch")
            .select("host", "seq", "timestamp_ns", "cpu", *time, *[c.alias(n) for n, c in stack.items()],
                    F.inline(F.array(leave, back)))
            .where(F.col("pid") != 0))
    pairs = pair_events(rows, ["host", "pid"], ["timestamp_ns", "seq", "ord"], F.col("ord") == 0,
                        F.col("ord") == 1, ["timestamp_ns", "comm", "kernel_stack_id", "user_stack_id"],
                        slice_ns=slice_ns)
    return (pairs.where(F.col("opened").isNotNull())
            .select("host", F.col("opened.timestamp_ns").alias("timestamp_ns"), "pid",
                    F.col("pid").alias("tid"), "cpu", F.col("opened.comm").alias("comm"),
                    (F.col("timestamp_ns") - F.col("opened.timestamp_ns")).alias("duration_ns"),
                    F.col("opened.kernel_stack_id").alias("kernel_stack_id"),
                    F.col("opened.user_stack_id").alias("user_stack_id"))
            .where(F.col("duration_ns") >= min_duration_ns))


def block_io_latency(block_raw: DataFrame, keys=("sector",), slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Completed block requests with issue-to-complete latency; pid and comm are the issuer's."""
    pairs = pair_events(block_raw, ["host", *keys], ["timestamp_ns", "seq"], F.col("phase") == "issue",
                        F.col("phase") == "complete", ["timestamp_ns", "pid", "tid", "comm"], slice_ns=slice_ns)
    write = F.coalesce(F.substring("rwbs", 1, 1) == "W", F.lit(False))
    return (pairs.where(F.col("opened").isNotNull())
            .select("host", "seq", "timestamp_ns", F.col("opened.pid").alias("pid"),
                    F.col("opened.tid").alias("tid"), F.col("opened.comm").alias("comm"),
                    (F.col("timestamp_ns") - F.col("opened.timestamp_ns")).alias("latency_ns"),
                    "dev", "sector", "nr_sector", write.cast("int").alias("rwflag")))


def pair_allocations(alloc_raw: DataFrame, keys=("addr",), slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Allocation events as recorded: allocs, and frees of known addresses with the size they release."""
    known = alloc_raw.where(F.col("addr") != 0)
    is_alloc = F.col("op") == "alloc"
    rows = with_neighbor(known.where(F.col("op").isin("alloc", "free")), ["host", *keys],
                         ["timestamp_ns", "seq"], ["timestamp_ns", "op", "size"], "__before", _slice(slice_ns))
    frees = (F.col("op") == "free") & (F.col("__before.op") == "alloc")
    return (rows.where(is_alloc | frees)
            .withColumn("size", F.when(is_alloc, F.col("size")).otherwise(F.col("__before.size")))
            .withColumn("lifetime_ns", F.when(~is_alloc, F.col("timestamp_ns") - F.col("__before.timestamp_ns")))
            .drop("__before"))


def live_allocations(alloc_raw: DataFrame, as_of_ns: int | None = None, keys=("addr",),
                     slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Allocations whose address sees no later event: what is still held at ``as_of_ns``."""
    rows = alloc_raw.where((F.col("addr") != 0) & F.col("op").isin("alloc", "free"))
    if as_of_ns is not None:
        rows = rows.where(F.col("timestamp_ns") <= as_of_ns)
    rows = with_neighbor(rows, ["host", *keys], ["timestamp_ns", "seq"], ["op"], "__after", _slice(slice_ns),
                         forward=True)
    live = rows.where((F.col("op") == "alloc") & F.col("__after").isNull()).drop("__after")
    if as_of_ns is not None:
        live = live.withColumn("age_ns", F.lit(as_of_ns) - F.col("timestamp_ns"))
    return live


def live_allocation_summary(live: DataFrame) -> DataFrame:
    """Live bytes and allocation count by process, with the oldest allocation time."""
    return live.groupBy("host", "pid", "comm").agg(
        F.sum("size").alias("live_bytes"), F.count(F.lit(1)).alias("allocations"),
        F.min("timestamp_ns").alias("oldest_ns"))


def connection_durations(sock_events: DataFrame, slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Connect-to-close time per process and 4-tuple; closes without a connect are dropped.

    Expects classified socket rows (``event_name`` of ``filters.classify_sockets``).
    """
    pairs = pair_events(sock_events, ["host", "pid", "saddr", "daddr", "sport", "dport"],
                        ["timestamp_ns", "seq"], F.col("event_name") == "connect",
                        F.col("event_name") == "close", ["timestamp_ns"], slice_ns=slice_ns)
    return (pairs.where(F.col("opened").isNotNull())
            .withColumn("connected_ns", F.col("opened.timestamp_ns"))
            .withColumn("duration_ns", F.col("timestamp_ns") - F.col("connected_ns"))
            .drop("opened"))
