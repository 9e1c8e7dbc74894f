"""Filters and decoders: plain Column predicates, so Spark can push them into the scan."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, functions as F

from hostpulse.functions import columns as C

log = logging.getLogger(__name__)

COMM_LENGTH = 15          # characters of a task name that the kernel shows
ISIN_LIMIT = 1000         # longer allow-lists are joined instead of inlined

# TCP states and event names.
AF_INET = 2
TCP_ESTABLISHED, TCP_CLOSE = 1, 7
SOCKET_EVENTS = ("connect", "accept", "close")


def passthrough(df: DataFrame) -> DataFrame:
    return df


def exclude_label(df: DataFrame, key: str, value: str) -> DataFrame:
    """Drop records whose label ``key`` equals ``value``; records without the label stay."""
    if not key:
        return df
    return df.where(~F.coalesce(F.try_element_at("labels", F.lit(key)) == value, F.lit(False)))


def allow_pids(df: DataFrame, pids, cols=("pid",)) -> DataFrame:
    """Keep rows where any of ``cols`` is allowed; an empty list allows all."""
    pids = sorted(set(pids))
    if not pids:
        return df
    if len(pids) <= ISIN_LIMIT:
        return df.where(C.any_of([F.col(c).isin(pids) for c in cols]))
    allowed = df.sparkSession.createDataFrame([(int(p),) for p in pids], "__pid BIGINT")
    # one equi join per column keeps this a hash join; the rows are not duplicated by a semi join
    marked = df
    for i, c in enumerate(cols):
        hit = allowed.select(F.col("__pid").alias(f"__pid{i}"), F.lit(True).alias(f"__hit{i}"))
        marked = marked.join(hit, F.col(c) == F.col(f"__pid{i}"), "left")
    keep = C.any_of([F.coalesce(F.col(f"__hit{i}"), F.lit(False)) for i in range(len(cols))])
    return marked.where(keep).select(*df.columns)


def filter_cpu_samples(df: DataFrame, pids=(), comms=()) -> DataFrame:
    """Drop the idle task; optional pid set AND optional exact comm set (15 characters of both sides)."""
    conditions = [F.col("pid") != 0]
    if comms:
        conditions.append(F.substring("comm", 1, COMM_LENGTH).isin([c[:COMM_LENGTH] for c in comms]))
    return allow_pids(df.where(C.all_of(conditions)), pids)


def _usable(df: DataFrame, pattern: str | None) -> bool:
    """Whether Java, which runs the match, can compile the pattern."""
    if not pattern:
        return False
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        log.warning("comm pattern %r is not valid and filters nothing", pattern)
        return False
    return True


def filter_comm(df: DataFrame, include: str | None = None, exclude: str | None = None, column: str = "comm") -> DataFrame:
    """Unanchored regex filters on comm (Java dialect); ``.*`` or an invalid pattern is no filter."""
    if include != ".*" and _usable(df, include):
        df = df.where(F.col(column).rlike(include))
    if _usable(df, exclude):
        df = df.where(~F.col(column).rlike(exclude))
    return df


def search_processes(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of comm, or substring of the pid text."""
    if not text:
        return df
    return df.where(F.lower("comm").contains(text.lower()) | F.col("pid").cast("string").contains(text))


def recent_events(df: DataFrame, pid: int = 0, limit: int = 200) -> DataFrame:
    """Last ``limit`` scheduler events, optionally of one pid, oldest first."""
    if pid:
        df = df.where((F.col("prev_pid") == pid) | (F.col("next_pid") == pid))
    last = df.orderBy(F.col("timestamp_ns").desc(), F.col("seq").desc()).limit(limit)
    return last.orderBy("timestamp_ns", "seq")


def decode_sched(df: DataFrame) -> DataFrame:
    """Event code to name (names pass through) and whole-microsecond latency."""
    code = F.col("event_type").try_cast("int") if dict(df.dtypes)["event_type"] == "string" else F.col("event_type")
    name = F.when(code.isNotNull(), C.event_type_name(code)).otherwise(F.col("event_type").cast("string"))
    return df.withColumn("event_type", name).withColumn("latency_us", C.us("latency_ns"))


def decode_block_io(df: DataFrame) -> DataFrame:
    """Latency in microseconds and ``rw`` from the write flag."""
    return df.withColumn("latency_us", C.us("latency_ns")).withColumn(
        "rw", F.when(F.col("rwflag") == 1, "write").otherwise("read"))


def classify_sockets(df: DataFrame) -> DataFrame:
    """IPv4 state changes that open or close a connection; everything else is dropped."""
    event = F.when(F.col("newstate") == TCP_ESTABLISHED, 0).when(F.col("newstate") == TCP_CLOSE, 2)
    out = df.where((F.col("family") == AF_INET) & F.col("newstate").isin(TCP_ESTABLISHED, TCP_CLOSE))
    out = out.withColumn("event_type", event)
    return (out.withColumn("event_name", F.when(F.col("event_type") == 0, SOCKET_EVENTS[0]).otherwise(SOCKET_EVENTS[2]))
            .withColumn("saddr_text", C.ipv4_to_string("saddr")).withColumn("daddr_text", C.ipv4_to_string("daddr")))


# Fields of each metric kind.
METRIC_FIELDS = {
    "cpu": ("user_pct", "system_pct", "nice_pct", "idle_pct", "iowait_pct", "irq_pct", "softirq_pct",
            "steal_pct", "busy_pct"),
    "system_counters": ("context_switches_per_sec", "interrupts_per_sec"),
    "loadavg": ("load_1m", "load_5m", "load_15m"),
    "runqueue": ("procs_running", "procs_blocked"),
}
EMA_FIELDS = ("user_pct_ema", "system_pct_ema", "busy_pct_ema")


def pivot_cpu_metrics(records: DataFrame) -> dict[str, DataFrame]:
    """Typed tables per metric kind from generic records; missing numbers read as 0."""
    kind = F.try_element_at("labels", F.lit("type"))
    cpu = F.coalesce(F.try_element_at("labels", F.lit("cpu")), F.lit("")).alias("cpu")

    def number(name):
        return F.try_element_at("fields", F.lit(name))

    def table(kinds, fields, *extra):
        return records.where(kind.isin(*kinds)).select(
            "host", "timestamp_ns", *extra, *[F.coalesce(number(f), F.lit(0.0)).alias(f) for f in fields])

    irq_all = (F.coalesce(number("irq_pct"), F.lit(0.0)) + F.coalesce(number("softirq_pct"), F.lit(0.0)))
    cpu_extra = (cpu, kind.alias("type"), irq_all.alias("irq_all"), *[number(f).alias(f) for f in EMA_FIELDS])
    return {
        "cpu_total": table(("cpu_total",), METRIC_FIELDS["cpu"], *cpu_extra),
        "cpu_core": table(("cpu_core",), METRIC_FIELDS["cpu"], *cpu_extra),
        **{k: table((k,), METRIC_FIELDS[k]) for k in ("system_counters", "loadavg", "runqueue")},
    }


def normalize_labels(col):
    """Label JSON given as an object or as a list of ``{key|name, value|val}`` -> one map."""
    c = F.col(col) if isinstance(col, str) else col
    items = F.from_json(c, "array<map<string,string>>")
    key = lambda m: F.coalesce(F.try_element_at(m, F.lit("key")), F.try_element_at(m, F.lit("name")))
    val = lambda m: F.coalesce(F.try_element_at(m, F.lit("value")), F.try_element_at(m, F.lit("val")), F.lit(""))
    listed = F.map_from_entries(F.transform(F.filter(items, lambda m: key(m).isNotNull()),
                                            lambda m: F.struct(key(m).alias("key"), val(m).alias("value"))))
    plain = F.transform_values(F.from_json(c, "map<string,string>"), lambda k, v: F.coalesce(v, F.lit("")))
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(F.ltrim(c).startswith("["), listed).otherwise(plain), empty)


def time_range(df: DataFrame, end, window_ms: int | None = None, start=None, ts: str = "ts") -> DataFrame:
    """Rows in ``[end - window_ms, end]`` (live view) or ``[start, end]`` (paused view), bounds included."""
    last = F.lit(end).cast("timestamp")
    first = F.lit(start).cast("timestamp") if window_ms is None else \
        F.timestamp_micros(F.unix_micros(last) - F.lit(window_ms * 1000))
    return df.where(F.col(ts).between(first, last))


def filter_scope(df: DataFrame, pid: int | None = None, comm: str | None = None, cpu=None) -> DataFrame:
    """Combined pid / comm / cpu selection; an unset part does not filter."""
    for name, value in (("pid", pid), ("comm", comm), ("cpu", cpu)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df
