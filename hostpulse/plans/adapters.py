"""Telemetry tables derived from the driver tables, as SQL that Spark and DuckDB both run.

``{events}`` etc. name the base tables.  Dialect differences are tokens: ``$NS(c)`` nanoseconds of a
timestamp, ``$DIV`` integral division, ``$LIST(...)`` array, ``$NOLIST`` empty text array.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostpulse.functions import columns as C
from hostpulse.schemas import FRAME
from hostpulse.session import prepare

# Start of kernel text, above 2^63.
KERNEL_BASE = "18446744071562067968"

TABLES = {
    "ev": "select event_id as seq, $NS(ts) as timestamp_ns, user_id, event_type, value, "
          "concat('h', cast(event_id % 2 as string)) as host from {events}",
    "rec": "select host, concat('feed_', cast(user_id % 3 as string)) as feed, seq, timestamp_ns, event_type, "
           "user_id, value, seq $DIV 250 as batch_id from ev",
    "sched": """
        select host, seq, timestamp_ns, cpu, event_type, next_pid, prev_pid,
               concat('proc_', cast(next_pid % 10 as string)) as next_comm,
               concat('proc_', cast(prev_pid % 10 as string)) as prev_comm from (
          select host, seq, timestamp_ns, cpu, event_type, next_pid,
                 case event_type when 'switch' then (user_id + seq * 13) % 150
                   when 'wakeup' then waker else next_pid end as prev_pid from (
            select host, seq, timestamp_ns, user_id % 8 as cpu, user_id, user_id as next_pid, (seq * 7) % 150 as waker,
                   case when event_type in ('click', 'view', 'purchase') then 'switch'
                        when event_type = 'signup' then 'wakeup' else 'migrate' end as event_type from ev) a) b""",
    "block": "select host, seq, timestamp_ns, case when event_type = 'click' then 'issue' "
             "when event_type = 'view' then 'complete' else 'other' end as phase, seq % 3 as dev, "
             "user_id as sector, seq % 16 as nr_sector, seq % 50 as pid, seq % 70 as tid, "
             "concat('proc_', cast(seq % 10 as string)) as comm, "
             "case when seq % 4 = 0 then 'WS' else 'R' end as rwbs from ev",
    "alloc": "select host, seq, timestamp_ns, user_id % 20 as pid, user_id % 30 as tid, "
             "concat('proc_', cast(user_id % 20 as string)) as comm, case when event_type = 'click' then 'alloc' "
             "when event_type = 'view' then 'free' else 'other' end as op, cast(user_id as decimal(20,0)) as addr, "
             "seq % 4096 as size from ev",
    "sock": "select host, seq, timestamp_ns, user_id % 20 as pid, user_id % 20 as tid, "
            "concat('proc_', cast(user_id % 20 as string)) as comm, case when user_id % 10 = 9 then 10 else 2 end "
            "as family, 2 as oldstate, case when event_type in ('click', 'signup') then 1 "
            "when event_type in ('view', 'error') then 7 else 4 end as newstate, "
            "16777343 + user_id * 65536 as saddr, 16777226 + user_id as daddr, 40000 + user_id as sport, "
            "443 as dport, 6 as protocol from ev",
    "cpu_samples": "select host, seq, timestamp_ns, user_id as pid, seq % 7 as tid, user_id % 8 as cpu, "
                   "concat('proc_', cast(user_id % 10 as string)) as comm, (seq * 13) % 3001 - 1 as kernel_stack_id, "
                   "(seq * 17) % 3001 - 1 as user_stack_id from ev",
    # three addresses per stack, a 0 second address every fifth stack
    "frames": "select concat('h', cast(p_partkey % 2 as string)) as host, p_partkey as stack_id, p_partkey * 100 as a1, "
              "case when p_partkey % 5 = 0 then 0 else p_partkey * 100 + 1 end as a2, p_partkey * 100 + 2 as a3 "
              "from {part}",
    "stacks": """
        select concat('h', cast(l_suppkey % 2 as string)) as host, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 as seq,
               $NS(l_shipdate) + l_orderkey * 10 + l_linenumber as timestamp_ns, l_suppkey as pid, l_partkey as tid,
               concat('comm_', l_returnflag) as comm, l_linenumber % 4 as cpu,
               case when l_linestatus = 'F' then 'offcpu' else 'oncpu' end as sample_type,
               cast(floor(l_quantity) as bigint) as cnt, cast(floor(l_extendedprice) as bigint) * 1000 as duration_ns,
               concat('leaf_', cast(l_linenumber as string)) as leaf, concat('mid_', cast(l_suppkey % 5 as string)) as mid,
               case when l_linestatus = 'F' then concat('sys_', cast(l_linenumber % 3 as string)) end as sys,
               $LIST(concat('leaf_', cast(l_linenumber as string)), concat('mid_', cast(l_suppkey % 5 as string)),
                     'main') as user_names,
               case when l_linestatus = 'F' then $LIST(concat('sys_', cast(l_linenumber % 3 as string)))
                    else $NOLIST end as kernel_names from {lineitem}""",
    "cpu_counters": """
        select host, cpu, ts_us, cast(sum(u) over w as bigint) as user_j, cast(sum(s) over w as bigint) as system_j,
               cast(sum(i) over w as bigint) as idle_j, cast(sum(o) over w as bigint) as iowait_j from (
          select host, concat('cpu', cast(user_id % 4 as string)) as cpu,
                 (timestamp_ns - timestamp_ns % 3600000000000) $DIV 1000 as ts_us,
                 sum(case when event_type = 'click' then 1 else 0 end) as u,
                 sum(case when event_type = 'view' then 1 else 0 end) as s,
                 sum(case when event_type = 'purchase' then 1 else 0 end) as i,
                 sum(case when event_type = 'signup' then 1 else 0 end) as o from ev group by 1, 2, 3) h
        window w as (partition by host, cpu order by ts_us)""",
    "tot_counters": """
        select host, cpu, ts_us, cast(sum(u) over w as bigint) as user_j, cast(sum(s) over w as bigint) as system_j,
               cast(sum(i) over w as bigint) as idle_j, cast(sum(o) over w as bigint) as iowait_j from (
          select host, 'cpu' as cpu,
                 (timestamp_ns - timestamp_ns % 3600000000000) $DIV 1000 as ts_us,
                 sum(case when event_type = 'click' then 1 else 0 end) as u,
                 sum(case when event_type = 'view' then 1 else 0 end) as s,
                 sum(case when event_type = 'purchase' then 1 else 0 end) as i,
                 sum(case when event_type = 'signup' then 1 else 0 end) as o from ev group by 1, 2, 3) h
        window w as (partition by host, cpu order by ts_us)""",
    "sys_counters": """
        select host, ts_us, cast(sum(c) over w as bigint) as ctxt, cast(sum(i) over w as bigint) as intr, c as running
        from (select host, (timestamp_ns - timestamp_ns % 3600000000000) $DIV 1000 as ts_us,
                     sum(user_id) as c, sum(case when event_type = 'view' then 1 else 0 end) as i
              from ev group by 1, 2) h window w as (partition by host order by ts_us)""",
    # a process is listed in the hours it has events in, so many lack a predecessor
    "proc_counters": """
        select host, ts_us, pid, concat('proc_', cast(pid % 10 as string)) as comm,
               cast(sum(u) over w as bigint) as utime, cast(sum(s) over w as bigint) as stime,
               pid * 7 as starttime, pid % 9 as num_threads, (pid + 1) * 5000 as vsize, pid * 3 as rss_pages,
               ts_us $DIV 3600000000 * 10 as total_jiffies, 4 as num_cpus from (
          select host, (timestamp_ns - timestamp_ns % 3600000000000) $DIV 1000 as ts_us, user_id % 30 as pid,
                 sum(case when event_type = 'click' then 1 else 0 end) as u,
                 sum(case when event_type = 'view' then 1 else 0 end) as s from ev group by 1, 2, 3) h
        window w as (partition by host, pid order by ts_us)""",
    "thread_counters": """
        select host, ts_us, pid, tid, concat('t_', cast(tid as string)) as comm,
               concat('proc_', cast(pid % 10 as string)) as parent_comm, 'R' as state,
               cast(sum(u) over w as bigint) as utime, cast(sum(s) over w as bigint) as stime,
               ts_us $DIV 3600000000 * 10 as total_jiffies, 4 as num_cpus from (
          select host, (timestamp_ns - timestamp_ns % 3600000000000) $DIV 1000 as ts_us, user_id % 30 as pid,
                 user_id as tid, sum(case when event_type = 'click' then 1 else 0 end) as u,
                 sum(case when event_type = 'view' then 1 else 0 end) as s from ev group by 1, 2, 3, 4) h
        window w as (partition by host, pid, tid order by ts_us)""",
    # every third address is not a code symbol
    "ksyms": "select concat('h', cast(p_partkey % 2 as string)) as host, cast(cast($KBASE as decimal(20,0)) "
             "+ p_partkey * 10 as decimal(20,0)) as address, case when p_partkey % 3 = 0 then 'D' else 'T' end as type, "
             "concat('ksym_', cast(p_partkey as string)) as name from {part}",
    "kframes": "select concat('h', cast(l_suppkey % 2 as string)) as host, cast(cast($KBASE as decimal(20,0)) "
               "+ l_partkey * 10 + l_linenumber as decimal(20,0)) as address, l_suppkey as pid, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 as seq "
               "from {lineitem}",
    # every second map is two pages long, so it overlaps the next one
    "maps": "select concat('h', cast(p_partkey % 2 as string)) as host, p_partkey % 20 as pid, cast(4194304 + (p_partkey $DIV 20) * 4096 as decimal(20,0)) "
            "as start_at, cast(4194304 + (p_partkey $DIV 20) * 4096 + 4096 * (1 + p_partkey % 2) as decimal(20,0)) "
            "as end_at, cast((p_partkey % 5) * 4096 as decimal(20,0)) as file_at, "
            "concat('/lib/lib', cast(p_partkey % 9 as string), '.so') as path, p_partkey as ord from {part}",
    "elf": "select concat('/lib/lib', cast(p_partkey % 8 as string), '.so') as path, "
           "cast((p_partkey % 1000) * 24 as decimal(20,0)) as value, cast(case when p_partkey % 3 = 0 then 0 else 16 "
           "end as decimal(20,0)) as size, concat('fn_', cast(p_partkey as string)) as name, "
           "case when p_partkey % 11 = 0 then 'SECTION' else 'FUNC' end as type from {part}",
    "uframes": "select concat('h', cast(l_suppkey % 2 as string)) as host, l_partkey % 23 as pid, "
               "cast(4194304 + (l_partkey $DIV 20) * 4096 + l_linenumber * 517 as decimal(20,0)) as address, "
               "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 as seq from {lineitem}",
    "stages": "select host, timestamp_ns $DIV 1000 as ts_us, seq, concat('stage_', cast(user_id % 12 as string)) "
              "as name, user_id % 4 <> 0 as running, false as stub, seq as batches, seq * 3 as records, "
              "user_id % 5 as errors, 100 as capacity, (seq * 7) % 100 as size, seq * 2 as enqueued, "
              "seq * 2 - user_id as dequeued, user_id % 7 as dropped, 0 as flush_injected, 0 as backpressure_events, "
              "false as backpressured from ev",
    "meter": "select seq, timestamp_ns, event_type as name, case when event_type in ('click', 'error') then 'counter' "
             "when event_type = 'view' then 'gauge' else 'latency' end as kind, seq % 1000 as value from ev",
    "profs": "select concat('h', cast(o_custkey % 2 as string)) as host, concat('feed_', cast(o_custkey % 3 as string)) "
             "as feed, case when o_orderkey % 2 = 0 then 'oncpu' else 'offcpu' end as profile_type, "
             "o_orderkey * 1000 as start_ns, o_orderkey * 1000 + 2500 as end_ns, o_custkey as sample_count "
             "from {orders}",
}
NEEDS = {name: [n for n in ("ev",) if re.search(r"\bfrom ev\b", text)] for name, text in TABLES.items()}


def _call(text: str, token: str, template: str) -> str:
    return re.sub(rf"\${token}\(([^()]*)\)", lambda m: template.format(m.group(1)), text)


def spark_text(text: str) -> str:
    text = _call(text, "NS", "(unix_micros(cast({0} as timestamp)) * 1000)")
    text = text.replace("$KBASE", KERNEL_BASE)
    return (text.replace("$DIV", "div").replace("$LIST", "array")
            .replace("$NOLIST", "cast(array() as array<string>)"))


def duck_text(text: str) -> str:
    text = _call(text, "NS", "(epoch_us({0}) * 1000)")
    text = text.replace("$KBASE", KERNEL_BASE)
    text = (text.replace("$DIV", "//").replace("$LIST", "list_value")
            .replace("$NOLIST", "cast([] as varchar[])"))
    return re.sub(r"\{(\w+)\}", r"\1", text)


def duck_with(*names: str) -> str:
    """``with`` clause for DuckDB that defines the named adapter tables."""
    wanted: list[str] = []
    for n in names:
        for m in [*NEEDS[n], n]:
            if m not in wanted:
                wanted.append(m)
    return "with " + ", ".join(f"{n} as ({duck_text(TABLES[n])})" for n in wanted) + " "


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter table on Spark."""
    prepare(spark)
    text = spark_text(TABLES[name]).replace("from ev", "from {ev}")
    used = set(re.findall(r"\{(\w+)\}", text))
    frames = {}
    for n in used:
        frames[n] = table(spark, sf_dir, n) if n == "ev" else base(spark, sf_dir, n)
    return spark.sql(text, **frames)


def with_ts(df: DataFrame) -> DataFrame:
    """Turn ``ts_us`` into the canonical ``ts`` column."""
    return df.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")


# --- canonical shapes -------------------------------------------------------------------------

def records(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "rec")
    return r.select(
        "host", F.col("feed").alias("pipeline"), "seq", "batch_id", "timestamp_ns", C.ns_to_ts("timestamp_ns").alias("ts"),
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.create_map(F.lit("value"), F.col("value")).alias("fields"),
        F.create_map(F.lit("kind"), F.col("event_type")).alias("fields_str"),
        F.create_map(F.lit("odd"), F.col("seq") % 2 == 1).alias("fields_bool"))


def type_records(spark, sf_dir) -> DataFrame:
    """Records labelled by event type only: few, large label sets."""
    return records(spark, sf_dir).withColumn("labels", F.map_filter("labels", lambda k, v: k == "type"))


def sched(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "sched")


def stack_samples(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "stacks")
    return s.select("host", "seq", F.lit("profile").alias("pipeline"), "timestamp_ns",
                    C.ns_to_ts("timestamp_ns").alias("ts"), "pid", "tid", "comm", F.col("cpu").cast("bigint").alias("cpu"),
                    "sample_type", F.col("cnt").alias("count"), "duration_ns",
                    F.when(F.col("sys").isNotNull(), F.array(C.frame(F.col("sys")))).otherwise(
                        F.array().cast(f"array<{FRAME}>")).alias("kernel_stack"),
                    F.array(C.frame(F.col("leaf")), C.frame(F.col("mid")), C.frame(F.lit("main"))).alias("user_stack"))


def cpu_counters(spark, sf_dir, name: str = "cpu_counters") -> DataFrame:
    c = with_ts(table(spark, sf_dir, name))
    zero = F.lit(0).cast("bigint")
    return c.select("host", "cpu", "ts", F.col("user_j").alias("user"), zero.alias("nice"),
                    F.col("system_j").alias("system"), F.col("idle_j").alias("idle"),
                    F.col("iowait_j").alias("iowait"), zero.alias("irq"), zero.alias("softirq"), zero.alias("steal"))


def stack_frames(spark, sf_dir) -> DataFrame:
    f = table(spark, sf_dir, "frames")
    return f.select("host", "stack_id", F.transform(F.array("a1", "a2", "a3"),
                                                    lambda a: a.cast(C.ADDRESS)).alias("addresses"))


def kernel_samples(spark, sf_dir) -> DataFrame:
    k = table(spark, sf_dir, "kframes")
    return k.select("host", "pid", "seq", C.frames_from_addresses(F.array("address")).alias("kernel_stack"))


def user_samples(spark, sf_dir) -> DataFrame:
    u = table(spark, sf_dir, "uframes")
    return u.select("host", "pid", "seq", C.frames_from_addresses(F.array("address")).alias("user_stack"))


def proc_maps(spark, sf_dir) -> DataFrame:
    return (table(spark, sf_dir, "maps").withColumnRenamed("start_at", "start").withColumnRenamed("end_at", "end")
            .withColumnRenamed("file_at", "offset"))
