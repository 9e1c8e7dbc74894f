"""Registered queries: each operator over whole driver tables, with its DuckDB text.

``@query(name, sql)`` adds an entry; without ``sql`` the driver checks rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import filters, pairing, profiles, rank, sched, series, stats, symbolize
from hostpulse.plans import adapters as A
from hostpulse.sources import readers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

HOUR = 3600 * 10**9
DAY = 24 * HOUR


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def r(c, digits=6):
    """Rounded double for comparison."""
    return F.round(F.col(c).cast("double"), digits).alias(c)


# The test events span 30 days with few rows per key and minute; slices of a day keep border rows rare.
SLICE = DAY

# ---------------------------------------------------------------------------------------------
# records and windows

STATS_SQL = A.duck_with("rec") + """
select host, window_ns, labels, field, round(avg(value), 9) as avg, min(value) as min, max(value) as max,
       count(*) as count, round(case when count(*) >= 4 then quantile_cont(value, 0.5) end, 9) as p50,
       round(case when count(*) >= 4 then quantile_cont(value, 0.99) end, 9) as p99
from (select host, timestamp_ns - timestamp_ns % 3600000000000 as window_ns,
             'type=' || event_type || ';' as labels, 'value' as field, value from rec)
group by all"""


def _stats_columns(df):
    return df.select("host", "window_ns", C.labels_text("labels").alias("labels"), "field", r("avg", 9), "min", "max",
                     "count", r("p50", 9), r("p99", 9))


@query("window_stats", STATS_SQL)
def window_stats(spark, sf):
    return _stats_columns(stats.window_stats(A.type_records(spark, sf), "1 hour"))


@query("window_stats_split_groups", STATS_SQL.replace("3600000000000", "86400000000000"))
def window_stats_split(spark, sf):
    """The path for oversized groups, forced by a low limit."""
    return _stats_columns(stats.window_stats(A.type_records(spark, sf), "1 day", hot_rows=20))


@query("window_stats_records", A.duck_with("rec") + """
select host, window_ns as timestamp_ns, event_type as type, round(avg(value), 9) as value_avg,
       count(*)::double as value_count, round(case when count(*) >= 4 then quantile_cont(value, 0.5) end, 9) as value_p50
from (select host, timestamp_ns - timestamp_ns % 86400000000000 as window_ns, event_type, value from rec) group by 1, 2, 3""")
def window_stats_records(spark, sf):
    wide = stats.window_stats(A.type_records(spark, sf), "1 day", wide=True)
    f = lambda k: F.try_element_at("fields", F.lit(k))
    return wide.select("host", "timestamp_ns", F.try_element_at("labels", F.lit("type")).alias("type"),
                       F.round(f("value_avg"), 9).alias("value_avg"), f("value_count").alias("value_count"),
                       F.round(f("value_p50"), 9).alias("value_p50"))


@query("record_range", A.duck_with("rec") + """
select seq, timestamp_ns, event_type from rec
where feed = 'feed_1' and timestamp_ns between (select min(timestamp_ns) + 86400000000000 from rec)
  and (select max(timestamp_ns) - 86400000000000 from rec)
order by timestamp_ns desc, seq desc limit 1000""")
def record_range(spark, sf):
    rec = A.records(spark, sf)
    lo, hi = rec.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    out = readers.query_records(rec, "feed_1", lo + DAY, hi - DAY, limit=1000)
    return out.select("seq", "timestamp_ns", F.try_element_at("labels", F.lit("type")).alias("event_type"))


@query("sample_range", A.duck_with("stacks") + """
select seq, timestamp_ns, comm from stacks where timestamp_ns >= 694224000000000000
order by timestamp_ns, seq limit 500""")
def sample_range(spark, sf):
    return readers.query_stack_samples(A.stack_samples(spark, sf), "profile", 694224000000000000, 0, 500,
                                       descending=False).select("seq", "timestamp_ns", "comm")


@query("profile_listing", A.duck_with("profs") + """
select profile_type, start_ns, end_ns, sample_count from profs
where feed = 'feed_0' and end_ns >= 100000 and start_ns <= 5000000""")
def profile_listing(spark, sf):
    p = A.table(spark, sf, "profs").withColumnRenamed("feed", "pipeline").withColumn("data", F.lit(b"\x00"))
    return readers.list_profiles(p, "feed_0", 100000, 5000000).select(
        "profile_type", "start_ns", "end_ns", "sample_count")


@query("record_decode", A.duck_with("rec") + """
select seq, case when seq % 9 <> 0 then event_type end as type,
       case when seq % 7 <> 0 then round(value, 6) end as value,
       case when seq % 7 <> 0 then event_type end as kind, case when seq % 7 <> 0 then seq % 2 = 1 end as odd from rec""")
def record_decode(spark, sf):
    rec = A.table(spark, sf, "rec")
    good_l = F.to_json(F.create_map(F.lit("type"), F.col("event_type")))
    good_f = F.to_json(F.struct("value", F.col("event_type").alias("kind"), (F.col("seq") % 2 == 1).alias("odd")))
    stored = rec.select("seq", F.when(F.col("seq") % 9 == 0, F.lit("{broken")).otherwise(good_l).alias("labels_json"),
                        F.when(F.col("seq") % 7 == 0, F.lit("not json")).otherwise(good_f).alias("fields_json"))
    d = readers.decode_records(stored)
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return d.select("seq", get("labels", "type").alias("type"), F.round(get("fields", "value"), 6).alias("value"),
                    get("fields_str", "kind").alias("kind"), get("fields_bool", "odd").alias("odd"))


# ---------------------------------------------------------------------------------------------
# filters

@query("passthrough", "select count(*) as n from lineitem")
def passthrough(spark, sf):
    return filters.passthrough(A.stack_samples(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query("exclude_label", A.duck_with("rec") + "select seq, event_type from rec where event_type <> 'click' or seq % 3 = 0")
def exclude_label(spark, sf):
    rec = A.records(spark, sf).withColumn("type", F.try_element_at("labels", F.lit("type")))
    # every third record lacks the label and must stay
    rec = rec.withColumn("labels", F.when(F.col("seq") % 3 == 0, F.map_filter("labels", lambda k, v: k != "type"))
                         .otherwise(F.col("labels")))
    return filters.exclude_label(rec, "type", "click").select("seq", F.col("type").alias("event_type"))


@query("allow_pids", A.duck_with("stacks") + "select seq, pid from stacks where pid in (1, 5, 7)")
def allow_pids(spark, sf):
    return filters.allow_pids(A.stack_samples(spark, sf), [1, 5, 7]).select("seq", "pid")


@query("allow_many_pids", A.duck_with("sched") + """
select seq from sched where (prev_pid >= 20 and prev_pid < 1520) or (next_pid >= 20 and next_pid < 1520)""")
def allow_many_pids(spark, sf):
    return filters.allow_pids(A.sched(spark, sf), range(20, 1520), ("prev_pid", "next_pid")).select("seq")


@query("allow_event_pids", A.duck_with("sched") + "select seq from sched where prev_pid in (3, 4) or next_pid in (3, 4)")
def allow_event_pids(spark, sf):
    return filters.allow_pids(A.sched(spark, sf), [3, 4], ("prev_pid", "next_pid")).select("seq")


@query("cpu_sample_filter", A.duck_with("cpu_samples") + """
select seq, pid, comm from cpu_samples where pid <> 0 and pid in (0, 11, 12, 21) and comm in ('proc_1', 'proc_2')""")
def cpu_sample_filter(spark, sf):
    return filters.filter_cpu_samples(A.table(spark, sf, "cpu_samples"), [0, 11, 12, 21],
                                      ["proc_1", "proc_2"]).select("seq", "pid", "comm")


@query("comm_filter", A.duck_with("stacks") + """
select seq, comm from stacks where regexp_matches(comm, 'm_[AR]') and not regexp_matches(comm, 'R$')""")
def comm_filter(spark, sf):
    return filters.filter_comm(A.stack_samples(spark, sf), "m_[AR]", "R$").select("seq", "comm")


@query("process_search", A.duck_with("proc_counters") + """
select host, ts_us, pid from proc_counters where contains(lower(comm), 'c_7') or contains(cast(pid as varchar), '2')""")
def process_search(spark, sf):
    p = filters.search_processes(A.table(spark, sf, "proc_counters"), "C_7")
    q = filters.search_processes(A.table(spark, sf, "proc_counters"), "2")
    return p.union(q).select("host", "ts_us", "pid").distinct()


@query("recent_events", A.duck_with("sched") + """
select seq, timestamp_ns, event_type from sched where prev_pid = 5 or next_pid = 5
order by timestamp_ns desc, seq desc limit 200""")
def recent_events(spark, sf):
    return filters.recent_events(A.sched(spark, sf), 5, 200).select("seq", "timestamp_ns", "event_type")


@query("sched_decode", A.duck_with("sched") + """
select seq, event_type, timestamp_ns // 1000 as latency_us from sched""")
def sched_decode(spark, sf):
    code = F.when(F.col("event_type") == "wakeup", 1).when(F.col("event_type") == "migrate", 2) \
        .otherwise(F.lit(3) * (F.col("seq") % 2))
    raw = A.sched(spark, sf).withColumn("event_type", code).withColumn("latency_ns", F.col("timestamp_ns"))
    return filters.decode_sched(raw).select("seq", "event_type", "latency_us")


@query("socket_classes", A.duck_with("sock") + """
select seq, case when newstate = 1 then 0 else 2 end as event_type,
       case when newstate = 1 then 'connect' else 'close' end as event_name,
       concat(saddr & 255, '.', (saddr >> 8) & 255, '.', (saddr >> 16) & 255, '.', (saddr >> 24) & 255) as saddr_text
from sock where family = 2 and newstate in (1, 7)""")
def socket_classes(spark, sf):
    return filters.classify_sockets(A.table(spark, sf, "sock")).select("seq", "event_type", "event_name", "saddr_text")


@query("time_range", A.duck_with("rec") + """
select seq from rec where timestamp_ns // 1000 between (select max(timestamp_ns) // 1000 - 172800000000 from rec)
and (select max(timestamp_ns) // 1000 from rec)""")
def time_range(spark, sf):
    rec = A.records(spark, sf)
    return filters.time_range(rec, rec.agg(F.max("ts")).scalar(), 2 * 86400 * 1000).select("seq")


@query("scope_filter", A.duck_with("stacks") + "select seq from stacks where pid = 3 and comm = 'comm_A' and cpu = 1")
def scope_filter(spark, sf):
    return filters.filter_scope(A.stack_samples(spark, sf), pid=3, comm="comm_A", cpu=1).select("seq")


@query("label_normalization", A.duck_with("rec") + """
select seq, event_type as type, case when seq % 3 = 0 then '' else cast(user_id as varchar) end as user from rec""")
def label_normalization(spark, sf):
    rec = A.table(spark, sf, "rec")
    user = F.when(F.col("seq") % 3 != 0, F.col("user_id").cast("string"))
    as_list = F.to_json(F.array(
        F.create_map(F.lit("key"), F.lit("type"), F.lit("value"), F.col("event_type")),
        F.create_map(F.lit("name"), F.lit("user"), F.lit("val"), user)))
    as_object = F.to_json(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), user))
    raw = rec.select("seq", F.when(F.col("seq") % 2 == 0, as_list).otherwise(as_object).alias("j"))
    m = filters.normalize_labels("j")
    return raw.select("seq", F.try_element_at(m, F.lit("type")).alias("type"),
                      F.try_element_at(m, F.lit("user")).alias("user"))


# ---------------------------------------------------------------------------------------------
# pairing

LATENCY = """, waits as (select *, lag(event_type) over w as pt, lag(timestamp_ns) over w as pn from sched
    where event_type in ('switch', 'wakeup') window w as (partition by host, next_pid order by timestamp_ns, seq)),
lat as (select * exclude (pt, pn), case when event_type = 'switch' and pt = 'wakeup' then timestamp_ns - pn else 0 end
        as latency_ns from waits union all select *, 0 from sched where event_type = 'migrate') """


@query("runqueue_latency", A.duck_with("sched") + LATENCY + """
select host, seq, event_type, next_pid, cast(latency_ns as bigint) as latency_ns from lat""")
def runqueue_latency(spark, sf):
    return pairing.runqueue_latency(A.sched(spark, sf), SLICE).select(
        "host", "seq", "event_type", "next_pid", "latency_ns")


@query("pair_events", A.duck_with("ev") + """
, x as (select *, lag(event_type) over w as pt, lag(seq) over w as ps from ev where event_type in ('click', 'view')
        window w as (partition by user_id order by timestamp_ns, seq))
select seq, case when pt = 'click' then ps end as opened_by from x where event_type = 'view'""")
def pair_events(spark, sf):
    ev = A.table(spark, sf, "ev")
    out = pairing.pair_events(ev, ["user_id"], ["timestamp_ns", "seq"], F.col("event_type") == "click",
                              F.col("event_type") == "view", ["seq"], slice_ns=SLICE)
    return out.select("seq", F.col("opened.seq").alias("opened_by"))


OFFCPU = """, ends as (
  select host, seq, timestamp_ns, cpu, 0 as ord, prev_pid as pid, prev_comm as comm from sched where event_type = 'switch' and prev_pid <> 0
  union all select host, seq, timestamp_ns, cpu, 1, next_pid, next_comm from sched where event_type = 'switch' and next_pid <> 0),
 e as (select *, lag(ord) over w as po, lag(timestamp_ns) over w as pn, lag(comm) over w as pc from ends
       window w as (partition by host, pid order by timestamp_ns, seq, ord)),
 off as (select host, pid, cpu, pn as timestamp_ns, pc as comm, timestamp_ns - pn as duration_ns from e
         where ord = 1 and po = 0 and timestamp_ns - pn >= 100000) """


@query("offcpu_intervals", A.duck_with("sched") + OFFCPU + "select host, pid, cpu, timestamp_ns, comm, duration_ns from off")
def offcpu_intervals(spark, sf):
    return pairing.offcpu_intervals(A.sched(spark, sf), slice_ns=SLICE).select(
        "host", "pid", "cpu", "timestamp_ns", "comm", "duration_ns")


BLOCK = """, b as (select *, lag(phase) over w as pp, lag(timestamp_ns) over w as pn, lag(pid) over w as ppid,
  lag(comm) over w as pcomm from block where phase in ('issue', 'complete')
  window w as (partition by host, sector{extra} order by timestamp_ns, seq)),
io as (select host, seq, timestamp_ns, ppid as pid, pcomm as comm, timestamp_ns - pn as latency_ns, sector,
  case when rwbs[1] = 'W' then 1 else 0 end as rwflag from b where phase = 'complete' and pp = 'issue') """


@query("block_io_latency", A.duck_with("block") + BLOCK.format(extra="") + "select * from io")
def block_io_latency(spark, sf):
    return pairing.block_io_latency(A.table(spark, sf, "block"), slice_ns=SLICE).select(
        "host", "seq", "timestamp_ns", "pid", "comm", "latency_ns", "sector", "rwflag")


@query("block_io_by_device", A.duck_with("block") + BLOCK.format(extra=", dev") + """
select seq, latency_ns // 1000 as latency_us, case when rwflag = 1 then 'write' else 'read' end as rw from io""")
def block_io_by_device(spark, sf):
    io = pairing.block_io_latency(A.table(spark, sf, "block"), ("dev", "sector"), SLICE)
    return filters.decode_block_io(io).select("seq", "latency_us", "rw")


@query("pair_allocations", A.duck_with("alloc") + """
, a as (select *, lag(op) over w as po, lag(size) over w as psize, lag(timestamp_ns) over w as pn from alloc
  where op <> 'other' and addr <> 0 window w as (partition by host, addr order by timestamp_ns, seq))
select host, seq, op, case when op = 'alloc' then size else psize end as size,
       case when op = 'free' then timestamp_ns - pn end as lifetime_ns from a where op = 'alloc' or po = 'alloc'""")
def pair_allocations(spark, sf):
    return pairing.pair_allocations(A.table(spark, sf, "alloc"), slice_ns=SLICE).select(
        "host", "seq", "op", "size", "lifetime_ns")


@query("live_allocations", A.duck_with("alloc") + """
, a as (select *, lead(op) over w as nxt from alloc where op <> 'other' and addr <> 0
        window w as (partition by host, addr order by timestamp_ns, seq))
select host, pid, comm, cast(sum(size) as bigint) as live_bytes, count(*) as allocations, min(timestamp_ns) as oldest_ns
from a where op = 'alloc' and nxt is null group by 1, 2, 3""")
def live_allocations(spark, sf):
    return pairing.live_allocation_summary(pairing.live_allocations(A.table(spark, sf, "alloc"), slice_ns=SLICE))


@query("connection_durations", A.duck_with("sock") + """
, c as (select *, lag(newstate) over w as ps, lag(timestamp_ns) over w as pn from sock
  where family = 2 and newstate in (1, 7)
  window w as (partition by host, pid, saddr, daddr, sport, dport order by timestamp_ns, seq))
select host, seq, pn as connected_ns, timestamp_ns - pn as duration_ns from c where newstate = 7 and ps = 1""")
def connection_durations(spark, sf):
    events = filters.classify_sockets(A.table(spark, sf, "sock"))
    return pairing.connection_durations(events, SLICE).select("host", "seq", "connected_ns", "duration_ns")


# ---------------------------------------------------------------------------------------------
# scheduler reports

SCHED_STATS = """, st as (
  select host, timestamp_ns - timestamp_ns % 21600000000000 as window_ns, next_pid as pid,
         count(case when event_type = 'switch' then 1 end) as switch_count,
         cast(coalesce(sum(case when event_type = 'switch' then latency_ns end), 0) as bigint) as total_runqueue_latency_ns,
         cast(coalesce(max(case when event_type = 'switch' then latency_ns end), 0) as bigint) as max_runqueue_latency_ns,
         count(case when event_type = 'migrate' then 1 end) as migrate_count,
         arg_max(case when event_type = 'switch' then next_comm end, case when event_type = 'switch' then seq end) as comm
  from lat where (event_type = 'switch' and next_pid <> 0) or event_type = 'migrate' group by 1, 2, 3) """
SUMMARY = """, sm as (select host, window_ns, pid, coalesce(comm, 'pid:' || pid) as comm, switch_count,
  case when switch_count > 0 then total_runqueue_latency_ns / switch_count / 1000 else 0 end as avg_us,
  max_runqueue_latency_ns / 1000 as max_us, migrate_count from st) """
SCHED_ALL = A.duck_with("sched") + LATENCY + SCHED_STATS


def _stats6h(spark, sf):
    return sched.sched_stats(pairing.runqueue_latency(A.sched(spark, sf), SLICE), "6 hours")


@query("sched_stats", SCHED_ALL + "select * from st")
def sched_stats(spark, sf):
    return _stats6h(spark, sf)


@query("sched_history", SCHED_ALL + """
select host, window_ns, total_switches, avg_latency_us, max_latency_ns, total_migrations, process_count from (
  select host, window_ns, cast(sum(switch_count) as bigint) as total_switches,
    round(case when sum(switch_count) > 0 then sum(total_runqueue_latency_ns) / sum(switch_count) / 1000 else 0 end, 2)
      as avg_latency_us, max(max_runqueue_latency_ns) as max_latency_ns,
    cast(sum(migrate_count) as bigint) as total_migrations, count(*) as process_count,
    row_number() over (partition by host order by window_ns desc) as rn from st group by 1, 2) where rn <= 90""")
def sched_history(spark, sf):
    return sched.sched_history(_stats6h(spark, sf), 90).withColumn("avg_latency_us", r("avg_latency_us", 2))


@query("sched_summary", SCHED_ALL + SUMMARY + """
select host, window_ns, pid, comm, switch_count, round(avg_us, 2) as avg_runqueue_latency_us,
       round(max_us, 2) as max_runqueue_latency_us, migrate_count from sm""")
def sched_summary(spark, sf):
    return sched.sched_summary(_stats6h(spark, sf)).withColumns({
        "avg_runqueue_latency_us": r("avg_runqueue_latency_us", 2),
        "max_runqueue_latency_us": r("max_runqueue_latency_us", 2)})


@query("latency_histogram", SCHED_ALL + SUMMARY + """
, b(ord, lo, hi, range) as (values (0, -1e300, 10, '<10us'), (1, 10, 50, '10-50us'), (2, 50, 100, '50-100us'),
  (3, 100, 500, '100-500us'), (4, 500, 1000, '500us-1ms'), (5, 1000, 5000, '1-5ms'), (6, 5000, 1e300, '>5ms'))
select cast(ord as bigint) as ord, range, count(avg_us) as count from b left join sm on avg_us >= lo and avg_us < hi
group by 1, 2""")
def latency_histogram(spark, sf):
    return sched.latency_histogram(sched.sched_summary(_stats6h(spark, sf)))


@query("sched_overview", SCHED_ALL + SUMMARY + """
select cast(sum(switch_count) as bigint) as total_switches, round(avg(avg_us), 2) as avg_latency_us,
       max(max_us) as max_latency_us from sm""")
def sched_overview(spark, sf):
    return sched.sched_overview(sched.sched_summary(_stats6h(spark, sf))).withColumn(
        "avg_latency_us", r("avg_latency_us", 2))


EDGES = """, w as (select * from sched where event_type = 'wakeup' order by timestamp_ns desc, seq desc limit 500),
edges as (select prev_comm as waker, next_comm as wakee, count(*) as count from w group by 1, 2) """


@query("wakeup_edges", A.duck_with("sched") + EDGES + "select * from edges")
def wakeup_edges(spark, sf):
    return sched.wakeup_graph(A.sched(spark, sf), 500)[0]


@query("wakeup_nodes", A.duck_with("sched") + EDGES + "select waker as comm from edges union select wakee from edges")
def wakeup_nodes(spark, sf):
    return sched.wakeup_graph(A.sched(spark, sf), 500)[1]


@query("top_wakeups", A.duck_with("sched") + """
select prev_comm as waker, next_comm as wakee, count(*) as count from sched where event_type = 'wakeup'
group by 1, 2 order by 3 desc, 1, 2 limit 30""")
def top_wakeups(spark, sf):
    return rank.top_wakeups(sched.wakeup_graph(A.sched(spark, sf), None)[0], 30)


GANTT = """, g as (select *, lead(timestamp_ns) over (partition by host, cpu order by timestamp_ns, seq) as end_ns
  from sched where event_type = 'switch') """


@query("gantt_lanes", A.duck_with("sched") + GANTT + """
select host, cpu, next_comm as comm, next_pid as pid, timestamp_ns as start_ns, end_ns from g
where next_pid <> 0 and end_ns is not null""")
def gantt_lanes(spark, sf):
    return sched.gantt(A.sched(spark, sf), SLICE)


@query("migration_points", A.duck_with("sched") + """
select host, timestamp_ns, cpu, next_pid as pid, next_comm as comm from sched where event_type = 'migrate'""")
def migration_points(spark, sf):
    return sched.migrations(A.sched(spark, sf))


@query("distinct_comms", A.duck_with("sched") + GANTT + """
select next_comm as comm from g where next_pid <> 0 and end_ns is not null
union select next_comm from sched where event_type = 'migrate'""")
def distinct_comms(spark, sf):
    s = A.sched(spark, sf)
    return rank.distinct_values([sched.gantt(s, SLICE), sched.migrations(s)], ["comm"])


def _ranked_sched(by, order):
    return SCHED_ALL + SUMMARY + f"""select host, window_ns, pid, switch_count, round(avg_us, 2) as avg_us, migrate_count
from sm order by {order} desc, pid, host, window_ns limit 8"""


def _rank_sched_query(by):
    def run(spark, sf):
        out = rank.rank_sched(sched.sched_summary(_stats6h(spark, sf)), by, 8)
        return out.select("host", "window_ns", "pid", "switch_count",
                          F.round("avg_runqueue_latency_us", 2).alias("avg_us"), "migrate_count")
    return run


for _by, _order in (("switches", "switch_count"), ("latency", "avg_us"), ("migrations", "migrate_count")):
    query(f"rank_sched_by_{_by}", _ranked_sched(_by, _order))(_rank_sched_query(_by))


@query("top_migrations", SCHED_ALL + SUMMARY + """
select host, window_ns, pid, migrate_count from sm where migrate_count > 0
order by migrate_count desc, pid, host, window_ns limit 30""")
def top_migrations(spark, sf):
    return rank.top_migrations(sched.sched_summary(_stats6h(spark, sf))).select(
        "host", "window_ns", "pid", "migrate_count")


# ---------------------------------------------------------------------------------------------
# profiles

@query("profile_counts", A.duck_with("cpu_samples") + """
select host, timestamp_ns - timestamp_ns % 3600000000000 as window_ns, pid, tid, kernel_stack_id, user_stack_id, comm,
       count(*) as count from cpu_samples group by all""")
def profile_counts(spark, sf):
    return profiles.profile_counts(A.table(spark, sf, "cpu_samples"), "1 hour")


@query("attach_stacks", A.duck_with("cpu_samples", "frames") + """
, f as (select host, stack_id, case when a2 = 0 then a1::varchar else a1 || ',' || a2 || ',' || a3 end as a from frames
        where stack_id > 0)
select s.seq, coalesce(k.a, '') as kernel, coalesce(u.a, '') as user from cpu_samples s
left join f k on k.host = s.host and k.stack_id = s.kernel_stack_id
left join f u on u.host = s.host and u.stack_id = s.user_stack_id""")
def attach_stacks(spark, sf):
    out = profiles.attach_stacks(A.table(spark, sf, "cpu_samples"), A.stack_frames(spark, sf))
    text = lambda c: F.array_join(F.transform(c, lambda f: f["address"].cast("string")), ",")
    return out.select("seq", text("kernel_stack").alias("kernel"), text("user_stack").alias("user"))


@query("window_profile", A.duck_with("cpu_samples", "frames") + """
, f as (select host, stack_id, case when a2 = 0 then a1::varchar else a1 || ',' || a2 || ',' || a3 end as a from frames
        where stack_id > 0)
select s.host, timestamp_ns - timestamp_ns % 86400000000000 as window_ns, pid, tid, coalesce(u.a, '') as user,
       coalesce(k.a, '') as kernel, max(comm) as comm, count(*) as count from cpu_samples s
left join f k on k.host = s.host and k.stack_id = s.kernel_stack_id
left join f u on u.host = s.host and u.stack_id = s.user_stack_id group by all""")
def window_profile(spark, sf):
    s = profiles.attach_stacks(A.table(spark, sf, "cpu_samples"), A.stack_frames(spark, sf))
    out = profiles.window_profile(s.withColumn("count", F.lit(1).cast("bigint")), "1 day")
    text = lambda c: F.array_join(F.transform(c, lambda f: f["address"].cast("string")), ",")
    return out.select("host", "window_ns", "pid", "tid", text("user_stack").alias("user"),
                      text("kernel_stack").alias("kernel"), "comm", "count")


def _merged(by, include_kernel):
    group = {"comm": "comm", "pid": "pid", "tid": "pid, tid", "global": ""}[by]
    keys = ", ".join(x for x in (group, "k" if include_kernel else "", "u") if x)
    sql = A.duck_with("stacks") + f"""
, x as (select *, array_to_string(kernel_names, ';') as k, array_to_string(user_names, ';') as u from stacks)
select {keys}, cast(sum(cnt) as bigint) as count, cast(sum(duration_ns) as bigint) as duration_ns_sum,
       arg_min(duration_ns, [timestamp_ns, pid, tid, seq]) as duration_ns, cast(arg_min(cpu, [timestamp_ns, pid, tid, seq]) as bigint) as cpu
from x group by {keys}"""

    def run(spark, sf):
        out = profiles.merge_stacks(A.stack_samples(spark, sf), by, include_kernel)
        text = lambda c: F.array_join(F.transform(c, lambda f: f["function_name"]), ";")
        cols = [c.strip() for c in group.split(",") if c]
        return out.select(*cols, *([text("kernel_stack").alias("k")] if include_kernel else []),
                          text("user_stack").alias("u"), "count", "duration_ns_sum", "duration_ns",
                          F.col("cpu").cast("bigint").alias("cpu"))
    return sql, run


for _by, _k in (("comm", True), ("pid", True), ("tid", False), ("global", False)):
    _sql, _run = _merged(_by, _k)
    query(f"merge_stacks_by_{_by}", _sql)(_run)


def _tree(weight, where="true", name="tree"):
    return f""", {name}_paths as (
  select [comm] || list_reverse(user_names) || list_reverse(kernel_names) as p, cast(sum({weight}) as bigint) as w from stacks
  where {where} group by 1),
 {name}_nodes as (select p, w, unnest(range(0, len(p) + 1)) as d from {name}_paths),
 {name} as (select p[1:d] as path, d as depth, case when d = 0 then 'root' else p[d] end as name, cast(sum(w) as bigint) as value,
   cast(sum(case when d = len(p) then w else 0 end) as bigint) as self_value from {name}_nodes group by 1, 2, 3) """


def _tree_columns(tree):
    return tree.select(F.array_join("path", ";").alias("path"), F.col("depth").cast("bigint").alias("depth"), "name",
                       "value", "self_value")


TREE_OUT = "select array_to_string(path, ';') as path, cast(depth as bigint) as depth, name, value, self_value from tree"


@query("flame_tree", A.duck_with("stacks") + _tree("case when cnt = 0 then 1 else cnt end") + TREE_OUT)
def flame_tree(spark, sf):
    return _tree_columns(profiles.flame_tree(A.stack_samples(spark, sf)))


@query("flame_tree_offcpu", A.duck_with("stacks") + _tree(
    "case when duration_ns <> 0 then greatest(1, (duration_ns + 500) // 1000) else cnt end") + TREE_OUT)
def flame_tree_offcpu(spark, sf):
    return _tree_columns(profiles.flame_tree(A.stack_samples(spark, sf), offcpu=True))


@query("profile_snapshots", A.duck_with("stacks") + """
, s as (select host, sample_type, timestamp_ns - timestamp_ns % 2592000000000000 as window_ns, cnt as w,
               [comm] || list_reverse(user_names) || list_reverse(kernel_names) as p from stacks),
 n as (select host, sample_type, window_ns, count(distinct p[1:d]) as node_count from
       (select *, unnest(range(0, len(p) + 1)) as d from s) group by 1, 2, 3),
 t as (select host, sample_type, window_ns, cast(sum(w) as bigint) as value, count(*) as samples from s group by 1, 2, 3),
 x as (select *, row_number() over (partition by host, sample_type order by window_ns desc) as rn from n
       join t using (host, sample_type, window_ns))
select host, sample_type, window_ns, node_count, value, samples from x where rn <= 60""")
def profile_snapshots(spark, sf):
    return profiles.profile_snapshots(A.stack_samples(spark, sf), "30 days", keep=60)


TWO_TREES = A.duck_with("stacks") + _tree("cnt", "sample_type = 'oncpu'", "base") + _tree(
    "cnt", "sample_type = 'offcpu'", "comp") + """
, bt as (select name, cast(sum(value) as bigint) as v from base group by 1),
  ct as (select name, cast(sum(value) as bigint) as v from comp group by 1),
  diff as (select name, coalesce(bt.v, 0) as base_value, coalesce(ct.v, 0) as comp_value from bt full join ct using (name)
           where name <> 'root') """


def _two_trees(spark, sf):
    """On-CPU profile as base, off-CPU profile as comparison."""
    s = A.stack_samples(spark, sf)
    return tuple(profiles.flame_tree(s.where(F.col("sample_type") == kind)) for kind in ("oncpu", "offcpu"))


@query("function_totals", A.duck_with("stacks") + _tree("cnt") + """
select name, cast(sum(value) as bigint) as value from tree group by 1""")
def function_totals(spark, sf):
    return profiles.function_totals(profiles.flame_tree(A.stack_samples(spark, sf)))


@query("profile_diff", TWO_TREES + """select name, base_value, comp_value,
 round(case when base_value > 0 then 100.0 * (comp_value - base_value) / base_value when comp_value > 0 then 100 else 0 end, 6)
 as change_pct from diff""")
def profile_diff(spark, sf):
    return profiles.profile_diff(*_two_trees(spark, sf)).withColumn("change_pct", r("change_pct"))


@query("diff_summary", TWO_TREES + """
select count(*) as total, count(*) filter (where comp_value > base_value) as increased, count(*) filter (where comp_value < base_value) as decreased,
       count(*) filter (where base_value = 0 and comp_value > 0) as new, count(*) filter (where base_value > 0 and comp_value = 0) as removed from diff""")
def diff_summary(spark, sf):
    return profiles.diff_summary(profiles.profile_diff(*_two_trees(spark, sf)))


@query("diff_flame", TWO_TREES + """
, d as (select array_to_string(path, ';') as path, comp.name, value, case when depth = 0 then 0.0
   when coalesce(bt.v, 0) > 0 then (ct.v - bt.v) / bt.v when ct.v > 0 then 1.0 else 0.0 end as delta
   from comp join ct on ct.name = comp.name left join bt on bt.name = comp.name)
select path, name, value, round(delta, 6) as delta, case when abs(delta) < 0.05 then 'unchanged' when delta > 0 then 'regression'
  else 'improvement' end as change from d""")
def diff_flame(spark, sf):
    d = profiles.diff_flame(*_two_trees(spark, sf))
    return d.select(F.array_join("path", ";").alias("path"), "name", "value", F.round("delta", 6).alias("delta"), "change")


@query("rank_diff", TWO_TREES + """
select name, base_value, comp_value from diff where contains(lower(name), 'l')
order by abs((comp_value - base_value) / greatest(base_value, 1)) desc, name limit 100""")
def rank_diff(spark, sf):
    return rank.rank_diff(profiles.profile_diff(*_two_trees(spark, sf)), "diff", "L").select(
        "name", "base_value", "comp_value")


@query("folded_stacks", A.duck_with("stacks") + """
select comm || ';' || array_to_string(list_reverse(user_names), ';') as stack, cast(sum(cnt) as bigint) as count
from stacks group by 1""")
def folded_stacks(spark, sf):
    return profiles.folded_stacks(A.stack_samples(spark, sf))


@query("offcpu_flame", A.duck_with("sched") + OFFCPU + """
, w as (select comm, cast(sum(greatest(1, (duration_ns + 500) // 1000)) as bigint) as v from off group by 1)
select 'root' as name, 0::bigint as depth, cast(sum(v) as bigint) as value from w
union all select comm, 1, v from w union all select '[no stack]', 2, v from w""")
def offcpu_flame(spark, sf):
    """Pairing and tree as one plan; the raw events carry no stacks here."""
    off = pairing.offcpu_intervals(A.sched(spark, sf), slice_ns=SLICE)
    none = F.array().cast("array<struct<function_name:string>>")
    tree = profiles.flame_tree(off.withColumns({"count": F.lit(1), "user_stack": none, "kernel_stack": none}), offcpu=True)
    return tree.select("name", F.col("depth").cast("bigint").alias("depth"), "value")
