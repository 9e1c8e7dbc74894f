"""Registered queries, second part: counters, symbols, exports, stores, SQL and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import filters, pairing, profiles, rank, sched, series, stats, symbolize
from hostpulse.plans import adapters as A, registry, sql as S
from hostpulse.plans.queries import DAY, HOUR, SLICE, query, r
from hostpulse.session import durable_dir
from hostpulse.sinks import tables, text
from hostpulse.sources import readers, textdumps
from hostpulse.streaming import run, windows

get = lambda m, k: F.try_element_at(m, F.lit(k))
micros = lambda c="ts": F.unix_micros(c).alias("ts_us")

# ---------------------------------------------------------------------------------------------
# counters

UTIL = """, d as (select *, user_j - lag(user_j) over w as du, system_j - lag(system_j) over w as ds,
  idle_j - lag(idle_j) over w as di, iowait_j - lag(iowait_j) over w as dw from cpu_counters
  window w as (partition by host, cpu order by ts_us)),
util as (select host, cpu, ts_us, 100.0 * du / t as user_pct, 100.0 * ds / t as system_pct, 100.0 * di / t as idle_pct,
  100.0 * dw / t as iowait_pct, 100.0 * (du + ds) / t as busy_pct from
  (select *, case when du + ds + di + dw = 0 then 1 else du + ds + di + dw end as t from d where du is not null) x) """
UTIL_COLS = ("user_pct", "system_pct", "idle_pct", "iowait_pct", "busy_pct")


def _util(spark, sf):
    return series.cpu_utilization(A.cpu_counters(spark, sf))


@query("cpu_utilization", A.duck_with("cpu_counters") + UTIL + "select host, cpu, ts_us, "
       + ", ".join(f"round({c}, 6) as {c}" for c in UTIL_COLS) + " from util")
def cpu_utilization(spark, sf):
    return _util(spark, sf).select("host", "cpu", micros(), *[r(c) for c in UTIL_COLS])


SYSTEM = A.duck_with("sys_counters") + """
, d as (select *, ctxt - lag(ctxt) over w as dc, intr - lag(intr) over w as di, ts_us - lag(ts_us) over w as dt
        from sys_counters window w as (partition by host order by ts_us))"""


@query("system_rates", SYSTEM + """select host, ts_us, round(dc / (dt / 1e6), 9) as context_switches_per_sec,
 round(di / (dt / 1e6), 9) as interrupts_per_sec from d where dt is not null""")
def system_rates(spark, sf):
    out = series.system_rates(A.with_ts(A.table(spark, sf, "sys_counters")))
    return out.select("host", micros(), r("context_switches_per_sec", 9), r("interrupts_per_sec", 9))


@query("system_rates_configured", SYSTEM + """select host, ts_us, dc / 2.0::double as context_switches_per_sec,
 di / 2.0::double as interrupts_per_sec from d where dt is not null""")
def system_rates_configured(spark, sf):
    out = series.system_rates(A.with_ts(A.table(spark, sf, "sys_counters")), 2.0)
    return out.select("host", micros(), "context_switches_per_sec", "interrupts_per_sec")


@query("ema", A.duck_with("cpu_counters") + UTIL + """
select host, cpu, ts_us, round(list_reduce(list(busy_pct) over (partition by host, cpu order by ts_us
   rows between unbounded preceding and current row), lambda a, x: 0.3 * x + 0.7 * a), 6) as busy_pct_ema from util""")
def ema(spark, sf):
    util = _util(spark, sf).select("host", "cpu", "ts", "busy_pct")
    out = series.ema(util, ["host", "cpu"], ["ts"], ["busy_pct"], 0.3, series.time_slice("ts", 5 * DAY))
    return out.select("host", "cpu", micros(), r("busy_pct_ema"))


PROC = """, snap as (select host, ts_us, lag(ts_us) over w as prev_us, tj - lag(tj) over w as dt from
  (select host, ts_us, max(total_jiffies) as tj from {t} group by 1, 2) x window w as (partition by host order by ts_us)),
p as (select c.*, lag(c.ts_us) over w as pts, lag(utime) over w as pu, lag(stime) over w as ps from {t} c
  window w as (partition by host, pid{k} order by c.ts_us)) """
PROC_CPU = A.duck_with("proc_counters") + PROC.format(t="proc_counters", k="") + """
, q as (select p.*, coalesce(pts = prev_us, false) as ok, 100.0 * greatest(utime - pu, 0) / dt * num_cpus as u,
   100.0 * greatest(stime - ps, 0) / dt * num_cpus as s from p join snap using (host, ts_us)),
ranked as (select *, row_number() over (partition by host, ts_us order by case when ok then u + s else 0 end desc, pid) as rn from q),
proc as (select host, ts_us, pid, comm, u as cpu_user_pct, s as cpu_sys_pct, u + s as cpu_total_pct, rss_pages * 4 as rss_kb,
   vsize // 1024 as vsize_kb from ranked where ok and rn <= {n}) """


def _procs(spark, sf, n):
    return series.process_cpu(A.with_ts(A.table(spark, sf, "proc_counters")).withColumn("state", F.lit("R")), n)


@query("process_cpu", PROC_CPU.replace("{n}", "4") + """select host, ts_us, pid, comm, round(cpu_user_pct, 6) as cpu_user_pct,
 round(cpu_sys_pct, 6) as cpu_sys_pct, round(cpu_total_pct, 6) as cpu_total_pct, rss_kb, vsize_kb from proc""")
def process_cpu(spark, sf):
    return _procs(spark, sf, 4).select("host", micros(), "pid", "comm", r("cpu_user_pct"), r("cpu_sys_pct"),
                                       r("cpu_total_pct"), "rss_kb", "vsize_kb")


THREADS = PROC_CPU.replace("{n}", "50") + """
, tsnap as (select host, ts_us, tj - lag(tj) over (partition by host order by ts_us) as dt from
   (select host, ts_us, max(total_jiffies) as tj from thread_counters group by 1, 2) x),
t as (select *, lag(utime) over w as pu, lag(stime) over w as ps from thread_counters
      window w as (partition by host, pid, tid order by ts_us)),
thr as (select t.host, t.ts_us, t.pid, tid, t.comm, 100.0 * greatest(utime - pu, 0) / dt * num_cpus as u,
   100.0 * greatest(stime - ps, 0) / dt * num_cpus as s from t join tsnap using (host, ts_us)
   join proc on proc.host = t.host and proc.ts_us = t.ts_us and proc.pid = t.pid
   where pu is not null and (proc.cpu_total_pct >= 30.0 or proc.pid in (3, 4))) """
THREADS = A.duck_with("proc_counters", "thread_counters") + THREADS[len(A.duck_with("proc_counters")):]


def _threads(spark, sf):
    return series.thread_cpu(A.with_ts(A.table(spark, sf, "thread_counters")), _procs(spark, sf, None), [3, 4], 30.0)


@query("thread_cpu", THREADS + """select host, ts_us, pid, tid, comm, round(u, 6) as cpu_user_pct, round(s, 6) as cpu_sys_pct,
 round(u + s, 6) as cpu_total_pct from thr""")
def thread_cpu(spark, sf):
    return _threads(spark, sf).select("host", micros(), "pid", "tid", "comm", r("cpu_user_pct"), r("cpu_sys_pct"),
                                      r("cpu_total_pct"))


@query("process_tree", THREADS + """select proc.host, proc.ts_us, proc.pid, coalesce(string_agg(thr.tid, ',' order by thr.tid), '')
 as tids from proc left join thr on thr.host = proc.host and thr.ts_us = proc.ts_us and thr.pid = proc.pid group by 1, 2, 3""")
def process_tree(spark, sf):
    tree = series.process_tree(_procs(spark, sf, None), _threads(spark, sf))
    return tree.select("host", micros(), "pid", F.array_join(F.transform("threads", lambda t: t["tid"].cast("string")),
                                                             ",").alias("tids"))


@query("top_n_processes", A.duck_with("proc_counters") + """
select host, ts_us, pid, utime from (select *, row_number() over (partition by host, ts_us order by utime desc, pid) as rn
from proc_counters) where rn <= 5""")
def top_n_processes(spark, sf):
    return series.top_n_per(A.table(spark, sf, "proc_counters"), ["host", "ts_us"],
                            [F.col("utime").desc(), F.col("pid")], 5).select("host", "ts_us", "pid", "utime")


def _rank_procs(by):
    order = {"cpu": "round(cpu_total_pct, 6) desc, pid, host, ts_us", "pid": "pid, host, ts_us", "comm": "comm, pid, host, ts_us"}[by]
    sql = PROC_CPU.replace("{n}", "50") + f"select host, ts_us, pid, comm from proc order by {order} limit 20"

    def fn(spark, sf):
        procs = _procs(spark, sf, 50).withColumn("cpu_total_pct", r("cpu_total_pct"))
        return rank.rank_processes(procs, by, 20).select("host", micros(), "pid", "comm")
    return sql, fn


for _by in ("cpu", "pid", "comm"):
    _sql, _fn = _rank_procs(_by)
    query(f"rank_processes_by_{_by}", _sql)(_fn)


@query("cpu_cumulative_share", A.duck_with("cpu_counters") + """
select host, cpu, ts_us, round(100.0 * user_j / t, 6) as user_pct, round(100.0 * system_j / t, 6) as system_pct,
 round(100.0 * idle_j / t, 6) as idle_pct, round(100.0 * iowait_j / t, 6) as iowait_pct from
 (select *, case when user_j + system_j + idle_j + iowait_j = 0 then 1 else user_j + system_j + idle_j + iowait_j end as t from cpu_counters)""")
def cpu_cumulative_share(spark, sf):
    out = stats.cpu_cumulative_share(A.cpu_counters(spark, sf))
    return out.select("host", "cpu", micros(), r("user_pct"), r("system_pct"), r("idle_pct"), r("iowait_pct"))


GRID = """, times as (select host, ts_us, row_number() over (partition by host order by ts_us) - 1 as pos,
   count(*) over (partition by host) as n from (select distinct host, ts_us from util) x),
grid as (select host, ts_us from times where pos % cast(greatest(1, ceil(n / 60.0)) as bigint) = 0) """


@query("downsample_times", A.duck_with("cpu_counters") + UTIL + GRID + "select host, ts_us from grid")
def downsample_times(spark, sf):
    return series.downsample_times(_util(spark, sf)).select("host", micros())


@query("core_heatmap", A.duck_with("cpu_counters") + UTIL + GRID + """
, cells as (select g.host, c.cpu, g.ts_us from grid g join (select distinct host, cpu from util) c on c.host = g.host),
near as (select cells.host, cells.cpu, cells.ts_us, busy_pct, row_number() over (partition by cells.host, cells.cpu, cells.ts_us
   order by abs(util.ts_us - cells.ts_us), util.ts_us) as rn from cells join util on util.host = cells.host and util.cpu = cells.cpu)
select host, cpu, cast(substr(cpu, 4) as bigint) as core, ts_us, round(busy_pct, 6) as busy_pct from near where rn = 1""")
def core_heatmap(spark, sf):
    out = series.core_heatmap(_util(spark, sf))
    return out.select("host", "cpu", "core", micros(), r("busy_pct"))


@query("nearest_join", A.duck_with("cpu_counters", "ev") + UTIL + """
, g as (select host, 'cpu' || user_id % 4 as cpu, seq, timestamp_ns // 1000 as grid_us from ev),
near as (select g.*, util.ts_us, busy_pct, row_number() over (partition by g.seq order by abs(util.ts_us - grid_us), util.ts_us) as rn
   from g join util on util.host = g.host and util.cpu = g.cpu)
select seq, grid_us, round(busy_pct, 6) as busy_pct from near where rn = 1""")
def nearest_join(spark, sf):
    """The utilization sample nearest to each event on its cpu."""
    ev = A.table(spark, sf, "ev")
    grid = ev.select("host", F.concat(F.lit("cpu"), F.col("user_id") % 4).alias("cpu"), "seq", C.ns_to_ts("timestamp_ns").alias("ts"))
    out = series.nearest_join(grid, _util(spark, sf))
    return out.select("seq", F.unix_micros("ts").alias("grid_us"), r("busy_pct"))


@query("utilization_history", A.duck_with("tot_counters") + UTIL.replace("from cpu_counters", "from tot_counters") + """
select host, ts_us, round(user_pct, 6) as user, round(system_pct, 6) as system, round(idle_pct, 6) as idle, 0.0::double as irq
from (select *, row_number() over (partition by host order by ts_us desc) as rn from util) where rn <= 300""")
def utilization_history(spark, sf):
    hist = series.utilization_history(series.cpu_utilization(A.cpu_counters(spark, sf, "tot_counters")), 300)
    return hist.select("host", micros(), r("user"), r("system"), r("idle"), "irq")


@query("total_utilization", A.duck_with("tot_counters") + UTIL.replace("from cpu_counters", "from tot_counters") + """
select host, ts_us, 'cpu_total' as type, round(busy_pct, 6) as busy_pct from util""")
def total_utilization(spark, sf):
    both = A.cpu_counters(spark, sf).unionByName(A.cpu_counters(spark, sf, "tot_counters"))
    return series.cpu_utilization(both, per_core=False).select("host", micros(), "type", r("busy_pct"))


@query("retain_series", A.duck_with("rec") + """
select seq, feed from (select *, row_number() over (partition by feed order by timestamp_ns desc, seq desc) as rn from rec
where timestamp_ns // 1000 >= (select max(timestamp_ns // 1000) from rec) - 15 * 86400000000) where rn <= 1800""")
def retain_series(spark, sf):
    rec = A.records(spark, sf)
    slim = rec.select("pipeline", "ts", F.col("seq"))
    out = series.retain_series(slim, ["pipeline"], 1800, 15 * 86400 * 1000, rec.agg(F.max("ts")).scalar())
    return out.select("seq", F.col("pipeline").alias("feed"))


@query("latest_value", A.duck_with("rec") + """
select feed, arg_max(seq, timestamp_ns) as seq, arg_max(event_type, timestamp_ns) as event_type from rec group by 1""")
def latest_value(spark, sf):
    return stats.latest(A.table(spark, sf, "rec"), ["feed"], ("timestamp_ns", "seq")).select("feed", "seq", "event_type")


@query("metric_pivot", A.duck_with("cpu_counters") + UTIL + """
select 'cpu_core' as kind, cpu, ts_us, round(user_pct, 6) as v1, 0.0::double as v2 from util
union all select 'loadavg', '', ts_us, round(busy_pct, 6), 0.0::double from util""")
def metric_pivot(spark, sf):
    util = _util(spark, sf).withColumn("timestamp_ns", F.unix_micros("ts") * 1000)
    cores = util.select("host", "timestamp_ns", F.create_map(F.lit("type"), F.lit("cpu_core"), F.lit("cpu"), F.col("cpu")).alias("labels"),
                        F.create_map(F.lit("user_pct"), F.col("user_pct")).alias("fields"))
    loads = util.select("host", "timestamp_ns", F.create_map(F.lit("type"), F.lit("loadavg")).alias("labels"),
                        F.create_map(F.lit("load_1m"), F.col("busy_pct")).alias("fields"))
    kinds = filters.pivot_cpu_metrics(cores.unionByName(loads))
    us_of = C.int_div("timestamp_ns", 1000).alias("ts_us")
    a = kinds["cpu_core"].select(F.lit("cpu_core").alias("kind"), "cpu", us_of, F.round("user_pct", 6).alias("v1"),
                                 F.col("irq_all").alias("v2"))
    b = kinds["loadavg"].select(F.lit("loadavg").alias("kind"), F.lit("").alias("cpu"), us_of,
                                F.round("load_1m", 6).alias("v1"), F.col("load_5m").alias("v2"))
    return a.unionByName(b)


# --- stage health -----------------------------------------------------------------------------

LAST_STAGE = A.duck_with("stages") + """, l as (select * from (select *, row_number() over (partition by host, name
 order by ts_us desc, seq desc) as rn from stages) where rn = 1)"""


def _stages(spark, sf):
    return A.with_ts(A.table(spark, sf, "stages"))


@query("fleet_health", LAST_STAGE + """
select count(*) filter (where running) as running, count(*) as total, cast(sum(batches) as bigint) as batches,
 cast(sum(records) as bigint) as records, cast(sum(errors) as bigint) as errors, cast(sum(dropped) as bigint) as dropped,
 count(*) filter (where size > 80) as critical, count(*) filter (where size > 50 and size <= 80) as warning from l""")
def fleet_health(spark, sf):
    return stats.stage_health(_stages(spark, sf))


@query("stage_latest", LAST_STAGE + """select host, name, seq, size / 100.0::double as utilization,
 case when size > 80 then 'critical' when size > 50 then 'warning' else 'ok' end as level from l""")
def stage_latest(spark, sf):
    return stats.stage_latest(_stages(spark, sf)).select("host", "name", "seq", "utilization", "level")


@query("channel_history", A.duck_with("stages") + """
select host, name as stage, ts_us, size, round(size / 100.0 * 100.0, 6) as utilization, enqueued, dropped from stages
where ts_us >= 1704326400000000 and ts_us <= 1705276800000000""")
def channel_history(spark, sf):
    out = stats.channel_history(_stages(spark, sf).withColumn("size", F.col("size").cast("bigint")),
                                F.timestamp_micros(F.lit(1704326400000000)), F.timestamp_micros(F.lit(1705276800000000)))
    return out.select("host", "stage", micros(), "size", r("utilization"), "enqueued", "dropped")


METER = """, m as (
 select 'counter' as kind, name, unnest(['value']) as stat, sum(value)::double as value from meter where kind = 'counter' group by 2
 union all select 'gauge', name, 'value', arg_max(value, timestamp_ns)::double from meter where kind = 'gauge' group by 2
 union all select 'latency', name, unnest(['count', 'sum', 'avg', 'min', 'max']),
   unnest([count(*)::double, sum(value)::double, (sum(value) // count(*))::double, min(value)::double, max(value)::double])
   from meter where kind = 'latency' group by 2) """


@query("internal_metrics", A.duck_with("meter") + METER + "select * from m")
def internal_metrics(spark, sf):
    return stats.internal_metrics(A.table(spark, sf, "meter"))


@query("internal_metrics_text", A.duck_with("meter") + METER + """
select 'app_' || name as name, 'app_' || name || case when stat = 'value' then '' else '_' || stat end || ' ' || value::bigint as line from m
union all select distinct 'app_' || name, '# TYPE app_' || name || ' ' || case when kind = 'latency' then 'summary' else kind end from m""")
def internal_metrics_text(spark, sf):
    return stats.internal_metrics_text(stats.internal_metrics(A.table(spark, sf, "meter")), "app").select("name", "line")


# ---------------------------------------------------------------------------------------------
# symbols

@query("kernel_symbols", A.duck_with("ksyms", "kframes") + """
, a as (select distinct host, address from kframes), k as (select * from ksyms where type = 'T')
select a.host, a.address::varchar as address, coalesce(k.name, '[kernel 0x' || lower(printf('%x', a.address::uhugeint)) || ']') as name
from a asof left join k on a.host = k.host and a.address >= k.address""".replace(
    "lower(printf('%x', a.address::uhugeint))", "lower(hex(a.address::ubigint))"))
def kernel_symbols(spark, sf):
    frames = A.table(spark, sf, "kframes")
    return symbolize.kernel_names(frames, A.table(spark, sf, "ksyms"), 4096).select(
        "host", F.col("address").cast("string").alias("address"), "name")


@query("symbolize_kernel", A.duck_with("ksyms", "kframes") + """
, k as (select * from ksyms where type = 'T')
select a.seq, coalesce(k.name, '[kernel 0x' || lower(hex(a.address::ubigint)) || ']') as name
from kframes a asof left join k on a.host = k.host and a.address >= k.address""")
def symbolize_kernel(spark, sf):
    out = symbolize.symbolize_kernel(A.kernel_samples(spark, sf), A.table(spark, sf, "ksyms"), slice_width=4096)
    return out.select("seq", F.col("kernel_stack")[0]["function_name"].alias("name"))


USER_SQL = A.duck_with("maps", "elf", "uframes") + """
, a as (select distinct host, pid, address from uframes),
m as (select a.*, maps.path, a.address - start_at as delta, a.address - start_at + file_at as off,
   row_number() over (partition by a.host, a.pid, a.address order by ord) as rn from a left join maps
   on maps.host = a.host and maps.pid = a.pid and a.address >= start_at and a.address < end_at),
f as (select * exclude (rn) from m where rn = 1),
e as (select * from (select path, value, size, name, row_number() over (partition by path, value order by size desc, name desc) as r
   from elf where type in ('FUNC', 'IFUNC', 'OBJECT') and not (value = 0 and size = 0)) where r = 1),
g as (select f.host, f.pid, f.address, f.path, delta, case when e.size = 0 or off < e.value + e.size then e.name end as sym,
   f.path in (select path from e) as readable from f asof left join e on f.path = e.path and f.off >= e.value),
names as (select host, pid, address, coalesce(sym, case when readable then '[' || path || '+0x' || lower(hex(delta::ubigint)) || ']' end,
   '[0x' || lower(hex(address::ubigint)) || ']') as name from g) """


@query("user_symbols", USER_SQL + "select host, pid, address::varchar as address, name from names")
def user_symbols(spark, sf):
    out = symbolize.user_names(A.table(spark, sf, "uframes"), A.proc_maps(spark, sf), A.table(spark, sf, "elf"), 65536)
    return out.select("host", "pid", F.col("address").cast("string").alias("address"), "name")


@query("symbolize_user", USER_SQL + "select seq, upper(name) as name from uframes join names using (host, pid, address)")
def symbolize_user(spark, sf):
    out = symbolize.symbolize_user(A.user_samples(spark, sf), A.proc_maps(spark, sf), A.table(spark, sf, "elf"),
                                   demangle=F.upper, slice_width=65536)
    return out.select("seq", F.col("user_stack")[0]["function_name"].alias("name"))


@query("prepared_symbols", A.duck_with("elf") + """
select path, name from elf where type in ('FUNC', 'IFUNC', 'OBJECT') and not (value = 0 and size = 0)""")
def prepared_symbols(spark, sf):
    return symbolize.prepare_symbols(A.table(spark, sf, "elf")).select("path", "name")


# ---------------------------------------------------------------------------------------------
# captured text

@query("stat_dump_cpu", A.duck_with("cpu_counters") + """
select host, ts_us, cpu, user_j as "user", system_j as system, idle_j as idle, iowait_j as iowait, 0::bigint as steal from cpu_counters""")
def stat_dump_cpu(spark, sf):
    c = A.table(spark, sf, "cpu_counters")
    line = F.concat_ws(" ", "cpu", "user_j", F.lit("0"), "system_j", "idle_j", "iowait_j", F.lit("0 0"))
    lines = c.select("host", "ts_us", F.explode(F.array(line, F.lit("cpufreq 1 2"), F.lit("btime 1"))).alias("value"))
    return textdumps.parse_proc_stat(lines, ("host", "ts_us"))[0].select(
        "host", "ts_us", "cpu", "user", "system", "idle", "iowait", "steal")


@query("stat_dump_system", A.duck_with("sys_counters") + """
select host, ts_us, ctxt, intr, running::bigint as procs_running, null::bigint as procs_blocked from sys_counters""")
def stat_dump_system(spark, sf):
    c = A.table(spark, sf, "sys_counters")
    lines = c.select("host", "ts_us", F.explode(F.array(
        F.concat(F.lit("ctxt "), "ctxt"), F.concat(F.lit("intr "), "intr", F.lit(" 5 6 7")),
        F.concat(F.lit("procs_running "), "running"), F.lit("softirq 1 2 3"))).alias("value"))
    return textdumps.parse_proc_stat(lines, ("host", "ts_us"))[1]


@query("maps_dump", A.duck_with("maps") + """
select host, pid, start_at::varchar as start, end_at::varchar as "end", file_at::varchar as "offset", path from maps where ord % 5 <> 0""")
def maps_dump(spark, sf):
    m = A.table(spark, sf, "maps")
    hexed = lambda c: F.lower(F.hex(F.col(c).cast("bigint")))
    path = F.when(F.col("ord") % 5 == 0, F.lit("[heap]")).otherwise(F.col("path"))
    good = F.concat(hexed("start_at"), F.lit("-"), hexed("end_at"), F.lit(" r-xp "), hexed("file_at"),
                    F.lit(" 08:01 1234      "), path)
    lines = m.select("host", "pid", F.explode(F.array(good, F.lit("not a maps line"))).alias("value"))
    return textdumps.parse_proc_maps(lines).select(
        "host", "pid", *[F.col(c).cast("string").alias(c) for c in ("start", "end", "offset")], "path")


@query("symbol_dump", A.duck_with("ksyms") + "select host, address::varchar as address, name from ksyms where type = 'T'")
def symbol_dump(spark, sf):
    k = A.table(spark, sf, "ksyms")
    lines = k.select("host", F.concat(C.address_hex("address"), F.lit(" "), "type", F.lit(" "), "name", F.lit("\t[mod]")).alias("value"))
    return textdumps.parse_kallsyms(lines).select("host", F.col("address").cast("string").alias("address"), "name")


# ---------------------------------------------------------------------------------------------
# exports

@query("prometheus_lines", A.duck_with("rec") + """
, v as (select user_id, event_type, arg_max(value, timestamp_ns) as value, arg_max(seq, timestamp_ns) as seq from rec group by 1, 2),
f as (select *, '{type="' || event_type || '",user="' || user_id || '"}' as lab from v)
select 'app_kind' as metric, 'app_kind' || lab || ' 0.0' as line from f
union all select 'app_odd', 'app_odd' || lab || case when seq % 2 = 1 then ' 1.0' else ' 0.0' end from f
union all select 'app_value', 'app_value' || lab || ' ' || value from f
union all select unnest(['app_kind', 'app_odd', 'app_value']), unnest(['# TYPE app_kind gauge', '# TYPE app_odd gauge', '# TYPE app_value gauge'])
union all select unnest(['app_kind', 'app_odd', 'app_value']), unnest(['# HELP app_kind gauge of app_kind', '# HELP app_odd gauge of app_odd',
 '# HELP app_value gauge of app_value'])""")
def prometheus_lines(spark, sf):
    return text.prometheus_exposition(A.records(spark, sf), "app").select("metric", "line")


@query("otlp_payloads", A.duck_with("rec") + """
, p as (select host, batch_id, timestamp_ns, seq, ',"attributes":[{"key":"type","value":{"stringValue":"' || event_type ||
   '"}},{"key":"user","value":{"stringValue":"' || user_id || '"}}]' as attr, value from rec),
m as (select host, batch_id, timestamp_ns, seq, 'kind' as field, '0.0' as v, attr from p
 union all select host, batch_id, timestamp_ns, seq, 'odd', case when seq % 2 = 1 then '1.0' else '0.0' end, attr from p
 union all select host, batch_id, timestamp_ns, seq, 'value', value::varchar, attr from p)
select host, batch_id, '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[' || string_agg('{"name":"' || field ||
  '","gauge":{"dataPoints":[{"timeUnixNano":' || timestamp_ns || ',"asDouble":' || v || attr || '}]}}', ',' order by timestamp_ns, seq, field)
  || ']}]}]}' as payload from m group by 1, 2""")
def otlp_payloads(spark, sf):
    return text.otlp_payload(A.records(spark, sf)).select("host", "batch_id", "payload")


@query("split_documents", A.duck_with("rec") + "select host, batch_id, count(*) * 3 as points from rec group by 1, 2")
def split_documents(spark, sf):
    """Oversized batches in several documents: no data point is lost or repeated."""
    docs = text.otlp_payload(A.records(spark, sf), max_items=40)
    points = F.size(F.split("payload", '"asDouble"')) - 1
    return docs.groupBy("host", "batch_id").agg(F.sum(points).alias("points"))


RECORD_JSON = """'{"fields":{"value":' || value || ',"kind":"' || event_type || '","odd":' ||
 case when seq % 2 = 1 then 'true' else 'false' end || '},"labels":{"type":"' || event_type || '","user":"' || user_id || '"}}'"""


@query("json_lines", A.duck_with("rec") + f"select {RECORD_JSON} as value from rec")
def json_lines(spark, sf):
    return text.export_jsonl(A.records(spark, sf))


@query("record_text", A.duck_with("rec") + """
select '[' || timestamp_ns || '] {type=' || event_type || '} {user=' || user_id || '} value=' || printf('%.3f', value) ||
 ' kind=' || event_type || ' odd=' || case when seq % 2 = 1 then 'true' else 'false' end as line from rec""")
def record_text(spark, sf):
    return text.format_records(A.records(spark, sf))


@query("stack_text", A.duck_with("stacks") + """
select '[stack] pid=' || pid || ' tid=' || tid || ' comm=' || comm || ' count=' || cnt || chr(10) || '  ' ||
 array_to_string(user_names, '+0x0' || chr(10) || '  ') || '+0x0' as line from stacks""")
def stack_text(spark, sf):
    return text.format_stacks(A.stack_samples(spark, sf))


@query("batch_documents", A.duck_with("rec", "stacks") + f"""
, doc as (select feed, batch_id, string_agg({RECORD_JSON}, ',' order by timestamp_ns, seq) as recs from rec group by 1, 2),
sam as (select 'feed_' || seq % 3 as feed, seq // 640000000000 as batch_id, string_agg('{{"pid":' || pid || ',"tid":' || tid || ',"cpu":' || cpu || ',"count":'
  || cnt || ',"comm":"' || comm || '","type":' || case when sample_type = 'offcpu' then 1 else 0 end || case when duration_ns > 0 then
  ',"duration_ns":' || duration_ns else '' end || ',"kernel_stack":[' || array_to_string(list_transform(kernel_names,
  lambda n: '{{"address":0,"function_name":"' || n || '"}}'), ',') || '],"user_stack":[' || array_to_string(list_transform(user_names,
  lambda n: '{{"address":0,"function_name":"' || n || '"}}'), ',') || ']}}', ',' order by timestamp_ns, seq) as sams from stacks group by 1, 2)
select feed as pipeline_name, batch_id, '{{"pipeline":"' || feed || '","records":[' || coalesce(recs, '') || ']' ||
  case when sams is not null then ',"stack_samples":[' || sams || ']' else '' end || '}}' as document from doc full join sam using (feed, batch_id)""")
def batch_documents(spark, sf):
    samples = A.stack_samples(spark, sf).withColumn("pipeline", F.concat(F.lit("feed_"), F.col("seq") % 3)).withColumn(
        "batch_id", C.int_div("seq", 640000000000))
    docs = text.batch_json(A.records(spark, sf), samples)
    return docs.select(F.col("pipeline").alias("pipeline_name"), "batch_id", "document")


@query("recent_batches", A.duck_with("rec") + """
select feed, batch_id, seq from (select *, dense_rank() over (partition by feed order by batch_id desc) as age from rec) where age <= 5""")
def recent_batches(spark, sf):
    return tables.recent_batches(A.records(spark, sf), "pipeline", 5).select(F.col("pipeline").alias("feed"), "batch_id", "seq")


@query("latest_batch", A.duck_with("rec") + "select feed, batch_id, seq from (select *, max(batch_id) over (partition by feed) as newest from rec) where batch_id = newest")
def latest_batch(spark, sf):
    return tables.latest_batch(A.records(spark, sf)).select(F.col("pipeline").alias("feed"), "batch_id", "seq")


# ---------------------------------------------------------------------------------------------
# stores

def _stored(spark, sf):
    path = durable_dir(spark, "records")
    tables.write_records(A.records(spark, sf), path)
    return path


@query("record_store", A.duck_with("rec") + """
select host, feed, seq, timestamp_ns, user_id::varchar as user, value from rec where feed = 'feed_2' and timestamp_ns >= 1704499200000000000
 and timestamp_ns <= 1705276800000000000""")
def record_store(spark, sf):
    stored = readers.read_table(spark, _stored(spark, sf))
    out = readers.query_records(stored, "feed_2", 1704499200000000000, 1705276800000000000, None)
    return out.select("host", F.col("pipeline").alias("feed"), "seq", "timestamp_ns", get("labels", "user").alias("user"),
                      get("fields", "value").alias("value"))


@query("sample_store", A.duck_with("stacks") + """
select comm, sample_type, count(*) as n, cast(sum(cnt) as bigint) as count, cast(sum(len(kernel_names)) as bigint) as kernel_frames
from stacks group by 1, 2""")
def sample_store(spark, sf):
    path = durable_dir(spark, "samples")
    tables.write_stack_samples(A.stack_samples(spark, sf), path)
    return readers.read_table(spark, path).groupBy("comm", "sample_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("count"), F.sum(F.size("kernel_stack")).alias("kernel_frames"))


@query("profile_store", A.duck_with("profs") + """
select profile_type, start_ns, end_ns, sample_count from profs where feed = 'feed_1' and end_ns >= 1000000""")
def profile_store(spark, sf):
    path = durable_dir(spark, "profiles")
    p = A.table(spark, sf, "profs").withColumnRenamed("feed", "pipeline")
    tables.write_profiles(p.withColumn("data", F.encode(F.col("profile_type"), "utf-8")), path)
    return readers.list_profiles(readers.read_table(spark, path), "feed_1", 1000000).select(
        "profile_type", "start_ns", "end_ns", "sample_count")


@query("event_store", A.duck_with("sched") + "select event_type, cpu, count(*) as n, cast(sum(next_pid) as bigint) as pids from sched group by 1, 2")
def event_store(spark, sf):
    path = durable_dir(spark, "sched")
    A.sched(spark, sf).write.parquet(path)
    return readers.read_events(spark, path, "sched").groupBy("event_type", "cpu").agg(
        F.count(F.lit(1)).alias("n"), F.sum("next_pid").alias("pids"))


@query("counter_store", A.duck_with("cpu_counters") + """
select cpu, count(*) as n, max(user_j) as top_user from cpu_counters group by 1""")
def counter_store(spark, sf):
    path = durable_dir(spark, "cpu")
    A.cpu_counters(spark, sf).write.parquet(path)
    return readers.read_counters(spark, path, "cpu").groupBy("cpu").agg(
        F.count(F.lit(1)).alias("n"), F.max("user").alias("top_user"))


@query("jsonl_store", A.duck_with("rec") + """
select host, timestamp_ns, event_type as type, value, event_type as kind, seq % 2 = 1 as odd from rec""")
def jsonl_store(spark, sf):
    path = durable_dir(spark, "lines")
    tables.write_jsonl(A.records(spark, sf), path, include_ts=True)
    back = readers.read_jsonl(spark, path)
    return back.select("host", "timestamp_ns", get("labels", "type").alias("type"), get("fields", "value").alias("value"),
                       get("fields_str", "kind").alias("kind"), get("fields_bool", "odd").alias("odd"))


@query("folded_store", A.duck_with("stacks") + """
select comm || ';' || array_to_string(list_reverse(user_names), ';') || ' ' || cast(sum(cnt) as bigint) as value from stacks
group by comm, user_names""")
def folded_store(spark, sf):
    path = durable_dir(spark, "folded")
    tables.write_folded(A.stack_samples(spark, sf), path)
    return spark.read.text(path)


@query("retention", A.duck_with("rec") + """
select seq, feed from rec where timestamp_ns >= (select max(timestamp_ns) from rec) - 432000000000000""")
def retention(spark, sf):
    rec = A.records(spark, sf)
    now = rec.agg(F.max("timestamp_ns")).first()[0]
    return tables.prune(rec, 5 * DAY, now).select("seq", F.col("pipeline").alias("feed"))


@query("retention_store", A.duck_with("rec") + """
select seq, feed from rec where timestamp_ns >= (select max(timestamp_ns) from rec) - 432000000000000""")
def retention_store(spark, sf):
    path = _stored(spark, sf)
    now = A.records(spark, sf).agg(F.max("timestamp_ns")).first()[0]
    tables.prune_table(spark, path, 5 * DAY, now)
    return readers.read_table(spark, path).select("seq", F.col("pipeline").alias("feed"))


@query("compaction", A.duck_with("rec") + "select seq, feed, value from rec")
def compaction(spark, sf):
    path = _stored(spark, sf)
    tables.compact_table(spark, path, 1)
    return readers.read_table(spark, path).select("seq", F.col("pipeline").alias("feed"), get("fields", "value").alias("value"))


# ---------------------------------------------------------------------------------------------
# set operations, scalars, SQL, user stages

@query("union_of_feeds", A.duck_with("rec", "stacks") + """
select feed, null::varchar as comm, seq from rec union all select null, comm, seq from stacks""")
def union_all(spark, sf):
    rec = A.table(spark, sf, "rec").select("feed", "seq")
    return rank.union_pipelines([rec, A.table(spark, sf, "stacks").select("comm", "seq")])


@query("scalar_functions", A.duck_with("ev") + """
select seq, regexp_replace(event_type || '.' || user_id || '-x', '[^A-Za-z0-9_]', '_', 'g') as metric,
 'a\\\\b\\"' || user_id || '\\n' as label, lower(hex(user_id * 7919)) as address, floor(value + 0.5)::bigint as rounded,
 timestamp_ns // 1000 as us, timestamp_ns // 1000000 as ms, user_id as core, user_id || ',5' as numbers,
 case seq % 4 when 1 then 'wakeup' when 2 then 'migrate' else 'switch' end as code from ev""")
def scalar_functions(spark, sf):
    ev = A.table(spark, sf, "ev")
    return ev.select(
        "seq", C.sanitize_metric_name(F.concat("event_type", F.lit("."), "user_id", F.lit("-x"))).alias("metric"),
        C.escape_label(F.concat(F.lit('a\\b"'), "user_id", F.lit("\n"))).alias("label"),
        C.address_hex((F.col("user_id") * 7919).cast(C.ADDRESS)).alias("address"), C.round_half_up("value").alias("rounded"),
        C.us("timestamp_ns").alias("us"), C.ms("timestamp_ns").alias("ms"),
        C.core_sort_key(F.concat(F.lit("node3-cpu"), "user_id", F.lit("x"))).alias("core"),
        F.array_join(C.parse_csv_list(F.concat(F.lit(" "), "user_id", F.lit(" ,, 5,x")), "bigint"), ",").alias("numbers"),
        C.event_type_name(F.col("seq") % 4).alias("code"))


@query("read_only_sql", A.duck_with("rec") + """
select feed, event_type, count(*) as n, '[blob]' as raw from rec group by 1, 2""")
def read_only_sql(spark, sf):
    S.register_views(spark, tables={"hp_records": A.table(spark, sf, "rec")})
    return S.run_sql(spark, "WITH r AS (SELECT * FROM hp_records) SELECT feed, event_type, count(*) AS n, "
                            "encode('x', 'utf-8') AS raw FROM r GROUP BY feed, event_type")


@query("flush_metrics", A.duck_with("rec") + """
select host, timestamp_ns - timestamp_ns % 86400000000000 as timestamp_ns, count(*)::double as n, max(value) as top from rec
group by 1, 2, event_type""")
def flush_metrics(spark, sf):
    metrics, _ = stats.flush(A.type_records(spark, sf), A.stack_samples(spark, sf), "1 day")
    return metrics.select("host", "timestamp_ns", get("fields", "value_count").alias("n"), get("fields", "value_max").alias("top"))


@query("user_stages", A.duck_with("rec") + """
select timestamp_ns - timestamp_ns % 86400000000000 as day_ns, count(*) as n from rec where event_type <> 'click' and user_id >= 10 group by 1""")
def user_stages(spark, sf):
    """A declared chain of built-in and user-registered stages, written to a table by its sink."""
    path = durable_dir(spark, "chain")
    registry.register_source("test_records", lambda s: A.records(s, sf))
    registry.register_processor("min_user", lambda df, least: df.where(get("labels", "user").cast("bigint") >= least))
    registry.register_aggregator("per_day", lambda df: df.groupBy(C.floor_to("timestamp_ns", DAY).alias("day_ns")).agg(
        F.count(F.lit(1)).alias("n")))
    registry.register_sink("to_path", lambda df, batch_id: df.write.mode("append").parquet(path))
    registry.start_pipeline(spark, {
        "name": "days", "source": "test_records", "aggregator": "per_day", "sinks": ["to_path"],
        "processors": [{"type": "exclude_label", "options": {"key": "type", "value": "click"}},
                       {"type": "min_user", "options": {"least": 10}}]})
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------------------------
# streams

def _event_stream(spark, sf, watermark="1 hour"):
    """The events table as a stream, with the columns the operators need."""
    from hostpulse.session import prepare
    prepare(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ts = F.col("ts").cast("timestamp")
    out = raw.select(F.col("event_id").alias("seq"), ts.alias("ts"), (F.unix_micros(ts) * 1000).alias("timestamp_ns"), "user_id",
                     "event_type", "value", F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string")).alias("host"))
    return out.withWatermark("ts", watermark) if watermark else out


def _sched_stream(spark, sf, watermark="1 hour"):
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "switch").when(
        F.col("event_type") == "signup", "wakeup").otherwise("migrate")
    return _event_stream(spark, sf, watermark).select(
        "host", "seq", "ts", "timestamp_ns", (F.col("user_id") % 8).alias("cpu"), kind.alias("event_type"),
        F.col("user_id").alias("next_pid"), ((F.col("seq") * 7) % 150).alias("prev_pid"),
        F.concat(F.lit("proc_"), F.col("user_id") % 10).alias("next_comm"))


@query("stream_window_stats", A.duck_with("rec") + """
select host, window_ns, round(avg(value), 9) as avg, count(*) as count, round(case when count(*) >= 4 then quantile_cont(value, 0.5) end, 9) as p50,
  type from (select *, timestamp_ns - timestamp_ns % 21600000000000 as window_ns, event_type as type from rec)
group by host, window_ns, type having window_ns // 1000 + 21600000000 <= (select max(timestamp_ns // 1000) from rec) - 3600000000""")
def stream_window_stats(spark, sf):
    recs = _event_stream(spark, sf, None).select(
        "host", "ts", F.create_map(F.lit("type"), F.col("event_type")).alias("labels"),
        F.create_map(F.lit("value"), F.col("value")).alias("fields"))
    out = run.to_table(windows.stream_window_stats(recs, "6 hours", "1 hour"))
    return out.select("host", "window_ns", F.col("labels")[0]["value"].alias("type"), r("avg", 9), "count", r("p50", 9))


@query("stream_runqueue_latency", A.duck_with("sched") + """
, w as (select *, lag(event_type) over w as pt, lag(timestamp_ns) over w as pn from sched where event_type <> 'migrate'
   window w as (partition by host, next_pid order by timestamp_ns, seq))
select seq, event_type, case when event_type = 'switch' and pt = 'wakeup' then timestamp_ns - pn else 0 end as latency_ns from w
union all select seq, event_type, 0 from sched where event_type = 'migrate'""")
def stream_runqueue_latency(spark, sf):
    return run.to_table(pairing.runqueue_latency(_sched_stream(spark, sf, None))).select("seq", "event_type", "latency_ns")


@query("stream_sched_stats", A.duck_with("sched") + """
, w as (select *, lag(event_type) over w as pt, lag(timestamp_ns) over w as pn from sched where event_type <> 'migrate'
   window w as (partition by host, next_pid order by timestamp_ns, seq)),
lat as (select host, seq, timestamp_ns, next_pid, event_type, case when event_type = 'switch' and pt = 'wakeup' then timestamp_ns - pn else 0 end as lat from w
  union all select host, seq, timestamp_ns, next_pid, event_type, 0 from sched where event_type = 'migrate')
select host, timestamp_ns - timestamp_ns % 21600000000000 as window_ns, next_pid as pid, count(*) filter (where event_type = 'switch') as switch_count,
  cast(sum(lat) as bigint) as total_runqueue_latency_ns, count(*) filter (where event_type = 'migrate') as migrate_count from lat
where (event_type = 'switch' and next_pid <> 0) or event_type = 'migrate' group by 1, 2, 3
having window_ns // 1000 + 21600000000 <= (select max(timestamp_ns // 1000) from sched) - 3600000000""")
def stream_sched_stats(spark, sf):
    """Pairing state, then a windowed aggregation, in one streaming query."""
    latency = pairing.runqueue_latency(_sched_stream(spark, sf))
    out = run.to_table(windows.window_start(windows.stream_sched_stats(latency, "6 hours", None)))
    return out.select("host", "window_ns", "pid", "switch_count", "total_runqueue_latency_ns", "migrate_count")


@query("stream_block_io", A.duck_with("block") + """
, b as (select *, lag(phase) over w as pp, lag(timestamp_ns) over w as pn from block where phase in ('issue', 'complete')
  window w as (partition by host, sector order by timestamp_ns, seq))
select seq, timestamp_ns - pn as latency_ns from b where phase = 'complete' and pp = 'issue'""")
def stream_block_io(spark, sf):
    phase = F.when(F.col("event_type") == "click", "issue").when(F.col("event_type") == "view", "complete").otherwise("other")
    block = _event_stream(spark, sf, None).select(
        "host", "seq", "timestamp_ns", phase.alias("phase"), (F.col("seq") % 3).alias("dev"), F.col("user_id").alias("sector"),
        (F.col("seq") % 16).alias("nr_sector"), (F.col("seq") % 50).alias("pid"), (F.col("seq") % 70).alias("tid"),
        F.concat(F.lit("proc_"), F.col("seq") % 10).alias("comm"), F.lit("R").alias("rwbs"))
    return run.to_table(pairing.block_io_latency(block)).select("seq", "latency_ns")


@query("stream_ema", A.duck_with("ev") + """
select seq, round(list_reduce(list(value) over (partition by user_id order by timestamp_ns, seq rows between unbounded preceding
  and current row), lambda a, x: x / 3.0 + a * 2.0 / 3.0), 6) as value_ema from ev""")
def stream_ema(spark, sf):
    ev = _event_stream(spark, sf, None)
    return run.to_table(series.ema(ev, ["user_id"], ["timestamp_ns", "seq"], ["value"], 1 / 3)).select("seq", r("value_ema"))


@query("stream_rates", A.duck_with("ev") + """
select seq, timestamp_ns - lag(timestamp_ns) over w as gap_ns from ev
window w as (partition by user_id order by timestamp_ns, seq)""")
def stream_rates(spark, sf):
    from hostpulse.operators.ordered import with_neighbor
    ev = _event_stream(spark, sf, None)
    out = with_neighbor(ev, ["user_id"], ["timestamp_ns", "seq"], ["timestamp_ns"], "before")
    return run.to_table(out.select("seq", (F.col("timestamp_ns") - F.col("before.timestamp_ns")).alias("gap_ns")))


@query("stream_profile_counts", A.duck_with("cpu_samples") + """
select host, timestamp_ns - timestamp_ns % 3600000000000 as window_ns, pid, tid, comm, count(*) as count from cpu_samples
group by 1, 2, 3, 4, 5, kernel_stack_id, user_stack_id
having window_ns // 1000 + 3600000000 <= (select max(timestamp_ns // 1000) from cpu_samples) - 3600000000""")
def stream_profile_counts(spark, sf):
    samples = _event_stream(spark, sf, None).select(
        "host", "ts", F.col("user_id").alias("pid"), (F.col("seq") % 7).alias("tid"),
        F.concat(F.lit("proc_"), F.col("user_id") % 10).alias("comm"), ((F.col("seq") * 13) % 3001 - 1).alias("kernel_stack_id"),
        ((F.col("seq") * 17) % 3001 - 1).alias("user_stack_id"))
    out = run.to_table(windows.stream_profile_counts(samples, "1 hour", "1 hour"))
    return out.select("host", "window_ns", "pid", "tid", "comm", "count")


@query("stream_fan_out", "select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def stream_fan_out(spark, sf):
    """Three sinks, one of them failing: the others still get every batch."""
    path = durable_dir(spark, "fan")

    def good(df, batch_id):
        df.write.mode("append").parquet(f"{path}/a")

    def broken(df, batch_id):
        raise RuntimeError("sink is down")

    def lines(df, batch_id):
        df.select(F.to_json(F.struct("seq", "event_type")).alias("value")).write.mode("append").text(f"{path}/b")

    run.run_available(_event_stream(spark, sf, None), [broken, good, lines])
    a = spark.read.parquet(f"{path}/a").select("seq", "event_type")
    b = spark.read.schema("seq BIGINT, event_type STRING").json(f"{path}/b")
    return a.join(b, ["seq", "event_type"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("ids"))


@query("stream_counters", """select 0::bigint as running, 1::bigint as total, 1::bigint as batches, count(*) as records,
 0::bigint as errors, 0::bigint as dropped from events""")
def stream_counters(spark, sf):
    """Fleet totals from the progress counters of a bounded run over the events table."""
    q = run.run_available(_event_stream(spark, sf, None), [lambda df, i: df.agg(F.count(F.lit(1))).first()])
    return stats.stage_health(run.progress_rows(spark, q)).select("running", "total", "batches", "records", "errors", "dropped")
