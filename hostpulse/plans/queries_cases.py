"""Registered queries for the branches that ordinary test rows don't reach: uncut results, odd names, late rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import filters, pairing, profiles, sched, series
from hostpulse.plans import adapters as A
from hostpulse.plans import registry
from hostpulse.plans import sql as S
from hostpulse.plans.queries import DAY, ORACLE, SCHED_ALL, SLICE, query, r
from hostpulse.plans.queries_more import PROC_CPU, _event_stream, get, micros
from hostpulse.session import durable_dir
from hostpulse.sinks import tables, text
from hostpulse.sources import readers
from hostpulse.streaming import run

# Pipeline names that are escaped on disk, look like numbers, or are missing.
NAMES = ("1", "007", "a/b", "c:d", None)
NAMED = """case user_id % 5 when 0 then '1' when 1 then '007' when 2 then 'a/b' when 3 then 'c:d' end"""


def _named(spark, sf):
    return A.records(spark, sf).withColumn("pipeline", F.expr(NAMED.replace("user_id", "cast(labels['user'] as bigint)")))


@query("retention_names", A.duck_with("rec") + f"""
select seq, {NAMED} as pipeline from rec where timestamp_ns >= (select max(timestamp_ns) from rec) - 432000000000000""")
def retention_names(spark, sf):
    path = durable_dir(spark, "records")
    rec = _named(spark, sf)
    tables.write_records(rec, path)
    tables.prune_table(spark, path, 5 * DAY, rec.agg(F.max("timestamp_ns")).first()[0])
    return readers.read_table(spark, path).select("seq", "pipeline")


@query("retention_tables", A.duck_with("rec", "stacks", "profs") + """
, now as (select max(timestamp_ns) as newest from rec)
select 'records' as kind, seq as id from rec, now where timestamp_ns >= newest - 864000000000000
union all select 'stack_samples', seq from stacks, now where newest - (seq % 20) * 86400000000000 >= newest - 864000000000000
union all select 'profiles', start_ns from profs, now where newest - (sample_count % 20) * 86400000000000 >= newest - 864000000000000""")
def retention_tables(spark, sf):
    """One call prunes records, stack samples and profiles."""
    base = durable_dir(spark, "store")
    rec = A.records(spark, sf)
    tables.write_records(rec, f"{base}/records")
    newest = rec.agg(F.max("timestamp_ns")).first()[0]
    # samples and profiles are dealt over the last twenty days
    samples = A.stack_samples(spark, sf).withColumn("timestamp_ns", F.lit(newest) - F.col("seq") % 20 * DAY)
    tables.write_stack_samples(samples, f"{base}/stack_samples")
    profs = A.table(spark, sf, "profs").withColumnRenamed("feed", "pipeline").withColumnRenamed("start_ns", "id")
    profs = profs.withColumn("start_ns", F.lit(newest) - F.col("sample_count") % 20 * DAY)
    tables.write_profiles(profs, f"{base}/profiles")
    tables.prune_store(spark, base, 10 * DAY, newest)
    out = None
    for kind, column in (("records", "seq"), ("stack_samples", "seq"), ("profiles", "id")):
        schema = {"records": rec, "stack_samples": samples, "profiles": profs}[kind].schema
        part = spark.read.schema(schema).parquet(f"{base}/{kind}").select(F.lit(kind).alias("kind"), F.col(column).alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("record_all", A.duck_with("rec") + "select seq, timestamp_ns from rec where feed = 'feed_1'")
def record_all(spark, sf):
    """No limit: every record of a feed."""
    return readers.query_records(A.records(spark, sf), "feed_1").select("seq", "timestamp_ns")


@query("read_only_sql_all", A.duck_with("rec") + "select seq, event_type from rec")
def read_only_sql_all(spark, sf):
    S.register_views(spark, tables={"hp_records": A.table(spark, sf, "rec")})
    return S.run_sql(spark, "SELECT seq, event_type FROM hp_records")


@query("process_cpu_all", PROC_CPU.replace(" and rn <= {n}", "") + """select host, ts_us, pid, round(cpu_total_pct, 6) as cpu_total_pct from proc""")
def process_cpu_all(spark, sf):
    out = series.process_cpu(A.with_ts(A.table(spark, sf, "proc_counters")).withColumn("state", F.lit("R")))
    return out.select("host", micros(), "pid", r("cpu_total_pct"))


@query("sched_history_all", SCHED_ALL + """
select host, window_ns, cast(sum(switch_count) as bigint) as total_switches, count(*) as process_count from st group by 1, 2""")
def sched_history_all(spark, sf):
    from hostpulse.plans.queries import _stats6h
    return sched.sched_history(_stats6h(spark, sf)).select("host", "window_ns", "total_switches", "process_count")


@query("wakeup_edges_all", A.duck_with("sched") + """
select prev_comm as waker, next_comm as wakee, count(*) as count from sched where event_type = 'wakeup' group by 1, 2""")
def wakeup_edges_all(spark, sf):
    return sched.wakeup_graph(A.sched(spark, sf))[0]


@query("profile_snapshots_newest", ORACLE["profile_snapshots"].replace("rn <= 60", "rn <= 2"))
def profile_snapshots_newest(spark, sf):
    """Only the newest windows are built."""
    return profiles.profile_snapshots(A.stack_samples(spark, sf), "30 days", keep=2)


@query("jsonl_types", A.duck_with("rec") + """
select timestamp_ns, host, value, cast(user_id as varchar) as digits, case when seq % 2 = 0 then 'true' else 'no' end as word, seq % 3 = 0 as flag from rec""")
def jsonl_types(spark, sf):
    """Text that looks like a number or a boolean is text again after the way through JSON lines."""
    path = durable_dir(spark, "lines")
    rec = A.records(spark, sf).withColumn("fields_str", F.create_map(
        F.lit("digits"), get("labels", "user"), F.lit("word"), F.when(F.col("seq") % 2 == 0, "true").otherwise("no")))
    rec = rec.withColumn("fields_bool", F.create_map(F.lit("flag"), F.col("seq") % 3 == 0))
    tables.write_jsonl(rec, path, include_ts=True)
    back = readers.read_jsonl(spark, path)
    return back.select("timestamp_ns", "host", get("fields", "value").alias("value"), get("fields_str", "digits").alias("digits"),
                       get("fields_str", "word").alias("word"), get("fields_bool", "flag").alias("flag"))


@query("comm_patterns", A.duck_with("sched") + """
select seq, name as comm from (select seq, case when seq % 2 = 0 then next_comm else 'über' end as name from sched) where regexp_matches(name, '^\\p{L}+$')""")
def comm_patterns(spark, sf):
    """A Java pattern filters; one that Java cannot compile does not."""
    named = A.sched(spark, sf).select("seq", F.when(F.col("seq") % 2 == 0, F.col("next_comm")).otherwise("über").alias("comm"))
    return filters.filter_comm(filters.filter_comm(named, r"^\p{L}+$"), "(?P<x>a)", "[")


@query("long_names", A.duck_with("cpu_samples") + """
select seq, pid from cpu_samples where pid <> 0 and comm in ('proc_3', 'proc_7')""")
def long_names(spark, sf):
    """Names above fifteen characters are found by their full form."""
    samples = A.table(spark, sf, "cpu_samples").withColumn("comm", F.concat("comm", F.lit("_with_a_long_tail")))
    return filters.filter_cpu_samples(samples, comms=["proc_3_with_a_long_tail", "proc_7_with_a_long_tail"]).select("seq", "pid")


@query("one_document_per_batch", A.duck_with("rec") + "select batch_id, 1::bigint as documents, count(*) as records from rec group by 1")
def one_document_per_batch(spark, sf):
    docs = text.batch_json(A.records(spark, sf).withColumn("pipeline", F.lit("all")))
    items = F.size(F.from_json("document", "pipeline STRING, records ARRAY<STRING>")["records"])
    return docs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(items).cast("bigint").alias("records"))


@query("offcpu_gate", A.duck_with("sched").replace("from ev", "from ev") + """
, fast as (select host, seq, timestamp_ns // 1000000000 as timestamp_ns, event_type, next_pid, prev_pid from sched),
moves as (select host, seq, timestamp_ns, 0 as ord, prev_pid as pid from fast where event_type = 'switch' and prev_pid <> 0
  union all select host, seq, timestamp_ns, 1, next_pid from fast where event_type = 'switch' and next_pid <> 0),
w as (select *, lag(ord) over w as before, lag(timestamp_ns) over w as since from moves window w as (partition by host, pid order by timestamp_ns, seq, ord))
select host, pid, since as timestamp_ns, timestamp_ns - since as duration_ns from w where ord = 1 and before = 0 and timestamp_ns - since >= 100000""")
def offcpu_gate(spark, sf):
    """Times a billionth as long, so that the minimum duration drops intervals."""
    fast = A.sched(spark, sf).withColumn("timestamp_ns", C.int_div("timestamp_ns", 10**9))
    return pairing.offcpu_intervals(fast).select("host", "pid", "timestamp_ns", "duration_ns")


@query("latency_buckets", A.duck_with("sched") + """
, s as (select power(10, seq % 5) * (1 + seq % 7) as us from sched),
b(ord, lo, hi, range) as (values (0, -1e300, 10, '<10us'), (1, 10, 50, '10-50us'), (2, 50, 100, '50-100us'),
  (3, 100, 500, '100-500us'), (4, 500, 1000, '500us-1ms'), (5, 1000, 5000, '1-5ms'), (6, 5000, 1e300, '>5ms'))
select cast(ord as bigint) as ord, range, count(us) as count from b left join s on us >= lo and us < hi group by 1, 2""")
def latency_buckets(spark, sf):
    """Latencies that fall into all seven buckets."""
    us = F.pow(F.lit(10.0), F.col("seq") % 5) * (1 + F.col("seq") % 7)
    return sched.latency_histogram(A.sched(spark, sf).select(us.alias("avg_runqueue_latency_us")))


@query("runqueue_latency_minutes", A.duck_with("sched") + """
, w as (select *, lag(event_type) over w as pt, lag(timestamp_ns) over w as pn from sched where event_type <> 'migrate'
   window w as (partition by host, next_pid order by timestamp_ns, seq))
select seq, case when pt = 'wakeup' then timestamp_ns - pn else 0 end as latency_ns from w where event_type = 'switch'""")
def runqueue_latency_minutes(spark, sf):
    """The default slice: keys are cut by the minute."""
    out = pairing.runqueue_latency(A.sched(spark, sf))
    return out.where("event_type = 'switch'").select("seq", "latency_ns")


# Rows of one file of a stream's input.
FILE_ROWS = 1_000_000


def write_parts(spark, parted, path, file_rows: int = FILE_ROWS) -> int:
    """``parted`` as files that a stream reads one ``file`` number after the other; returns how many files a number has.

    Rows are dealt to the numbers once; each is then written as equally many files, so that no task takes a whole number."""
    staged, schema = durable_dir(spark, "staged"), parted.drop("file").schema
    parted.write.partitionBy("file").parquet(staged)
    counts = {r["file"]: r["count"] for r in spark.read.parquet(staged).groupBy("file").count().collect()}
    # a file without rows would not be written
    each = max(1, min(-(-max(counts.values()) // file_rows), min(counts.values()) // 100))
    for i in sorted(counts):
        part = spark.read.schema(schema).parquet(f"{staged}/file={i}")
        (part.repartition(each) if each > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return each


LATE_SQL = A.duck_with("sched") + """
, kept as (select * from sched where seq % 50 <> 7 or timestamp_ns // 1000 > (select min(timestamp_ns // 1000) from sched) + 1296000000000),
w as (select *, lag(event_type) over w as pt, lag(timestamp_ns) over w as pn from kept where event_type <> 'migrate'
   window w as (partition by host, next_pid order by timestamp_ns, seq))
select seq, case when pt = 'wakeup' then timestamp_ns - pn else 0 end as latency_ns from w where event_type = 'switch'
  and timestamp_ns // 1000 <= (select max(timestamp_ns // 1000) from sched) - 172800000000"""


@query("stream_out_of_order", LATE_SQL)
def stream_out_of_order(spark, sf):
    """Files that overlap by up to two days under a watermark of two days: the batch answer.

    Some rows of the first half of the month come with the last file, far behind the watermark: they are dropped."""
    schema = "host STRING, seq BIGINT, ts TIMESTAMP, timestamp_ns BIGINT, event_type STRING, prev_pid BIGINT, next_pid BIGINT, next_comm STRING, prev_comm STRING, cpu BIGINT"
    rows = A.sched(spark, sf).withColumn("ts", C.ns_to_ts("timestamp_ns"))
    first = rows.agg(F.min("timestamp_ns")).first()[0]
    jitter = F.pmod(F.xxhash64("seq"), F.lit(86400)) * 10**9
    late = (F.col("seq") % 50 == 7) & (F.floor(F.col("timestamp_ns") / 1000) <= first // 1000 + 15 * 86400 * 10**6)
    part = F.when(late, 9).otherwise(F.least(F.lit(8), F.floor((F.col("timestamp_ns") + jitter - first) / F.lit(4 * DAY)))).cast("int")
    path = durable_dir(spark, "parts")
    each = write_parts(spark, rows.withColumn("file", part).select(*[c.split()[0] for c in schema.split(", ")], "file"), path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(path).withWatermark("ts", "2 days")
    out = run.to_table(pairing.runqueue_latency(stream))
    return out.where("event_type = 'switch'").select("seq", "latency_ns")


@query("declared_stream", "select event_type, count(*) as n, count(distinct event_id) as ids from events where event_type <> 'click' group by 1")
def declared_stream(spark, sf):
    """A declared chain on a stream with three sinks, run twice: the second run adds nothing."""
    path = durable_dir(spark, "declared")

    def source(s):
        ev = _event_stream(s, sf, None)
        return ev.select("host", "seq", "timestamp_ns", "ts", F.lit("p").alias("pipeline"), F.create_map(F.lit("type"), F.col("event_type")).alias("labels"),
                         F.create_map(F.lit("value"), F.col("value")).alias("fields"))
    registry.register_source("declared_events", source)
    spec = {"name": "declared", "source": "declared_events", "checkpoint": f"{path}/checkpoint", "spool": f"{path}/spool",
            "processors": [{"type": "exclude_label", "options": {"key": "type", "value": "click"}}],
            "sinks": [{"type": "records_table", "options": {"path": f"{path}/records"}}, {"type": "jsonl", "options": {"path": f"{path}/lines", "include_ts": True}},
                      {"type": "console_text", "options": {"path": f"{path}/console"}}]}
    for _ in range(2):
        registry.run_available(spark, spec)
    stored = readers.read_table(spark, f"{path}/records").select("timestamp_ns", "host", get("labels", "type").alias("event_type"), "seq")
    lines = spark.read.text(f"{path}/lines").groupBy(F.get_json_object("value", "$.labels.type").alias("event_type")).agg(F.count("*").alias("n"))
    return stored.groupBy("event_type").agg(F.count_distinct("seq").alias("ids")).join(lines, "event_type").select("event_type", "n", "ids")
