"""Canonical table schemas (DDL strings, usable by batch and stream readers)."""

FRAME = (
    "STRUCT<address: DECIMAL(20,0), function_name: STRING, file_name: STRING, "
    "line_number: BIGINT, module_name: STRING>"
)

RECORDS = (
    "host STRING, pipeline STRING, timestamp_ns BIGINT, ts TIMESTAMP, labels MAP<STRING,STRING>, "
    "fields MAP<STRING,DOUBLE>, fields_str MAP<STRING,STRING>, fields_bool MAP<STRING,BOOLEAN>"
)
STACK_SAMPLES = (
    "host STRING, pipeline STRING, timestamp_ns BIGINT, ts TIMESTAMP, pid BIGINT, tid BIGINT, "
    "comm STRING, cpu BIGINT, sample_type STRING, count BIGINT, duration_ns BIGINT, "
    f"kernel_stack_id INT, user_stack_id INT, kernel_stack ARRAY<{FRAME}>, user_stack ARRAY<{FRAME}>"
)
PROFILES = (
    "host STRING, pipeline STRING, profile_type STRING, start_ns BIGINT, end_ns BIGINT, "
    "sample_count BIGINT, labels MAP<STRING,STRING>, data BINARY"
)

# Raw event tables, by kind.
EVENTS = {
    "sched": "host STRING, seq BIGINT, timestamp_ns BIGINT, event_type STRING, prev_pid BIGINT, "
             "next_pid BIGINT, prev_comm STRING, next_comm STRING, cpu BIGINT, "
             "kernel_stack_id INT, user_stack_id INT",
    "block": "host STRING, seq BIGINT, timestamp_ns BIGINT, phase STRING, dev BIGINT, sector BIGINT, "
             "nr_sector BIGINT, pid BIGINT, tid BIGINT, comm STRING, rwbs STRING",
    "alloc": "host STRING, seq BIGINT, timestamp_ns BIGINT, pid BIGINT, tid BIGINT, comm STRING, "
             "op STRING, addr DECIMAL(20,0), size BIGINT",
    "sock": "host STRING, seq BIGINT, timestamp_ns BIGINT, pid BIGINT, tid BIGINT, comm STRING, "
            "family INT, oldstate INT, newstate INT, saddr BIGINT, daddr BIGINT, sport INT, dport INT, "
            "protocol INT",
    "cpu": "host STRING, timestamp_ns BIGINT, pid BIGINT, tid BIGINT, cpu BIGINT, comm STRING, "
           "kernel_stack_id INT, user_stack_id INT",
    "offcpu": "host STRING, timestamp_ns BIGINT, pid BIGINT, tid BIGINT, cpu BIGINT, comm STRING, "
              "duration_ns BIGINT, kernel_stack_id INT, user_stack_id INT",
    "frames": "host STRING, stack_id INT, addresses ARRAY<DECIMAL(20,0)>",
}

# Counter snapshot tables, by kind.
CPU_STATES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
COUNTERS = {
    "cpu": "host STRING, ts TIMESTAMP, cpu STRING, " + ", ".join(f"{s} BIGINT" for s in CPU_STATES),
    "system": "host STRING, ts TIMESTAMP, ctxt BIGINT, intr BIGINT, procs_running BIGINT, "
              "procs_blocked BIGINT",
    "loadavg": "host STRING, ts TIMESTAMP, load1 DOUBLE, load5 DOUBLE, load15 DOUBLE, "
               "running BIGINT, total BIGINT",
    "cpu_mhz": "host STRING, ts TIMESTAMP, cpu STRING, mhz DOUBLE",
    "meminfo": "host STRING, ts TIMESTAMP, name STRING, kb BIGINT",
    "process": "host STRING, ts TIMESTAMP, pid BIGINT, tid BIGINT, comm STRING, parent_comm STRING, "
               "state STRING, utime BIGINT, stime BIGINT, starttime BIGINT, num_threads BIGINT, "
               "vsize BIGINT, rss_pages BIGINT, total_jiffies BIGINT, num_cpus BIGINT",
    "stages": "host STRING, ts TIMESTAMP, name STRING, running BOOLEAN, stub BOOLEAN, batches BIGINT, "
              "records BIGINT, errors BIGINT, capacity BIGINT, size BIGINT, enqueued BIGINT, "
              "dequeued BIGINT, dropped BIGINT, flush_injected BIGINT, backpressure_events BIGINT, "
              "backpressured BOOLEAN",
}

PROC_MAPS = (
    "host STRING, pid BIGINT, start DECIMAL(20,0), end DECIMAL(20,0), offset DECIMAL(20,0), "
    "path STRING, ord BIGINT"
)
ELF_SYMBOLS = "path STRING, value DECIMAL(20,0), size DECIMAL(20,0), name STRING, type STRING"
KERNEL_SYMBOLS = "host STRING, address DECIMAL(20,0), type STRING, name STRING"
