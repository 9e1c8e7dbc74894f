"""Counter rates, smoothing, per-process CPU, down-sampling and nearest-sample joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hostpulse.functions import columns as C
from hostpulse.operators.ordered import asof_both, rank_in_order, top_per_key, with_neighbor
from hostpulse.schemas import CPU_STATES

# Counter series are cut every six hours: 1,460 border rows per series and year.
SLICE_NS = 6 * 3600 * 10**9
TOTAL_CPU = "cpu"


HOUR_NS = 3600 * 10**9


def time_slice(ts: str, slice_ns: int | None) -> Column | None:
    return None if slice_ns is None else F.floor(F.unix_micros(ts) / F.lit(slice_ns // 1000))


def cpu_utilization(counters: DataFrame, per_core: bool = True, slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Percent of each state between consecutive snapshots of a cpu; the first snapshot emits nothing.

    A counter that runs backwards gives NULL and sets ``counter_reset``.
    """
    if not per_core:
        counters = counters.where(F.col("cpu") == TOTAL_CPU)
    rows = with_neighbor(counters, ["host", "cpu"], ["ts"], list(CPU_STATES), "__p", time_slice("ts", slice_ns))
    delta = {s: F.col(s) - F.col(f"__p.{s}") for s in CPU_STATES}
    rows = rows.where(F.col("__p").isNotNull()).select(
        "host", "cpu", "ts", *[d.alias(f"__d_{s}") for s, d in delta.items()])
    d = {s: F.col(f"__d_{s}") for s in CPU_STATES}
    total = sum(d.values(), F.lit(0))
    rows = rows.withColumn("__total", total).withColumn(
        "counter_reset", C.any_of([c < 0 for c in d.values()]))
    base = F.when(F.col("__total") == 0, 1).otherwise(F.col("__total"))

    def pct(x):
        return F.when((x >= 0) & (F.col("__total") >= 0), 100.0 * x / base)

    busy = F.when(~F.col("counter_reset"), pct(F.col("__total") - d["idle"] - d["iowait"]))
    kind = F.when(F.col("cpu") == TOTAL_CPU, "cpu_total").otherwise("cpu_core")
    return rows.select("host", "cpu", kind.alias("type"), "ts",
                       *[pct(d[s]).alias(f"{s}_pct") for s in CPU_STATES],
                       busy.alias("busy_pct"), "counter_reset")


def system_rates(counters: DataFrame, interval_sec: float | None = None,
                 slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Context switches and interrupts per second, over elapsed or the configured time."""
    rows = with_neighbor(counters, ["host"], ["ts"], ["ts", "ctxt", "intr"], "__p", time_slice("ts", slice_ns))
    rows = rows.where(F.col("__p").isNotNull())
    elapsed = F.lit(interval_sec if interval_sec > 0 else 1.0) if interval_sec is not None else \
        (F.unix_micros("ts") - F.unix_micros("__p.ts")) / 1e6

    def rate(c):
        d = F.col(c) - F.col(f"__p.{c}")
        return F.when((d >= 0) & (elapsed > 0), d / elapsed)

    return rows.select("host", "ts", rate("ctxt").alias("context_switches_per_sec"),
                       rate("intr").alias("interrupts_per_sec"))


# --- exponential moving average ---------------------------------------------------------------

def ema(df: DataFrame, keys, order, cols, alpha: float, slice_by: Column | None = None) -> DataFrame:
    """Add ``<col>_ema``: seeded by the first value, then ``alpha*x + (1-alpha)*previous``.

    The average of a slice depends on its past only through the value it starts from, so slices are
    summarised (decay and end value), the start values are chained over these summaries, and each
    slice is then averaged on its own.  NULL keeps the previous average.  ``slice_by`` must be monotone in
    ``order``; without it times are cut into hours and numbers (nanoseconds by name, else counts) into stretches.
    """
    if alpha <= 0:
        return df
    keys, order, cols = list(keys), list(order), list(cols)
    if df.isStreaming:
        from hostpulse.streaming.stateful import stream_ema
        return stream_ema(df, keys, order, cols, alpha)
    rows = df.withColumn("__slice", slice_by if slice_by is not None else _default_slice(df, order[0]))
    group = [*keys, "__slice"]
    out_schema = df.select("*", *[F.lit(0.0).alias(f"{c}_ema") for c in cols]).schema

    slim = rows.select(*dict.fromkeys([*group, *order, *cols]))
    sum_schema = slim.select(*group).schema
    for c in cols:
        sum_schema = sum_schema.add(f"n_{c}", T.LongType()).add(f"zero_{c}", T.DoubleType()).add(f"own_{c}", T.DoubleType())

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        one = {g: [pdf[g].iloc[0]] for g in group}
        for c in cols:
            x = pdf[c].dropna().astype("float64")
            one[f"n_{c}"] = [len(x)]
            one[f"own_{c}"] = [_ewm(x, alpha).iloc[-1] if len(x) else None]
            one[f"zero_{c}"] = [_ewm(pd.concat([pd.Series([0.0]), x]), alpha).iloc[-1]]
        return pd.DataFrame(one)

    summaries = slim.groupBy(*group).applyInPandas(summarise, sum_schema)
    start_schema = slim.select(*group).schema
    for c in cols:
        start_schema = start_schema.add(f"__start_{c}", T.DoubleType())

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per slice of the key
        pdf = pdf.sort_values("__slice")
        out = pdf[group].copy()
        for c in cols:
            state, starts = None, []
            for n, zero, own in zip(pdf[f"n_{c}"], pdf[f"zero_{c}"], pdf[f"own_{c}"]):
                starts.append(state)
                if n:
                    state = own if state is None else zero + (1 - alpha) ** n * state
            out[f"__start_{c}"] = pd.Series(starts, index=out.index, dtype="float64")
        return out

    starts = summaries.groupBy(*keys).applyInPandas(chain, start_schema)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=out_schema.names)
        seeds = {c: right[f"__start_{c}"].iloc[0] for c in cols}
        return _ema_frame(left.sort_values(order), cols, alpha, seeds)[out_schema.names]

    return rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(finish, out_schema)


def _default_slice(df: DataFrame, order: str) -> Column:
    """Hours of a time, stretches of an hour in nanoseconds or of 100,000 of another number."""
    if df.schema[order].dataType.typeName().startswith("timestamp"):
        return time_slice(order, HOUR_NS)
    width = HOUR_NS if order.endswith("_ns") else 100_000
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def _ewm(x: pd.Series, alpha: float) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()


def _ema_frame(pdf: pd.DataFrame, cols, alpha: float, seeds: dict) -> pd.DataFrame:
    pdf = pdf.copy()
    for c in cols:
        x = pdf[c].astype("float64")
        seed = seeds.get(c)
        if seed is None or pd.isna(seed):
            pdf[f"{c}_ema"] = _ewm(x, alpha)
        else:
            pdf[f"{c}_ema"] = _ewm(pd.concat([pd.Series([seed]), x]), alpha).iloc[1:].to_numpy()
    return pdf


# --- processes and threads --------------------------------------------------------------------

def snapshots(counters: DataFrame, slice_ns: int | None = SLICE_NS) -> DataFrame:
    """One row per host and snapshot time with the previous snapshot and the jiffies in between."""
    each = counters.groupBy("host", "ts").agg(F.max("total_jiffies").alias("__total"))
    each = with_neighbor(each, ["host"], ["ts"], ["ts", "__total"], "__before", time_slice("ts", slice_ns))
    delta = F.col("__total") - F.col("__before.__total")
    return each.select("host", "ts", F.col("__before.ts").alias("prev_ts"),
                       F.when(delta == 0, 1).otherwise(delta).alias("delta_total"))


def with_cpu_pct(rows: DataFrame) -> DataFrame:
    """Add user, system and total percent from struct ``__p`` (previous counters) and ``delta_total``."""
    scale = F.lit(100.0)

    def pct(c):
        d = F.greatest(F.col(c) - F.col(f"__p.{c}"), F.lit(0))
        return F.coalesce(scale * d / F.col("delta_total") * F.col("num_cpus"), F.lit(0.0))

    rows = rows.withColumn("cpu_user_pct", pct("utime")).withColumn("cpu_sys_pct", pct("stime"))
    return rows.withColumn("cpu_total_pct", F.col("cpu_user_pct") + F.col("cpu_sys_pct"))


def process_cpu(counters: DataFrame, top_n: int | None = None, key_starttime: bool = False,
                slice_ns: int | None = SLICE_NS) -> DataFrame:
    """CPU percent of the processes of each snapshot, of all or of the ``top_n`` busiest.

    The predecessor is the same pid in the previous snapshot of the host.  Rows without one rank
    as 0 and are dropped after the cut.  ``key_starttime`` keeps reused pids apart.
    """
    key = ["host", "pid"] + (["starttime"] if key_starttime else [])
    rows = with_neighbor(counters, key, ["ts"], ["ts", "utime", "stime"], "__p", time_slice("ts", slice_ns))
    rows = rows.join(snapshots(counters, slice_ns), ["host", "ts"])
    has_prev = F.coalesce(F.col("__p.ts") == F.col("prev_ts"), F.lit(False))
    rows = rows.withColumn("__has_prev", has_prev).withColumn("__p", F.when(F.col("__has_prev"), F.col("__p")))
    ranked = with_cpu_pct(rows)
    if top_n is not None:
        ranked = top_n_per(ranked, ["host", "ts"], [F.col("cpu_total_pct").desc(), F.col("pid")], top_n)
    return (ranked.where(F.col("__has_prev"))
            .withColumn("rss_kb", F.col("rss_pages") * 4).withColumn("vsize_kb", C.int_div("vsize", 1024))
            .drop("__p", "__has_prev", "prev_ts", "delta_total"))


def top_n_per(df: DataFrame, partition, order, n: int) -> DataFrame:
    """First ``n`` rows of each partition; ``order`` ends with a unique column."""
    return top_per_key(df, partition, order, n)


def thread_cpu(threads: DataFrame, procs: DataFrame, pids=(), threshold: float = 3.0,
               slice_ns: int | None = SLICE_NS) -> DataFrame:
    """Threads of processes that are listed or use at least ``threshold`` percent in that snapshot.

    ``procs`` is the result of ``process_cpu``.
    """
    chosen = F.col("cpu_total_pct") >= threshold
    if pids:
        chosen = chosen | F.col("pid").isin(*[int(p) for p in pids])
    rows = with_neighbor(threads, ["host", "pid", "tid"], ["ts"], ["utime", "stime"], "__p",
                         time_slice("ts", slice_ns))
    rows = rows.where(F.col("__p").isNotNull()).join(
        procs.where(chosen).select("host", "ts", "pid"), ["host", "ts", "pid"], "left_semi")
    rows = rows.join(snapshots(threads, slice_ns), ["host", "ts"])
    return (with_cpu_pct(rows).select("host", "ts", "pid", "tid", "comm", "parent_comm", "cpu_user_pct",
                                       "cpu_sys_pct", "cpu_total_pct", "state"))


def process_tree(procs: DataFrame, threads: DataFrame, keys=("host", "ts", "pid")) -> DataFrame:
    """Processes with an array of their threads (bounded by the kernel's thread limit per process)."""
    keys = list(keys)
    rest = [c for c in ("tid", "comm", "cpu_user_pct", "cpu_sys_pct", "cpu_total_pct", "state")
            if c in threads.columns]
    grouped = threads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("threads"))
    out = procs.join(grouped, keys, "left")
    empty = F.array().cast(grouped.schema["threads"].dataType)
    return out.withColumn("threads", F.coalesce("threads", empty))


# --- grids and history ------------------------------------------------------------------------

def downsample_times(df: DataFrame, max_cols: int = 60, by=("host",), ts: str = "ts",
                     slice_ns: int = SLICE_NS) -> DataFrame:
    """Every ceil(n/max_cols)-th distinct time, counted from the first."""
    by = list(by)
    times = df.select(*by, ts).distinct()
    ranked = rank_in_order(times, by, [ts], time_slice(ts, slice_ns), "__pos")
    sizes = times.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(max_cols)))
    if by:
        joined = ranked.join(sizes, by)
    else:
        joined = ranked.withColumn("__n", sizes.select("__n").scalar())
    return joined.where(F.col("__pos") % step == 0).select(*by, ts)


def nearest_join(grid: DataFrame, series: DataFrame, by=("host", "cpu"), ts: str = "ts", carry=("busy_pct",),
                 out: str = "nearest", slice_ns: int = SLICE_NS) -> DataFrame:
    """For each grid time the series row with the smallest distance; the earlier one wins ties."""
    width = slice_ns // 1000
    micros = series.withColumn("__t", F.unix_micros(ts)).select(*by, "__t", *carry)
    left = grid.withColumn("__g", F.unix_micros(ts))
    both = asof_both(left, micros, by, "__g", "__t", ["__t", *carry], "__b", "__f", width)
    back, fwd = F.col("__g") - F.col("__b.__t"), F.col("__f.__t") - F.col("__g")
    near = F.when(F.col("__f").isNull() | (back <= fwd), F.col("__b")).otherwise(F.col("__f"))
    return both.withColumn(out, near).drop("__g", "__b", "__f").select(
        *grid.columns, *[F.col(f"{out}.{c}").alias(c) for c in carry])


def core_heatmap(util: DataFrame, start=None, end=None, max_cols: int = 60, slice_ns: int = SLICE_NS) -> DataFrame:
    """Busy percent of every core at every kept time (nearest sample of that core)."""
    cores = util.where(F.col("cpu") != TOTAL_CPU)
    if start is not None:
        cores = cores.where(F.col("ts") >= F.lit(start))
    if end is not None:
        cores = cores.where(F.col("ts") <= F.lit(end))
    times = downsample_times(cores, max_cols, slice_ns=slice_ns)
    # at most max_cols times for each core of a host; one as-of pass finds the samples around each
    grid = times.join(cores.select("host", "cpu").distinct(), "host")
    known = cores.select("host", "cpu", "ts", F.coalesce("busy_pct", F.lit(0.0)).alias("busy_pct"))
    cells = nearest_join(grid, known, ("host", "cpu"), "ts", ("busy_pct",), slice_ns=slice_ns)
    return cells.select("host", "cpu", "busy_pct", "ts", C.core_sort_key("cpu").alias("core"))


def utilization_history(util: DataFrame, keep: int = 900) -> DataFrame:
    """Last points of the total cpu for the area chart; irq includes soft interrupts."""
    total = util.where(F.col("cpu") == TOTAL_CPU)
    points = total.select("host", "ts", *[F.coalesce(f"{s}_pct", F.lit(0.0)).alias(s)
                                          for s in ("user", "system", "iowait")],
                          (F.coalesce("irq_pct", F.lit(0.0)) + F.coalesce("softirq_pct", F.lit(0.0))).alias("irq"),
                          F.coalesce("steal_pct", F.lit(0.0)).alias("steal"),
                          F.coalesce("idle_pct", F.lit(0.0)).alias("idle"))
    return top_per_key(points, ["host"], [F.col("ts").desc()], keep)


def retain_series(df: DataFrame, keys, max_points: int = 1800, max_age_ms: int | None = 30 * 60 * 1000,
                  now=None, ts: str = "ts") -> DataFrame:
    """Newest ``max_points`` of each series that are no older than ``max_age_ms`` before ``now``."""
    if max_age_ms is not None and now is not None:
        oldest = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - F.lit(max_age_ms * 1000))
        df = df.where(F.col(ts) >= oldest)
    rest = [F.col(c) for c, t in df.dtypes if c != ts and not t.startswith(("map", "variant"))]
    return top_per_key(df, keys, [F.col(ts).desc(), *rest], max_points)
