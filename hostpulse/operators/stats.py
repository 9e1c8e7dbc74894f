"""Window statistics over metric records, process-wide metric roll-ups and stage health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hostpulse.functions import columns as C

DEFAULT_WINDOW = "10 seconds"
MAX_SLICES = 10_000
BROADCAST_BYTES = 64 * 1024 * 1024


def _window_ns(window) -> int:
    return C.duration_ns(window) or C.duration_ns(DEFAULT_WINDOW)


def long_fields(records: DataFrame, window, keep=("host",)) -> DataFrame:
    """One row per (record, numeric field) with window start and order-free label key."""
    return records.select(
        *keep, C.floor_to("timestamp_ns", _window_ns(window)).alias("window_ns"),
        C.labels_key("labels").alias("labels"), F.explode("fields").alias("field", "value"),
    ).where(F.col("value").isNotNull())


def window_stats(records: DataFrame, window=DEFAULT_WINDOW, percentiles=(0.5, 0.99), min_n: int = 4,
                 wide: bool = False, hot_rows: int | None = 1_000_000) -> DataFrame:
    """avg, min, max, count and exact interpolated percentiles per window, label set and field.

    Percentiles are NULL for fewer than ``min_n`` values.  Exact percentiles hold the distinct values
    of a group in one task, so groups above ``hot_rows`` values take the split path of
    ``exact_percentiles``; one pre-aggregated count decides.  ``hot_rows=None`` skips that check.
    ``wide=True`` folds the statistics of a label set back into one record.
    """
    rows = long_fields(records, window)
    keys = ["host", "window_ns", "labels", "field"]
    out = exact_percentiles(rows, keys, "value", percentiles, hot_rows, min_n)
    return stats_records(out, percentiles) if wide else out


def percentile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def _basic(value: str):
    return [F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"),
            F.count(value).alias("count")]


def exact_percentiles(rows: DataFrame, keys, value: str, percentiles, hot_rows: int | None = 1_000_000,
                      min_n: int = 1) -> DataFrame:
    """Basic statistics and exact percentiles per key, safe for keys of any size."""
    keys, ps = list(keys), list(percentiles)
    hot = None
    # a stream is aggregated in one pass; its groups are bounded by the window
    if hot_rows is not None and not rows.isStreaming:
        sizes = rows.groupBy(*keys).agg(F.count(value).alias("__n")).where(F.col("__n") > hot_rows)
        top = sizes.agg(F.count(F.lit(1)).alias("k"), F.max("__n").alias("n")).first()
        hot = (top["k"], top["n"]) if top["k"] else None

    def named(array):
        return [F.when(F.col("count") >= min_n, F.col(array)[i]).alias(percentile_name(p))
                for i, p in enumerate(ps)]

    def single(df):
        q = F.percentile(value, F.array(*[F.lit(float(p)) for p in ps])).alias("__q")
        return df.groupBy(*keys).agg(*_basic(value), q).select(*keys, "avg", "min", "max", "count", *named("__q"))

    if hot is None:
        return single(rows)
    groups, largest = hot
    slices = int(min(max(-(-largest // hot_rows), 2), MAX_SLICES))
    cuts = [i / slices for i in range(1, slices)]
    hot_keys = (rows.join(sizes.drop("__n"), _null_safe(rows, sizes, keys), "left_semi").groupBy(*keys)
                .agg(*_basic(value), F.percentile_approx(value, cuts, 10 * slices).alias("__cuts")))
    cold = single(rows.join(sizes, _null_safe(rows, sizes, keys), "left_anti"))
    small = groups * (8 * slices + 1024) <= BROADCAST_BYTES
    return cold.unionByName(_split_percentiles(rows, hot_keys, keys, value, ps, named, small))


def _null_safe(left: DataFrame, right: DataFrame, keys):
    return C.all_of([left[k].eqNullSafe(right[k]) for k in keys])


def _position(cuts: str, coarse: str, value: str, step: int):
    """How many of the sorted ``cuts`` are at or below ``value``, in two short scans."""
    block = F.size(F.filter(coarse, lambda c: c <= F.col(value)))
    fine = F.slice(cuts, (block - 1) * step + 1, F.lit(step))
    inside = F.size(F.filter(fine, lambda c: c <= F.col(value)))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _split_percentiles(rows, hot_keys, keys, value, ps, named, small: bool) -> DataFrame:
    """Percentiles of oversized groups: cut each group by value, then read only the needed ranks.

    ``small``: the counted hot keys with their cuts are known to fit a broadcast; otherwise the join is
    left to Spark, which splits skewed partitions.
    """
    step = 100
    coarse = F.transform(F.sequence(F.lit(1), F.size("__cuts"), F.lit(step)), lambda i: F.element_at("__cuts", i))
    h = hot_keys.select(*[F.col(k).alias(f"h_{k}") for k in keys], "__cuts", coarse.alias("__coarse"))
    h = F.broadcast(h) if small else h
    on = C.all_of([rows[k].eqNullSafe(F.col(f"h_{k}")) for k in keys])
    part = _position("__cuts", "__coarse", value, step)
    # copies of a value collapse before the values of a slice meet
    counts = (rows.join(h, on).select(*keys, part.alias("__part"), value)
              .groupBy(*keys, "__part", value).agg(F.count(F.lit(1)).alias("__c")))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.groupBy(*keys, "__part").agg(F.sum("__c").alias("__size"))
               .withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0))))
    ranks = hot_keys.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.posexplode(F.array(*[
        F.struct((F.lit(float(p)) * (F.col("count") - 1)).alias("idx")) for p in ps])).alias("__i", "__r"))
    ranks = ranks.withColumn("__rank", F.explode(F.array_distinct(F.array(
        F.floor("__r.idx"), F.ceil("__r.idx")))))
    same = C.all_of([offsets[k].eqNullSafe(ranks[f"r_{k}"]) for k in keys])
    wanted = (offsets.join(ranks, same & (F.col("__rank") >= F.col("__offset"))
                           & (F.col("__rank") < F.col("__offset") + F.col("__size")))
              .select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("__part").alias("w_part"), "__offset",
                      "__i", "__rank", F.col("__r.idx").alias("__idx")))
    upto = (Window.partitionBy(*keys, "__part").orderBy(value)
            .rowsBetween(Window.unboundedPreceding, 0))
    needed = counts.join(wanted.select(*[c for c in wanted.columns if c.startswith("w_")]).distinct(),
                         C.all_of([counts[k].eqNullSafe(F.col(f"w_{k}")) for k in keys])
                         & (F.col("__part") == F.col("w_part")), "left_semi")
    placed = needed.withColumn("__upto", F.sum("__c").over(upto))
    hits = placed.join(wanted, C.all_of([placed[k].eqNullSafe(wanted[f"w_{k}"]) for k in keys])
                       & (F.col("__part") == F.col("w_part"))
                       & (F.col("__rank") - F.col("__offset") < F.col("__upto"))
                       & (F.col("__rank") - F.col("__offset") >= F.col("__upto") - F.col("__c")))
    frac = F.col("__idx") - F.floor("__idx")
    weight = F.when(F.col("__rank") == F.floor("__idx"), 1.0 - frac).otherwise(frac)
    each = hits.groupBy(*keys, "__i").agg(F.sum(F.col(value) * weight).alias("__v"))
    # one small array per hot key: as many entries as percentiles
    wide = each.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(f"__p{i}") for i in range(len(ps))])
    w = wide.select(*[F.col(k).alias(f"v_{k}") for k in keys],
                    F.array(*[F.col(f"__p{i}") for i in range(len(ps))]).alias("__q"))
    out = hot_keys.join(w, C.all_of([hot_keys[k].eqNullSafe(w[f"v_{k}"]) for k in keys]))
    return out.select(*keys, "avg", "min", "max", "count", *named("__q"))


def stats_records(stats: DataFrame, percentiles=(0.5, 0.99)) -> DataFrame:
    """Fold long statistics into records with ``<field>_avg`` ... fields (one map per label set)."""
    names = ["avg", "min", "max", *[percentile_name(p) for p in percentiles], "count"]
    entries = F.array(*[F.struct(F.concat("field", F.lit(f"_{n}")).alias("key"),
                                 F.col(n).cast("double").alias("value")) for n in names])
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    # a label set has as many entries as it has distinct field names
    return (stats.groupBy("host", "window_ns", "labels")
            .agg(F.array_sort(F.flatten(F.collect_list(entries))).alias("entries"))
            .select("host", F.col("window_ns").alias("timestamp_ns"), C.ns_to_ts("window_ns").alias("ts"),
                    F.map_from_entries("labels").alias("labels"),
                    F.map_from_entries("entries").alias("fields")))


def flush(records: DataFrame, samples: DataFrame, window=DEFAULT_WINDOW, comm_of: str = "last", **kw) -> tuple[DataFrame, DataFrame]:
    """Both results of a flush: window statistics of the records and the aggregated profile."""
    from hostpulse.operators.profiles import window_profile
    return window_stats(records, window, wide=True, **kw), window_profile(samples, window, comm_of)


# --- latest values, shares, health ------------------------------------------------------------

def latest(df: DataFrame, keys, order=("timestamp_ns",)) -> DataFrame:
    """Latest row per series."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
            .select(*keys, "__last.*"))


def cpu_cumulative_share(counters: DataFrame) -> DataFrame:
    """Share of user, system, idle and iowait since boot (no difference between snapshots)."""
    states = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in states), F.lit(0))
    total = F.when(total == 0, 1).otherwise(total)
    return counters.select("host", "ts", "cpu", *[
        (100.0 * F.col(s) / total).alias(f"{s}_pct") for s in ("user", "system", "idle", "iowait")])


def stage_latest(stats: DataFrame) -> DataFrame:
    """Latest counters of each stage with queue utilization and its class."""
    last = latest(stats, ["host", "name"], ["ts"])
    util = C.ratio("size", "capacity")
    level = F.when(util > 0.8, "critical").when(util > 0.5, "warning").otherwise("ok")
    return last.withColumn("utilization", util).withColumn("level", level)


def stage_health(stats: DataFrame) -> DataFrame:
    """Fleet totals over the latest counters of every stage."""
    return stage_latest(stats).agg(
        F.count_if(F.col("running")).alias("running"), F.count(F.lit(1)).alias("total"),
        F.sum("batches").alias("batches"), F.sum("records").alias("records"), F.sum("errors").alias("errors"),
        F.sum("dropped").alias("dropped"), F.count_if(F.col("level") == "critical").alias("critical"),
        F.count_if(F.col("level") == "warning").alias("warning"))


def channel_history(stats: DataFrame, start=None, end=None) -> DataFrame:
    """Queue size, utilization %, enqueued and dropped of every stage over time."""
    out = stats.select("host", F.col("name").alias("stage"), "ts", "size",
                       (C.ratio("size", "capacity") * 100.0).alias("utilization"), "enqueued", "dropped")
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    return out


def internal_metrics(events: DataFrame) -> DataFrame:
    """Registry roll-up of (name, kind, value, timestamp_ns, seq): counters add, gauges keep the last,
    latencies give count, sum, whole average, min and max."""
    when = F.struct("timestamp_ns", "seq")
    whole = F.col("value").cast("bigint")
    # counters and gauges are grouped apart so that counters and latencies keep hash aggregation
    sums = (events.where(F.col("kind").isin("counter", "latency")).groupBy("kind", "name")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(whole).alias("sum"), F.min(whole).alias("min"),
                 F.max(whole).alias("max")))
    parts = F.when(F.col("kind") == "counter", F.array(_stat("value", F.col("sum")))).otherwise(F.array(
        _stat("count", F.col("n")), _stat("sum", F.col("sum")),
        _stat("avg", F.expr("sum div n")), _stat("min", F.col("min")), _stat("max", F.col("max"))))
    long = sums.select("kind", "name", F.inline(parts))
    gauges = (events.where(F.col("kind") == "gauge").groupBy("kind", "name")
              .agg(F.max_by("value", when).cast("double").alias("value"))
              .select("kind", "name", F.lit("value").alias("stat"), "value"))
    return long.unionByName(gauges)


def _stat(name, value):
    return F.struct(F.lit(name).alias("stat"), value.cast("double").alias("value"))


def internal_metrics_text(metrics: DataFrame, prefix: str = "hostpulse") -> DataFrame:
    """Exposition lines of the roll-up: ``(name, ord, line)``, printed in that order."""
    full = F.concat(F.lit(f"{prefix}_"), C.sanitize_metric_name("name"))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")) \
        .otherwise(F.col("value").cast("string"))
    suffix = F.when(F.col("stat") == "value", "").otherwise(F.concat(F.lit("_"), "stat"))
    order = F.array_position(F.array(*map(F.lit, ("value", "count", "sum", "avg", "min", "max"))), F.col("stat"))
    values = metrics.select(full.alias("name"), order.cast("bigint").alias("ord"),
                            F.concat(full, suffix, F.lit(" "), number).alias("line"))
    shown = F.when(F.col("kind") == "latency", "summary").otherwise(F.col("kind"))
    heads = metrics.select(full.alias("name"), F.lit(0).cast("bigint").alias("ord"),
                           F.concat(F.lit("# TYPE "), full, F.lit(" "), shown).alias("line")).distinct()
    return heads.unionByName(values)
