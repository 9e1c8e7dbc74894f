"""Named stages and declarative chains: source -> processors -> optional aggregator -> sinks.

A stage is an ordinary function.  Users register their own next to the built-in ones:

* source      ``fn(spark, **options) -> DataFrame`` (batch or stream)
* processor   ``fn(df, **options) -> DataFrame``
* aggregator  ``fn(df, **options) -> DataFrame``
* sink        ``fn(df, batch_id, **options) -> None``
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostpulse.operators import filters, pairing, profiles, sched, series, stats, symbolize
from hostpulse.sinks import tables, text
from hostpulse.sinks.tables import FanOut
from hostpulse.sources import readers
from hostpulse.session import durable_dir
from hostpulse.streaming import live, run, stages as counted, windows

KINDS = ("source", "processor", "aggregator", "sink")
_STAGES: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


class SpecError(ValueError):
    """The chain is incomplete or names an unknown stage."""


def _register(kind: str, name: str, fn: Callable | None):
    if fn is None:
        return partial(_register, kind, name)
    _STAGES[kind][name] = fn
    return fn


def register_source(name: str, fn: Callable | None = None):
    return _register("source", name, fn)


def register_processor(name: str, fn: Callable | None = None):
    return _register("processor", name, fn)


def register_aggregator(name: str, fn: Callable | None = None):
    return _register("aggregator", name, fn)


def register_sink(name: str, fn: Callable | None = None):
    return _register("sink", name, fn)


def stages(kind: str) -> list[str]:
    return sorted(_STAGES[kind])


def _resolve(kind: str, stage) -> Callable:
    stage = {"type": stage} if isinstance(stage, str) else dict(stage)
    name = stage.pop("type", None)
    if name not in _STAGES[kind]:
        raise SpecError(f"unknown {kind}: {name!r}")
    return partial(_STAGES[kind][name], **stage.get("options", {}))


class Pipeline:
    """A chain built from ``{"name", "source", "processors", "aggregator", "sinks", "checkpoint", "spool", "count", "flush"}``.

    ``count`` keeps counters of every stage (``counts``); it needs a spool folder, which is made where none is given.
    ``flush`` (``{"delay", "window"}``, for a stream source without a watermark) closes a bounded run: the newest windows come out too.
    """

    def __init__(self, spec: dict):
        self.name = spec.get("name", "chain")
        if not spec.get("source"):
            raise SpecError(f"{self.name}: a source is required")
        if not spec.get("sinks"):
            raise SpecError(f"{self.name}: at least one sink is required")
        self.counts = counted.StageCounts(self.name) if spec.get("count") else None
        self.flush = spec.get("flush")
        self.names = {k: [x if isinstance(x, str) else x["type"] for x in v] for k, v in
                      {"source": [spec["source"]], "processor": spec.get("processors", []), "aggregator": [spec["aggregator"]] if spec.get("aggregator") else [],
                       "sink": spec["sinks"]}.items()}
        self.source = _resolve("source", spec["source"])
        self.processors = [_resolve("processor", p) for p in spec.get("processors", [])]
        self.aggregator = _resolve("aggregator", spec["aggregator"]) if spec.get("aggregator") else None
        self.sinks = [_resolve("sink", s) for s in spec["sinks"]]
        self.checkpoint = spec.get("checkpoint")
        self.spool = spec.get("spool")
        self.fan_out = FanOut(self.sinks, self.spool, self.names["sink"], self.counts.took if self.counts else None)

    def _edge(self, df: DataFrame, kind: str, i: int = 0) -> DataFrame:
        return self.counts.edge(df, self.names[kind][i], kind) if self.counts else df

    def transform(self, df: DataFrame) -> DataFrame:
        for i, step in enumerate(self.processors):
            df = self._edge(df.transform(step), "processor", i)
        return self._edge(df.transform(self.aggregator), "aggregator") if self.aggregator else df

    def plan(self, spark: SparkSession) -> DataFrame:
        return self.transform(self._edge(self.source(spark), "source"))

    def run(self, spark: SparkSession, available_now: bool = False):
        """Batch source: write once to every sink.  Stream source: start a query."""
        if self.counts:
            self.counts.stages, self.counts.running = [], True
            self.fan_out.spool = self.fan_out.spool or durable_dir(spark, "spool")
        source = self._edge(self.source(spark), "source")
        if source.isStreaming:
            return self._run_stream(spark, source, available_now)
        self.fan_out(self.transform(source), None)
        if self.counts:
            self.counts.finish_batch()
            self.counts.running = False
        return self.fan_out.errors

    def _run_stream(self, spark: SparkSession, source: DataFrame, available_now: bool):
        if self.counts:
            counted.watch(spark, self.counts)
        closing = None
        if self.flush:
            self.checkpoint = self.checkpoint or durable_dir(spark, "stream")
            closing = run.Closing(spark, f"{self.checkpoint}.end", self.flush["delay"], self.flush["window"])
            source = closing.attach(source)
        df = self.transform(source)
        if closing and available_now:
            query = run.run_available(df, self.fan_out, self.checkpoint, closing, self.name)
        else:
            query = run.start(df, self.fan_out, self.checkpoint, available_now, name=self.name)
        if self.counts and available_now:
            query.awaitTermination()
            counted.settle(spark, query)
            self.counts.running = False
        return query


def start_pipeline(spark: SparkSession, spec: dict):
    return Pipeline(spec).run(spark)


def run_available(spark: SparkSession, spec: dict):
    """Bounded run: all available input, then stop."""
    result = Pipeline(spec).run(spark, available_now=True)
    if hasattr(result, "awaitTermination"):
        result.awaitTermination()
    return result


# --- built-in stages --------------------------------------------------------------------------

def _either(batch: Callable, stream: Callable) -> Callable:
    def stage(df: DataFrame, **options):
        return stream(df, **options) if df.isStreaming else batch(df, **options)
    return stage


for _name, _fn in {
    "events": readers.read_events, "counters": readers.read_counters, "jsonl": readers.read_jsonl,
}.items():
    register_source(_name, _fn)

for _name, _fn in {
    "passthrough": filters.passthrough, "exclude_label": filters.exclude_label, "allow_pids": filters.allow_pids,
    "filter_cpu_samples": filters.filter_cpu_samples, "filter_comm": filters.filter_comm,
    "filter_scope": filters.filter_scope, "decode_records": readers.decode_records,
    "runqueue_latency": pairing.runqueue_latency, "offcpu_intervals": pairing.offcpu_intervals,
    "block_io_latency": pairing.block_io_latency, "pair_allocations": pairing.pair_allocations,
    "classify_sockets": filters.classify_sockets, "cpu_utilization": series.cpu_utilization,
    "system_rates": series.system_rates, "merge_stacks": _either(profiles.merge_stacks, windows.stream_profile),
    "process_cpu": _either(series.process_cpu, live.stream_process_cpu), "ema": series.ema,
}.items():
    register_processor(_name, _fn)

def _given(df: DataFrame, table) -> DataFrame:
    """A side table of a stage: a DataFrame or the path of one."""
    return table if isinstance(table, DataFrame) else df.sparkSession.read.parquet(table)


@partial(register_processor, "attach_stacks")
def _attach_stacks(df, frames, depth=None):
    return profiles.attach_stacks(df, _given(df, frames), depth)


@partial(register_processor, "stack_symbolizer")
def _stack_symbolizer(df, kernel_symbols=None, proc_maps=None, elf_symbols=None, demangle=None):
    """Names for kernel stacks, user stacks or both, by what tables are given."""
    if kernel_symbols is not None:
        df = symbolize.symbolize_kernel(df, _given(df, kernel_symbols), demangle)
    if proc_maps is not None and elf_symbols is not None:
        df = symbolize.symbolize_user(df, _given(df, proc_maps), _given(df, elf_symbols), demangle)
    return df


for _name, _fn in {
    "window_stats": _either(stats.window_stats, windows.stream_window_stats),
    "window_profile": _either(profiles.window_profile, windows.stream_profile),
    "profile_counts": _either(profiles.profile_counts, windows.stream_profile_counts),
    "sched_stats": _either(sched.sched_stats, windows.stream_sched_stats),
}.items():
    register_aggregator(_name, _fn)


@register_sink("records_table")
def _records_table(df, batch_id, path):
    tables.write_records(df, path, batch_id)


@register_sink("samples_table")
def _samples_table(df, batch_id, path):
    tables.write_stack_samples(df, path, batch_id)


@register_sink("profiles_table")
def _profiles_table(df, batch_id, path):
    tables.write_profiles(df, path, batch_id)


@register_sink("parquet")
def _parquet(df, batch_id, path):
    if batch_id is None:
        df.write.mode("append").parquet(path)
    else:
        tables.publish(df, path, batch_id)


def _lines(lines, batch_id, path):
    """Text lines; a micro-batch is a folder of its own, so a repeated one replaces itself."""
    if batch_id is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/batch={batch_id}")


@register_sink("jsonl")
def _jsonl(df, batch_id, path, include_ts=False):
    _lines(text.export_jsonl(df, include_ts), batch_id, path)


@register_sink("otlp")
def _otlp(df, batch_id, path, max_items=None):
    batch = df if "batch_id" in df.columns else df.withColumn("batch_id", F.lit(batch_id or 0))
    _lines(text.otlp_payload(batch, max_items=max_items).select("payload"), batch_id, path)


@register_sink("console_text")
def _console_text(df, batch_id, path, mode="text"):
    """Every row of the batch as console lines, written by the tasks."""
    lines = text.format_stacks(df) if "user_stack" in df.columns else text.format_records(df, mode)
    _lines(lines.select("line"), batch_id, path)


@register_sink("recent_batches")
def _recent_batches(df, batch_id, path, n=30, key="pipeline"):
    """The last ``n`` batches as a table, replaced version by version."""
    tables.RecentBatches(path, n, key)(df, batch_id)


@register_sink("folded")
def _folded(df, batch_id, path):
    tables.write_folded(df, path, batch_id)


@register_sink("exposition")
def _exposition(df, batch_id, path, prefix="hostpulse"):
    tables.write_exposition(df, path, prefix)


@register_sink("gauge_board")
def _gauge_board(df, batch_id, path, prefix="hostpulse"):
    tables.GaugeBoard(path, prefix)(df, batch_id)


@register_sink("console")
def _console(df, batch_id):
    """Prints every row of the batch, a partition at a time."""
    lines = text.format_stacks(df) if "user_stack" in df.columns else text.format_records(df)
    for row in lines.select("line").toLocalIterator():
        print(row["line"])
