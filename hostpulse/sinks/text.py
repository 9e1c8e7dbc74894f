"""Export formats as DataFrames of text lines or documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostpulse.functions import columns as C
from hostpulse.operators.ordered import rank_in_order

FIELD_MAPS = ("fields", "fields_str", "fields_bool")
# Time that rows of a slice share when the rows of a batch are ranked.
PART_SLICE_NS = 60 * 10**9


def _maps(df: DataFrame) -> list[str]:
    return [m for m in FIELD_MAPS if m in df.columns]


def gauge_fields(records: DataFrame, *keep) -> DataFrame:
    """One row per (record, field) with its gauge value: numbers, booleans as 1/0, text and null as 0.

    ``fields`` may hold numbers, next to ``fields_str`` and ``fields_bool``, or values of any kind (variants)."""
    loose = "variant" in records.schema["fields"].dataType.simpleString() if "fields" in records.columns else False
    value_of = {"fields": C.to_gauge if loose else lambda v: F.coalesce(v, F.lit(0.0)), "fields_str": lambda v: F.lit(0.0),
                "fields_bool": lambda v: F.coalesce(v.cast("int").cast("double"), F.lit(0.0))}

    def pairs(m):
        return F.transform(F.map_entries(m), lambda e: F.struct(
            e["key"].alias("field"), value_of[m](e["value"]).alias("value")))

    none = F.array().cast("array<struct<field:string,value:double>>")
    entries = [F.coalesce(pairs(m), none) for m in _maps(records)]
    return records.select(*keep, F.inline(F.concat(*entries)))


def any_fields(records: DataFrame) -> Column:
    """All field maps as one ``map<string,variant>``."""
    parts = [F.transform_values(m, lambda k, v: v.cast("variant")) for m in _maps(records)]
    empty = F.create_map().cast("map<string,variant>")
    return F.map_concat(*[F.coalesce(p, empty) for p in parts])


def record_json(records: DataFrame, include_ts: bool = False) -> Column:
    """``{"fields":{...},"labels":{...}}`` (plus time and host when asked for)."""
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    extra = [F.col(c) for c in ("host", "timestamp_ns") if include_ts and c in records.columns]
    return F.to_json(F.struct(any_fields(records).alias("fields"), labels.alias("labels"), *extra))


def export_jsonl(records: DataFrame, include_ts: bool = False) -> DataFrame:
    """One JSON line per record."""
    return records.select(record_json(records, include_ts).alias("value"))


# --- Prometheus -------------------------------------------------------------------------------

def last_gauges(records: DataFrame, prefix: str = "hostpulse") -> DataFrame:
    """Last value of each (metric, label set): ``(metric, labels, value, at)``."""
    tie = F.col("seq") if "seq" in records.columns else F.lit(0).cast("bigint")
    long = gauge_fields(records, C.labels_key("labels").alias("labels"), "timestamp_ns", tie.alias("seq"))
    metric = C.sanitize_metric_name(F.concat(F.lit(f"{prefix}_"), "field"))
    return (long.select(metric.alias("metric"), "labels", "value", F.struct("timestamp_ns", "seq", "field").alias("at"))
            .groupBy("metric", "labels").agg(F.max_by(F.struct("value", "at"), "at").alias("l"))
            .select("metric", "labels", "l.value", "l.at"))


def exposition_lines(gauges: DataFrame) -> DataFrame:
    """HELP and TYPE once per metric, then one line per series: ``(metric, ord, labels_text, line)``."""
    pairs = F.transform("labels", lambda e: F.concat(e["key"], F.lit('="'), C.escape_label(e["value"]), F.lit('"')))
    text = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    values = gauges.withColumn("labels_text", text)
    samples = values.select("metric", F.lit(2).alias("ord"), "labels_text",
                            F.concat("metric", "labels_text", F.lit(" "), F.col("value").cast("string")).alias("line"))
    # counting the values keeps the plan of the gauges whole, so both branches share its shuffle
    names = gauges.groupBy("metric").agg(F.count("value").alias("series"))
    heads = names.select("metric", F.inline(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("").alias("labels_text"),
                 F.concat(F.lit("# HELP "), "metric", F.lit(" gauge of "), "metric").alias("line")),
        F.struct(F.lit(1).alias("ord"), F.lit("").alias("labels_text"),
                 F.concat(F.lit("# TYPE "), "metric", F.lit(" gauge")).alias("line")))))
    return heads.unionByName(samples)


def prometheus_exposition(records: DataFrame, prefix: str = "hostpulse") -> DataFrame:
    """Gauge exposition: ``(metric, ord, labels_text, line)``; order by the first three to print.

    The last value of each (metric, label set) wins.
    """
    return exposition_lines(last_gauges(records, prefix))


def numbered_lines(exposition: DataFrame) -> DataFrame:
    """``(line_no, line)``: line numbers grow in print order (distributed sort, gaps between tasks)."""
    ordered = exposition.orderBy("metric", "ord", "labels_text")
    return ordered.select(F.monotonically_increasing_id().alias("line_no"), "line")


# --- documents per batch ----------------------------------------------------------------------

def document_parts(df: DataFrame, keys, order, max_items: int | None = None) -> DataFrame:
    """Add ``part``: 0, or with ``max_items`` consecutive stretches of ``order`` of so many rows each.

    Without ``max_items`` a batch is one document, which a task must then hold; bound batches by the trigger.  With it
    rows are ranked slice of time by slice, so no task holds a batch, and a part is what a task holds.
    """
    if max_items is None:
        return df.withColumn("part", F.lit(0).cast("bigint"))
    kind = F.col("kind") if "kind" in order else F.lit(0)
    by_time = F.struct(kind.alias("kind"), C.int_div("timestamp_ns", PART_SLICE_NS).alias("at"))
    return rank_in_order(df, keys, order, by_time, "__rank").withColumn("part", C.int_div("__rank", max_items)).drop("__rank")


def _joined(piece: Column, order) -> Column:
    """Comma list of ``piece`` in ``order`` (one document)."""
    items = F.array_sort(F.collect_list(F.struct(*order, piece.alias("__text"))))
    return F.array_join(F.transform(items, lambda i: i["__text"]), ",")


def otlp_payload(records: DataFrame, keys=("host", "batch_id"), max_items: int | None = None) -> DataFrame:
    """Gauge payloads, one data point per (record, field): ``(keys, part, payload)``."""
    attributes = F.transform(F.map_entries("labels"), lambda e: F.struct(
        e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    attributes = F.when(F.size(F.coalesce("labels", F.create_map().cast("map<string,string>"))) > 0, attributes)
    rows = gauge_fields(records, *keys, "timestamp_ns", "seq", attributes.alias("attributes"))
    point = F.struct(F.col("timestamp_ns").alias("timeUnixNano"), F.col("value").alias("asDouble"), "attributes")
    metric = F.to_json(F.struct(F.col("field").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge")))
    parts = document_parts(rows.withColumn("__metric", metric), keys, ["timestamp_ns", "seq", "field"], max_items)
    payload = F.concat(F.lit('{"resourceMetrics":[{"scopeMetrics":[{"metrics":['),
                       _joined(F.col("__metric"), ["timestamp_ns", "seq", "field"]), F.lit("]}]}]}"))
    return parts.groupBy(*keys, "part").agg(payload.alias("payload"))


def _frames_json(stack: str) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.transform(stack, lambda f: F.struct(f["address"].alias("address"),
                                                 blank(f["function_name"]).alias("function_name"),
                                                 blank(f["module_name"]).alias("module_name")))


def sample_json(samples: DataFrame) -> Column:
    kind = F.when(F.col("sample_type") == "offcpu", 1).otherwise(0)
    return F.to_json(F.struct("pid", "tid", "cpu", "count", "comm", kind.alias("type"),
                              F.when(F.col("duration_ns") > 0, F.col("duration_ns")).alias("duration_ns"),
                              _frames_json("kernel_stack").alias("kernel_stack"),
                              _frames_json("user_stack").alias("user_stack")))


def batch_json(records: DataFrame, samples: DataFrame | None = None, keys=("pipeline", "batch_id"),
               max_items: int | None = None) -> DataFrame:
    """One JSON document per batch: ``{"pipeline","records":[..],"stack_samples":[..]}``.

    The sample part is left out where a batch has none.  With ``max_items`` a batch gives several documents.
    """
    keys = list(keys)

    def pieces(df, text, kind):
        return df.select(*keys, "timestamp_ns", "seq", F.lit(kind).alias("kind"), text.alias("__text"))

    rows = pieces(records, record_json(records), 0)
    if samples is not None:
        rows = rows.unionByName(pieces(samples, sample_json(samples), 1))
    rows = document_parts(rows, keys, ["kind", "timestamp_ns", "seq"], max_items)
    items = F.array_sort(F.collect_list(F.struct("kind", "timestamp_ns", "seq", "__text")))
    grouped = rows.groupBy(*keys, "part").agg(items.alias("items"))

    def listed(kind):
        chosen = F.filter("items", lambda i: i["kind"] == kind)
        return F.concat(F.lit("["), F.array_join(F.transform(chosen, lambda i: i["__text"]), ","), F.lit("]"))

    with_samples = F.when(F.exists("items", lambda i: i["kind"] == 1),
                          F.concat(F.lit(',"stack_samples":'), listed(1))).otherwise("")
    quoted = F.to_json(F.array(F.col(keys[0]).cast("string")))
    name = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    document = F.concat(F.lit('{"pipeline":'), name, F.lit(',"records":'), listed(0), with_samples, F.lit("}"))
    return grouped.select(*keys, "part", document.alias("document"))


# --- console text -----------------------------------------------------------------------------

def format_records(records: DataFrame, mode: str = "text") -> DataFrame:
    """``[ns] {label=value} field=value``; doubles with three decimals, nulls left out.  ``json``: JSON lines."""
    if mode == "json":
        return records.select(record_json(records).alias("line"))
    pieces = [F.transform(F.map_entries("labels"), lambda e: F.concat(
        F.lit(" {"), e["key"], F.lit("="), e["value"], F.lit("}")))]
    show = {"fields": lambda v: F.format_string("%.3f", v), "fields_str": lambda v: v,
            "fields_bool": lambda v: v.cast("string")}

    def shown(m):
        entries = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())
        return F.transform(entries, lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), show[m](e["value"])))

    pieces += [shown(m) for m in _maps(records)]
    empty = F.array().cast("array<string>")
    text = F.array_join(F.concat(*[F.coalesce(p, empty) for p in pieces]), "")
    return records.select(F.concat(F.lit("["), F.col("timestamp_ns").cast("string"), F.lit("]"), text).alias("line"))


def format_stacks(samples: DataFrame) -> DataFrame:
    """Header line and one line per user frame, as one text per sample."""
    head = F.format_string("[stack] pid=%d tid=%d comm=%s count=%d", "pid", "tid", F.coalesce("comm", F.lit("")), "count")

    def frame(f):
        place = F.when(F.coalesce(f["file_name"], F.lit("")) != "", F.concat(
            F.lit(" ("), f["file_name"], F.lit(":"), F.coalesce(f["line_number"], F.lit(0)).cast("string"), F.lit(")"))
        ).otherwise("")
        return F.concat(F.lit("\n  "), F.coalesce(f["function_name"], F.lit("")), F.lit("+0x"),
                        C.address_hex(f["address"]), place)

    frames = F.array_join(F.transform("user_stack", frame), "")
    return samples.select(F.concat(head, F.coalesce(frames, F.lit(""))).alias("line"))
