"""Readers for telemetry tables and queries over stored records and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hostpulse import schemas
from hostpulse.functions import columns as C


def _read(spark: SparkSession, path: str, schema: str, streaming: bool, fmt: str, options: dict) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(schema).options(**options)
    return reader.format(fmt).load(path)


def read_events(spark: SparkSession, path: str, kind: str, streaming: bool = False, fmt: str = "parquet",
                **options) -> DataFrame:
    """Raw event table of one kind (``schemas.EVENTS``)."""
    return _read(spark, path, schemas.EVENTS[kind], streaming, fmt, options)


def read_counters(spark: SparkSession, path: str, kind: str, streaming: bool = False, fmt: str = "parquet",
                  **options) -> DataFrame:
    """Counter snapshots of one kind (``schemas.COUNTERS``)."""
    return _read(spark, path, schemas.COUNTERS[kind], streaming, fmt, options)


PARTITION_TYPES = {"pipeline": T.StringType(), "date": T.DateType()}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``sinks.tables``; partition values keep their text (pipeline ``007`` is not 7)."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, PARTITION_TYPES[f.name])
                           if f.name in PARTITION_TYPES else f for f in found])
    return spark.read.schema(schema).parquet(path)


def _time_bounds(df: DataFrame, pipeline: str, start_ns: int, end_ns: int) -> DataFrame:
    """Pipeline and inclusive time bounds (0 = open); dates are bounded too, for partition pruning."""
    df = df.where(F.col("pipeline") == pipeline)
    dated = "date" in df.columns
    if start_ns > 0:
        df = df.where(F.col("timestamp_ns") >= start_ns)
        df = df.where(F.col("date") >= C.ns_to_ts(F.lit(start_ns)).cast("date")) if dated else df
    if end_ns > 0:
        df = df.where(F.col("timestamp_ns") <= end_ns)
        df = df.where(F.col("date") <= C.ns_to_ts(F.lit(end_ns)).cast("date")) if dated else df
    return df


def _newest(df: DataFrame, limit: int | None, descending: bool) -> DataFrame:
    ties = [c for c in ("seq", "host", "pid", "tid") if c in df.columns]
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in ("timestamp_ns", *ties)]
    df = df.orderBy(*cols)
    return df if limit is None else df.limit(limit)


def query_records(df: DataFrame, pipeline: str, start_ns: int = 0, end_ns: int = 0, limit: int | None = None,
                  descending: bool = True) -> DataFrame:
    return _newest(_time_bounds(df, pipeline, start_ns, end_ns), limit, descending)


def query_stack_samples(df: DataFrame, pipeline: str, start_ns: int = 0, end_ns: int = 0,
                        limit: int | None = None, descending: bool = True) -> DataFrame:
    return _newest(_time_bounds(df, pipeline, start_ns, end_ns), limit, descending)


def list_profiles(df: DataFrame, pipeline: str, start_ns: int = 0, end_ns: int = 0) -> DataFrame:
    """Profiles overlapping the range, newest first; the payload is not read."""
    df = df.where(F.col("pipeline") == pipeline)
    if start_ns > 0:
        df = df.where(F.col("end_ns") >= start_ns)
    if end_ns > 0:
        df = df.where(F.col("start_ns") <= end_ns)
    meta = [c for c in ("host", "pipeline", "profile_type", "start_ns", "end_ns", "sample_count") if c in df.columns]
    return df.select(*meta).orderBy(F.col("start_ns").desc(), *[c for c in meta if c != "start_ns"])


def typed_fields(loose: Column) -> list[Column]:
    """``fields``, ``fields_str`` and ``fields_bool`` of a ``map<string,variant>``; null gives empty maps."""
    loose = F.coalesce(loose, F.create_map().cast("map<string,variant>"))

    def only(name, value):
        return F.map_filter(F.transform_values(loose, lambda k, v: value(v)), lambda k, v: v.isNotNull()).alias(name)

    def of(kind, target):
        return lambda v: F.when(F.schema_of_variant(v) == kind, F.try_variant_get(v, "$", target))

    return [only("fields", C.agg_numeric), only("fields_str", of("STRING", "string")), only("fields_bool", of("BOOLEAN", "boolean"))]


def decode_records(df: DataFrame, labels_json: str = "labels_json", fields_json: str = "fields_json") -> DataFrame:
    """Stored JSON to typed maps; unreadable JSON gives empty maps and the row stays."""
    labels = F.from_json(labels_json, "map<string,string>")
    loose = F.from_json(fields_json, "map<string,variant>")
    out = df.withColumn("labels", F.coalesce(labels, F.create_map().cast("map<string,string>"))).withColumn("__loose", loose)
    kept = [c for c in out.columns if c not in ("__loose", labels_json, fields_json)]
    return out.select(*kept, *typed_fields(F.col("__loose")))


EXPORTED = ("labels MAP<STRING,STRING>, fields MAP<STRING,VARIANT>, timestamp_ns BIGINT, host STRING")


def read_jsonl(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Records exported as JSON lines; numbers, text and booleans keep the type that the line gives them."""
    raw = _read(spark, path, EXPORTED, streaming, "json", options)
    return raw.select("host", "timestamp_ns", "labels", *typed_fields(F.col("fields")))
