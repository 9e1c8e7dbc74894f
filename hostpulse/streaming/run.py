"""Running streams: micro-batch sinks, bounded runs and progress counters."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from hostpulse.functions import columns as C
from hostpulse.session import durable_dir
from hostpulse.sinks.tables import FanOut


# A stream with keyed state has a state store for each core, but no fewer than these.
LEAST_PARTITIONS = 8


@contextmanager
def _partitions(stream: DataFrame, n: int | None):
    """The shuffle partitions of a stream that starts within: ``n``, or for keyed state one for each core.

    Every micro-batch starts a Python worker and commits a store for each of them, whether it has rows or not.  The first
    run of a checkpoint fixes the number; the session's own setting is an upper limit where ``n`` isn't given.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    if n is None and "TransformWithState" in stream._jdf.queryExecution().analyzed().toString():
        n = min(int(before), max(stream.sparkSession.sparkContext.defaultParallelism, LEAST_PARTITIONS))
    conf.set(key, str(n or before))
    try:
        yield
    finally:
        conf.set(key, before)


def start(stream: DataFrame, sinks, checkpoint: str | None = None, available_now: bool = False,
          every: str | None = None, name: str | None = None, partitions: int | None = None) -> StreamingQuery:
    """Start a stream that hands each micro-batch to every sink ``(df, batch_id)``."""
    checkpoint = checkpoint or durable_dir(stream.sparkSession, "stream")
    target = sinks if isinstance(sinks, FanOut) else FanOut(sinks)
    counter_of(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(target).outputMode("append").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    with _partitions(stream, partitions):
        return writer.start()


class Closing:
    """The end of a stream as a row: what state holds comes out when the input is known to be complete.

    ``attach`` unites the stream with a folder of marks that is empty while it runs, and sets the watermark on both.
    ``close`` adds a mark so far behind the last row that the watermark passes the end of every open window; the mark
    itself goes no further than the watermark.  A mark reaches just as far as needed: rows of later windows that come
    in a later run are still taken.
    """

    def __init__(self, spark: SparkSession, folder: str, delay: str, window: str, time: str = "ts"):
        self.spark, self.folder, self.delay, self.time = spark, folder, delay, time
        self.delay_us, self.window_us = C.duration_ns(delay) // 1000, C.duration_ns(window) // 1000
        self._marks([]).write.mode("append").parquet(folder)

    def _marks(self, at_us: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in at_us], "at BIGINT").coalesce(1)

    def attach(self, stream: DataFrame) -> DataFrame:
        marks = self.spark.readStream.schema("at BIGINT").parquet(self.folder)
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.time else F.timestamp_micros("at").alias(f.name) for f in stream.schema]
        both = stream.withColumn("__end", F.lit(False)).unionByName(marks.select(*empty, F.lit(True).alias("__end")))
        both = both.withWatermark(self.time, self.delay)
        # the watermark has to see the mark: no filter is moved below a column that isn't deterministic
        return both.withColumn("__bar", F.rand()).where(~F.col("__end") & (F.col("__bar") >= 0)).drop("__end", "__bar")

    def close(self, query: StreamingQuery) -> bool:
        """Add a mark for what ``query`` has left in its state; False if there is one already."""
        times = [p["eventTime"] for p in map(_progress, query.recentProgress)]
        newest = max((_micros(t["max"]) for t in times if "max" in t), default=None)
        reached = max((_micros(t["watermark"]) for t in times if "watermark" in t), default=0)
        last = max(newest or 0, reached + self.delay_us if reached else 0)
        mark = last + self.window_us + self.delay_us
        known = self.spark.read.schema("at BIGINT").parquet(self.folder).agg(F.max("at")).first()[0]
        if not last or (known is not None and (known >= mark or newest is None or newest == known)):
            return False
        self._marks([mark]).write.mode("append").parquet(self.folder)
        return True


def _progress(p) -> dict:
    return p if isinstance(p, dict) else json.loads(p.json)


def _micros(text: str) -> int:
    return round(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() * 1_000_000)


def run_available(stream: DataFrame, sinks, checkpoint: str | None = None, closing: Closing | None = None,
                  name: str | None = None) -> StreamingQuery:
    """Process everything that is there, then stop.  The last windows stay in state until the watermark passes, unless
    ``closing`` (whose ``attach`` made the stream) is given: then a second run from the same checkpoint brings them out."""
    checkpoint = checkpoint or durable_dir(stream.sparkSession, "stream")
    query = start(stream, sinks, checkpoint, available_now=True, name=name)
    query.awaitTermination()
    if closing is not None and closing.close(query):
        query = start(stream, sinks, checkpoint, available_now=True, name=name)
        query.awaitTermination()
    return query


def to_table(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run ``stream`` to completion into a parquet table (exactly once) and read it back."""
    spark = stream.sparkSession
    path = path or durable_dir(spark, "table")
    writer = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
              .option("checkpointLocation", durable_dir(spark, "stream")).trigger(availableNow=True))
    with _partitions(stream, None):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Running totals of a query as stage counters (``schemas.COUNTERS["stages"]``), one row per micro-batch.

    The rows come from the session's ``ProgressCounter``, which adds up every report as it arrives, so totals are
    right however few reports Spark keeps.  Feed the result to ``stats.stage_health``.
    """
    counter = counter_of(spark)
    counter.wait_for(query)
    failed = 1 if query.exception() is not None else 0
    rows = [(name, at, bool(query.isActive), batches, records, failed, dropped)
            for name, at, batches, records, dropped in counter.history.get(str(query.id), [])]
    raw = spark.createDataFrame(rows, "name STRING, timestamp STRING, running BOOLEAN, batches BIGINT, records BIGINT, "
                                      "errors BIGINT, dropped BIGINT")
    zero = F.lit(0).cast("bigint")
    return raw.select(F.lit("driver").alias("host"), F.to_timestamp("timestamp").alias("ts"), "name", "running",
                      F.lit(False).alias("stub"), "batches", "records", "errors", zero.alias("capacity"), zero.alias("size"),
                      F.col("records").alias("enqueued"), F.col("records").alias("dequeued"), "dropped")


_COUNTERS: dict[int, "ProgressCounter"] = {}


def counter_of(spark: SparkSession) -> "ProgressCounter":
    """The session's counter; made and attached on first use, before a query starts."""
    key = id(spark._jsparkSession)
    if key not in _COUNTERS:
        _COUNTERS[key] = ProgressCounter()
        spark.streams.addListener(_COUNTERS[key])
    return _COUNTERS[key]


class ProgressCounter(StreamingQueryListener):
    """Totals per query while it runs: batches, records, late drops, failures."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self.history: dict[str, list[tuple]] = {}      # (name, time, batches, records, dropped) after each report
        self.newest: dict[str, int] = {}

    def wait_for(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Reports arrive after their batch; wait until the last one is in."""
        last = query.lastProgress
        end = time.monotonic() + seconds
        while last and self.newest.get(str(query.id), -1) < int(last.batchId) and time.monotonic() < end:
            time.sleep(0.05)

    def _of(self, key) -> dict[str, int]:
        return self.totals.setdefault(str(key), {"batches": 0, "records": 0, "dropped": 0, "errors": 0})

    def onQueryStarted(self, event):
        self._of(event.id)

    def onQueryProgress(self, event):
        p, t = event.progress, self._of(event.progress.id)
        t["batches"] += 1
        t["records"] += int(p.numInputRows)
        t["dropped"] += sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)
        self.history.setdefault(str(p.id), []).append((p.name or str(p.id), p.timestamp, int(p.batchId) + 1, t["records"], t["dropped"]))
        self.newest[str(p.id)] = int(p.batchId)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self._of(event.id)["errors"] += 1
