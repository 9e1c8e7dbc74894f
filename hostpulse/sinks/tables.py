"""Partitioned telemetry tables: append, retention, compaction, recent batches and fan-out."""

from __future__ import annotations

import logging
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hostpulse.functions import columns as C
from hostpulse.sources.readers import read_table

log = logging.getLogger(__name__)
PARTITIONS = ("pipeline", "date")


def _append(df: DataFrame, path: str, time_column: str, batch_id: int | None = None) -> None:
    dated = df.withColumn("date", C.ns_to_ts(time_column).cast("date"))
    # rebalance: adaptive execution merges small and splits large output partitions
    dated = dated.hint("rebalance", *[F.col(p) for p in PARTITIONS])
    if batch_id is None:
        dated.write.partitionBy(*PARTITIONS).mode("append").parquet(path)
    else:
        publish(dated, path, batch_id, PARTITIONS)


def publish(df: DataFrame, path: str, batch_id: int, parts=()) -> None:
    """Add a micro-batch once: files are staged, then moved in under names that carry the batch id.

    A repeated batch first takes away what an earlier attempt left, so no row is there twice.
    """
    spark, staging = df.sparkSession, f"{path}/_staging-{batch_id}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(staging)
    fs, _ = _fs(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    depth = "/*" * len(parts)
    for status in _list(fs, Path(f"{path}{depth}/batch-{batch_id}-*")):
        fs.delete(status.getPath(), False)
    base = fs.makeQualified(Path(staging)).toUri().getPath()
    for i, status in enumerate(_list(fs, Path(f"{staging}{depth}/part-*"))):
        source = status.getPath()
        inside = source.getParent().toUri().getPath()[len(base):].strip("/")
        target = Path(Path(path), inside) if inside else Path(path)
        fs.mkdirs(target)
        if not fs.rename(source, Path(target, f"batch-{batch_id}-{i:05d}.parquet")):
            raise OSError(f"{source} could not be moved to {target}")
    fs.delete(Path(staging), True)
    spark.catalog.refreshByPath(path)


def write_records(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    _append(df, path, "timestamp_ns", batch_id)


def write_stack_samples(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """All columns are kept, kernel frames included."""
    _append(df, path, "timestamp_ns", batch_id)


def write_profiles(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    _append(df, path, "start_ns", batch_id)


def write_jsonl(records: DataFrame, path: str, include_ts: bool = False) -> None:
    from hostpulse.sinks.text import export_jsonl
    export_jsonl(records, include_ts).write.mode("append").text(path)


def write_folded(samples: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Folded-stack text, replacing what is there; a micro-batch has a folder of its own and replaces only that.

    Readers of a stream's folder add the counts of equal stacks."""
    from hostpulse.operators.profiles import folded_stacks
    lines = folded_stacks(samples).select(F.concat("stack", F.lit(" "), F.col("count").cast("string")).alias("value"))
    lines.write.mode("overwrite").text(path if batch_id is None else f"{path}/batch={batch_id}")


def write_exposition(records: DataFrame, path: str, prefix: str = "hostpulse") -> None:
    from hostpulse.sinks.text import prometheus_exposition
    lines = prometheus_exposition(records, prefix).orderBy("metric", "ord", "labels_text")
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


# --- recent batches ---------------------------------------------------------------------------

def recent_batches(df: DataFrame, key: str = "pipeline", n: int = 30, batch: str = "batch_id") -> DataFrame:
    """Rows of the last ``n`` batches per key (missing key: ``default``).

    Batches are ranked on their distinct ids, never on their rows.
    """
    df = df.withColumn(key, F.coalesce(F.col(key), F.lit("default")))
    newest = Window.partitionBy(key).orderBy(F.col(batch).desc())
    kept = (df.select(key, batch).distinct().withColumn("__rank", F.row_number().over(newest))
            .where(F.col("__rank") <= n).drop("__rank"))
    return df.join(kept, [key, batch], "left_semi").orderBy(key, batch)


def latest_batch(df: DataFrame, key: str = "pipeline", batch: str = "batch_id") -> DataFrame:
    return recent_batches(df, key, 1, batch)


# --- retention and compaction -----------------------------------------------------------------

def prune(df: DataFrame, max_age_ns: int, now_ns: int, time_column: str = "timestamp_ns") -> DataFrame:
    """Rows not older than ``max_age_ns``; age 0 keeps everything."""
    return df if max_age_ns <= 0 else df.where(F.col(time_column) >= now_ns - max_age_ns)


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _list(fs, path) -> list:
    return list(fs.globStatus(path) or [])


def prune_table(spark: SparkSession, path: str, max_age_ns: int, now_ns: int, time_column: str = "timestamp_ns") -> None:
    """Drop rows before the cutoff: directories of dates before the border date, rows of the border date.

    The border date is decided per pipeline from the data. Its directories are taken from the files themselves, so
    names that are escaped on disk or look like numbers are as safe as others; a NULL pipeline is one too.
    """
    if max_age_ns <= 0:
        return
    cutoff = now_ns - max_age_ns
    border = spark.range(1).select(C.ns_to_ts(F.lit(cutoff)).cast("date").cast("string")).first()[0]
    edge = read_table(spark, path).where(F.col("date") == F.lit(border).cast("date"))
    fresh = F.col(time_column) >= cutoff
    # one row per directory of the border date
    state = (edge.withColumn("__dir", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).groupBy("__dir")
             .agg(F.coalesce(F.max(fresh), F.lit(False)).alias("some"), F.coalesce(F.min(fresh), F.lit(False)).alias("all")).collect())
    if any(r["some"] and not r["all"] for r in state):
        (edge.where(fresh).hint("rebalance", *[F.col(p) for p in PARTITIONS]).write.partitionBy(*PARTITIONS).mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(path))
    fs, _ = _fs(spark, path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    for r in state:
        if not r["some"]:
            fs.delete(Path(spark._jvm.java.net.URI(r["__dir"])), True)
    for status in _list(fs, Path(f"{path}/pipeline=*/date=*")):
        date = status.getPath().getName().split("=", 1)[1]
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", date) and date < border:
            fs.delete(status.getPath(), True)
    spark.catalog.refreshByPath(path)


STORES = {"records": "timestamp_ns", "stack_samples": "timestamp_ns", "profiles": "start_ns"}


def prune_store(spark: SparkSession, base: str, max_age_ns: int, now_ns: int) -> list[str]:
    """Retention over all tables of a store; returns the names of those that exist."""
    done = []
    for name, column in STORES.items():
        fs, jpath = _fs(spark, f"{base.rstrip('/')}/{name}")
        if fs.exists(jpath):
            prune_table(spark, f"{base.rstrip('/')}/{name}", max_age_ns, now_ns, column)
            done.append(name)
    return done


def compact_table(spark: SparkSession, path: str, target_mb: int = 256) -> None:
    """Rewrite a table into files of about ``target_mb`` and swap it in.

    Adaptive execution deals the rows out: small partitions are merged, one larger than the target is split by its
    own size.  The old table goes only after the new one is in its place.
    """
    fs, jpath = _fs(spark, path)
    table = read_table(spark, path)
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    parts = [p for p in PARTITIONS if p in table.columns]
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory, None)
    spark.conf.set(advisory, str(target_mb * 1024 * 1024))
    try:
        writer = table.hint("rebalance", *[F.col(p) for p in parts]).write
        (writer.partitionBy(*parts) if parts else writer).parquet(fresh)
    finally:
        spark.conf.unset(advisory) if before is None else spark.conf.set(advisory, before)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(jpath, Path(old)):
        raise OSError(f"{path} could not be moved; the compacted copy is in {fresh}")
    if not fs.rename(Path(fresh), jpath):
        if not fs.rename(Path(old), jpath):
            raise OSError(f"{path} is in {old}, its compacted copy in {fresh}")
        raise OSError(f"{fresh} could not be moved to {path}; the table is as it was")
    fs.delete(Path(old), True)
    spark.catalog.refreshByPath(path)


# --- fan-out ----------------------------------------------------------------------------------

class FanOut:
    """``foreachBatch`` target that gives a batch to every sink; a failing sink is counted, not fatal.

    With several sinks and a ``spool`` folder the batch is written there once and every sink reads that, so its
    lineage is not run again for each.  Batches that a sink failed on stay in the spool, and a marker names the sink:
    ``replay`` gives them to it, also after a restart, as all it needs lies in the folder.
    """

    def __init__(self, sinks, spool: str | None = None, names=None, took=None):
        self.sinks = list(sinks)
        self.spool = spool
        self.names = list(names or [getattr(s, "__name__", f"sink{i}") for i, s in enumerate(self.sinks)])
        self.errors = dict.fromkeys(self.names, 0)
        self.took = took                               # told of every (batch, sink, whether it took the batch)

    def _stored(self, spark, schema, batch_id):
        return spark.read.schema(schema).parquet(f"{self.spool}/batch={batch_id}")

    def _give(self, i: int, df: DataFrame, batch_id: int | None) -> bool:
        try:
            self.sinks[i](df, batch_id)
            fine = True
        except Exception:
            self.errors[self.names[i]] += 1
            log.exception("sink failed in batch %s", batch_id)
            fine = False
        if self.took:
            self.took(batch_id, self.names[i], fine)
        return fine

    def __call__(self, df: DataFrame, batch_id: int | None) -> None:
        spark, path = df.sparkSession, f"{self.spool}/batch={batch_id}"
        if self.spool:
            df.write.mode("overwrite").parquet(path)
            df = self._stored(spark, df.schema, batch_id)
        bad = [i for i in range(len(self.sinks)) if not self._give(i, df, batch_id)]
        if self.spool:
            self._mark(spark, batch_id, bad)

    def _mark(self, spark, batch_id, bad: list[int]) -> None:
        """Leave markers of the sinks that a spooled batch still waits for; a batch that waits for none goes."""
        fs, folder = _fs(spark, f"{self.spool}/failed/batch={batch_id}")
        fs.delete(folder, True)
        for i in bad:
            fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"sink={i}"), True).close()
        if not bad:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.spool}/batch={batch_id}"), True)

    def waiting(self, spark: SparkSession) -> dict[int | None, list[int]]:
        """Spooled batches and the sinks that they wait for."""
        fs, _ = _fs(spark, self.spool)
        out: dict = {}
        for f in _list(fs, spark._jvm.org.apache.hadoop.fs.Path(f"{self.spool}/failed/batch=*/sink=*")):
            batch = f.getPath().getParent().getName().split("=", 1)[1]
            out.setdefault(None if batch == "None" else int(batch), []).append(int(f.getPath().getName().split("=", 1)[1]))
        return {b: sorted(out[b]) for b in sorted(out, key=lambda b: -1 if b is None else b)}

    def replay(self, spark: SparkSession) -> int:
        """Give spooled batches to the sinks that failed on them; returns how many still fail."""
        left = 0
        for batch_id, sinks in self.waiting(spark).items():
            df = spark.read.parquet(f"{self.spool}/batch={batch_id}")
            bad = [i for i in sinks if not self._give(i, df, batch_id)]
            self._mark(spark, batch_id, bad)
            left += len(bad)
        return left


def fan_out(sinks, spool: str | None = None) -> FanOut:
    return FanOut(sinks, spool)


# --- gauge board ------------------------------------------------------------------------------

class GaugeBoard:
    """``foreachBatch`` target that shows the last value of every series ever seen.

    The last values are a table with one version per micro-batch under ``path``; a repeated batch
    rebuilds the same version from the one before it.  ``batch_id`` None (batch runs) adds the next version.
    ``<path>/exposition`` holds the text.
    """

    KEEP = 2

    def __init__(self, path: str, prefix: str = "hostpulse"):
        self.path, self.prefix = path.rstrip("/"), prefix

    def _versions(self, spark) -> list[int]:
        fs, _ = _fs(spark, self.path)
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/v=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=", 1)[1]) for f in found)

    def __call__(self, df: DataFrame, batch_id: int | None) -> None:
        from hostpulse.sinks.text import exposition_lines, last_gauges
        spark = df.sparkSession
        versions = self._versions(spark)
        if batch_id is None:
            batch_id = versions[-1] + 1 if versions else 0
        known = [v for v in versions if v < batch_id]
        gauges = last_gauges(df, self.prefix)
        if known:
            before = spark.read.schema(gauges.schema).parquet(f"{self.path}/state/v={known[-1]}")
            gauges = (before.unionByName(gauges).groupBy("metric", "labels")
                      .agg(F.max_by(F.struct("value", "at"), "at").alias("l")).select("metric", "labels", "l.value", "l.at"))
        current = f"{self.path}/state/v={batch_id}"
        gauges.write.mode("overwrite").parquet(current)
        lines = exposition_lines(spark.read.schema(gauges.schema).parquet(current))
        (lines.orderBy("metric", "ord", "labels_text").select(F.col("line").alias("value"))
         .write.mode("overwrite").text(f"{self.path}/exposition"))
        fs, _ = _fs(spark, self.path)
        for old in known[:1 - self.KEEP]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/v={old}"), True)


class RecentBatches:
    """``foreachBatch`` target that keeps the rows of the last ``n`` batches per key under ``path``.

    One version per batch is written, from the one before it and the new rows, so a repeated batch replaces itself.
    """

    KEEP = 2

    def __init__(self, path: str, n: int = 30, key: str = "pipeline"):
        self.path, self.n, self.key = path.rstrip("/"), n, key

    def _versions(self, spark) -> list[int]:
        fs, _ = _fs(spark, self.path)
        found = _list(fs, spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=", 1)[1]) for f in found)

    def __call__(self, df: DataFrame, batch_id: int | None) -> None:
        spark = df.sparkSession
        versions = self._versions(spark)
        if batch_id is None:
            batch_id = versions[-1] + 1 if versions else 0
        known = [v for v in versions if v < batch_id]
        rows = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        if known:
            rows = spark.read.schema(rows.schema).parquet(f"{self.path}/v={known[-1]}").unionByName(rows)
        recent_batches(rows, self.key, self.n).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        fs, _ = _fs(spark, self.path)
        for old in known[:1 - self.KEEP]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v={self._versions(spark)[-1]}")
