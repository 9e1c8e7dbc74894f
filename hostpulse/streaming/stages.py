"""Counters of every stage of a chain, observed on its edges while it runs.

An edge is the output of the source, of a processor or of the aggregator.  ``observe`` counts its rows inside the
job that runs anyway; streams report them with the progress of each micro-batch, batch runs through ``Observation``.
Counts are kept by batch number, so a micro-batch that is repeated after a failure replaces its own counts.
A batch must be computed once for all sinks (``FanOut`` with a spool folder), else rows would be counted per sink.
"""

from __future__ import annotations

import time
from collections import defaultdict

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = ("host STRING, ts TIMESTAMP, name STRING, kind STRING, ord INT, running BOOLEAN, stub BOOLEAN, batches BIGINT, records BIGINT, "
          "errors BIGINT, capacity BIGINT, size BIGINT, enqueued BIGINT, dequeued BIGINT, dropped BIGINT")


class StageCounts:
    """Rows in and out, late rows and failures of each stage of one chain, by batch."""

    def __init__(self, chain: str):
        self.chain = chain
        self.stages: list[tuple[str, str]] = []                # (name, kind) of every edge, in order
        self.edges: dict[int, dict[str, int]] = {}             # batch -> rows by edge
        self.late: dict[int, int] = {}                         # batch -> rows behind the watermark
        self.sinks: dict[int, dict[str, bool]] = {}            # batch -> sink took it
        self.observations: dict[str, Observation] = {}
        self.running = False

    def edge(self, df: DataFrame, name: str, kind: str) -> DataFrame:
        """Count the rows that leave stage ``name``."""
        self.stages.append((name, kind))
        label = f"{self.chain}.{len(self.stages) - 1}"
        if df.isStreaming:
            return df.observe(label, F.count(F.lit(1)).alias("n"))
        self.observations[label] = Observation(label)
        return df.observe(self.observations[label], F.count(F.lit(1)).alias("n"))

    def finish_batch(self, batch_id: int = 0) -> None:
        """Take the counts of a batch run that has ended."""
        self.edges[batch_id] = {label: int(o.get["n"]) for label, o in self.observations.items()}

    def took(self, batch_id: int | None, sink: str, fine: bool) -> None:
        self.sinks.setdefault(batch_id or 0, {})[sink] = fine

    def progress(self, p) -> None:
        labels = {f"{self.chain}.{i}" for i in range(len(self.stages))}
        seen = {k: int(v["n"] or 0) for k, v in (p.observedMetrics or {}).items() if k in labels}
        batch = int(p.batchId)
        if seen:
            self.edges[batch] = seen
        self.late[batch] = sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)

    def rows(self) -> list[tuple]:
        """(name, kind, ord, batches, records, errors, enqueued, dequeued, dropped) of each stage.

        ``enqueued`` came in and ``dequeued`` went out.  Of a source ``records`` went out; of the others they came in.
        ``dropped`` are late rows at the stage that holds state (the aggregator, or else the last processor), and at a
        sink the rows of batches that it failed on.
        """
        out, flow = [], defaultdict(int)
        for counts in self.edges.values():
            for label, n in counts.items():
                flow[label] += n
        batches = len(self.edges)
        holder = max((i for i, (_, kind) in enumerate(self.stages) if kind == "aggregator"), default=len(self.stages) - 1)
        for i, (name, kind) in enumerate(self.stages):
            sent = flow[f"{self.chain}.{i}"]
            came = flow[f"{self.chain}.{i - 1}"] if i else sent
            out.append((name, kind, i, batches, came, 0, came, sent, sum(self.late.values()) if i == holder else 0))
        last = f"{self.chain}.{len(self.stages) - 1}"
        for j, sink in enumerate(dict.fromkeys(s for took in self.sinks.values() for s in took)):
            fine = {b: took[sink] for b, took in self.sinks.items() if sink in took}
            given = {b: self.edges.get(b, {}).get(last, 0) for b in fine}
            kept = sum(n for b, n in given.items() if fine[b])
            out.append((sink, "sink", len(self.stages) + j, len(fine), sum(given.values()), sum(not ok for ok in fine.values()),
                        sum(given.values()), kept, sum(given.values()) - kept))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        """Stage counters that ``stats.stage_latest`` and ``stats.stage_health`` take."""
        rows = [("driver", None, f"{self.chain}.{name}", kind, i, self.running, False, batches, records, errors, 0, 0, came, sent, dropped)
                for name, kind, i, batches, records, errors, came, sent, dropped in self.rows()]
        return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.current_timestamp())


class _Listener(StreamingQueryListener):
    """Hands the progress of queries to the counts of their chains."""

    def __init__(self):
        self.of: dict[str, StageCounts] = {}
        self.newest: dict[str, int] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        key = str(event.progress.runId)
        if event.progress.name in self.of:
            self.of[event.progress.name].progress(event.progress)
        self.newest[key] = int(event.progress.batchId)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.of.pop(str(event.runId), None)


_LISTENERS: dict[int, _Listener] = {}


def watch(spark: SparkSession, counts: StageCounts) -> _Listener:
    """Attach ``counts`` to the query that will start under the chain's name."""
    key = id(spark._jsparkSession)
    if key not in _LISTENERS:
        _LISTENERS[key] = _Listener()
        spark.streams.addListener(_LISTENERS[key])
    _LISTENERS[key].of[counts.chain] = counts
    return _LISTENERS[key]


def settle(spark: SparkSession, query: StreamingQuery, seconds: float = 30.0) -> None:
    """Reports arrive after their batch: wait until the last one is in."""
    listener, last = _LISTENERS[id(spark._jsparkSession)], query.lastProgress
    end = time.monotonic() + seconds
    while last and listener.newest.get(str(query.runId), -1) < int(last.batchId) and time.monotonic() < end:
        time.sleep(0.05)
