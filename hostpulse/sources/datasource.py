"""User sources and sinks by Spark's Python Data Source API: captured text dumps, and an exactly-once JSON-lines store.

Files are reached through ``pyarrow.fs``, so paths may be local, ``file://`` or those of a store that it knows.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter,
                                    InputPartition, WriterCommitMessage)

from hostpulse.sources import textdumps

DUMPS = "hostpulse_dumps"
STORE = "hostpulse_store"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time, path, bytes) of the files below ``path``, in order of time; hidden ones are left out."""
    store, base = _open(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found
                  if f.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in f.path[len(base):].split("/")))


class DumpFile(InputPartition):
    """A captured file: the unit of reading."""

    def __init__(self, path: str):
        self.path = path


class _Lines:
    def __init__(self, options):
        self.root = options["path"]

    def read(self, partition: DumpFile):
        store, base = _open(self.root)
        tags = dict(x.split("=", 1) for x in partition.path[len(base):].split("/")[:-1] if "=" in x)
        with store.open_input_stream(partition.path) as f:
            rest, ord_ = b"", 0
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    yield partition.path, tags, ord_, line.decode(errors="replace")
                    ord_ += 1
            if rest:
                yield partition.path, tags, ord_, rest.decode(errors="replace")


class DumpReader(_Lines, DataSourceReader):
    def partitions(self):
        return [DumpFile(p) for _, p, _ in _files(self.root)]


class DumpStreamReader(_Lines, DataSourceStreamReader):
    """An offset is the (time, path) of the last file taken; ``maxFiles`` bounds a micro-batch."""

    def __init__(self, options):
        super().__init__(options)
        self.most = int(options.get("maxFiles", "0"))
        self.at = None

    def initialOffset(self):
        return {"time": -1, "path": ""}

    def latestOffset(self):
        files = _files(self.root)
        if self.most:
            after = [f for f in files if self.at is None or f[:2] > self.at]
            files = [f for f in files if self.at is not None and f[:2] <= self.at] + after[:self.most]
        if files:
            self.at = max(files)[:2] if self.at is None else max(self.at, max(files)[:2])
        return {"time": self.at[0], "path": self.at[1]} if self.at else self.initialOffset()

    def partitions(self, start, end):
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        self.at = max(self.at or low, high)
        return [DumpFile(p) for t, p, _ in _files(self.root) if low < (t, p) <= high]

    def commit(self, end):
        pass


class DumpSource(DataSource):
    """Lines of captured files below ``path``, a partition for each file; folders named ``key=value`` become tags."""

    @classmethod
    def name(cls):
        return DUMPS

    def schema(self):
        return "file STRING, tags MAP<STRING,STRING>, ord BIGINT, value STRING"

    def reader(self, schema):
        return DumpReader(self.options)

    def streamReader(self, schema):
        return DumpStreamReader(self.options)


PARSERS = {"stat": textdumps.parse_proc_stat, "maps": textdumps.parse_proc_maps, "kallsyms": textdumps.parse_kallsyms}


def read_dumps(spark: SparkSession, path: str, kind: str, streaming: bool = False, keys=("host",), **options):
    """Parsed dumps of a kind (``stat``, ``maps``, ``kallsyms``); tags named in ``keys`` become columns. ``stat`` gives two tables."""
    spark.dataSource.register(DumpSource)
    reader = (spark.readStream if streaming else spark.read).format(DUMPS).options(**options)
    lines = reader.load(path)
    lines = lines.select(*[lines["tags"][k].alias(k) for k in keys], "ord", "value")
    return PARSERS[kind](lines, tuple(keys)) if kind == "stat" else PARSERS[kind](lines)


# --- exactly-once sink ------------------------------------------------------------------------

class Staged(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class _StoreWriter:
    """Each task stages a file; a commit names the files of a batch in one manifest, which alone makes them visible."""

    def __init__(self, options, names):
        self.root, self.names = options["path"], names

    def write(self, rows):
        store, base = _open(self.root)
        path, n = f"{base}/data/{uuid.uuid4().hex}.jsonl", 0
        store.create_dir(f"{base}/data", recursive=True)
        with store.open_output_stream(path) as f:
            for row in rows:
                f.write((json.dumps(row.asDict(recursive=True), default=str) + "\n").encode())
                n += 1
        return Staged(path, n)

    def _commit(self, messages, batch: str) -> None:
        store, base = _open(self.root)
        manifest = f"{base}/commits/{batch}.json"
        files = [m.path for m in messages if m is not None and m.rows]
        if store.get_file_info(manifest).type == fs.FileType.File:      # the batch is repeated: its rows are in already
            self._drop(messages)
            return
        store.create_dir(f"{base}/commits", recursive=True)
        draft = f"{base}/commits/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"files": [p[len(base) + 1:] for p in files], "rows": sum(m.rows for m in messages if m is not None)}).encode())
        store.move(draft, manifest)
        self._drop([m for m in messages if m is not None and not m.rows])

    def _drop(self, messages) -> None:
        store, _ = _open(self.root)
        for m in messages:
            if m is not None and store.get_file_info(m.path).type == fs.FileType.File:
                store.delete_file(m.path)


class StoreWriter(_StoreWriter, DataSourceWriter):
    def commit(self, messages):
        self._commit(messages, f"run-{uuid.uuid4().hex}")

    def abort(self, messages):
        self._drop(messages)


class StoreStreamWriter(_StoreWriter, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        self._commit(messages, f"batch-{batchId}")

    def abort(self, messages, batchId):
        self._drop(messages)


class StoreReader(DataSourceReader):
    def __init__(self, options, names):
        self.root, self.names = options["path"], names

    def partitions(self):
        store, base = _open(self.root)
        found = []
        for _, path, _ in _files(f"{self.root}/commits"):
            with store.open_input_stream(path) as f:
                found += json.loads(f.read())["files"]
        return [DumpFile(f"{base}/{p}") for p in found]

    def read(self, partition: DumpFile):
        for _, _, _, line in _Lines({"path": self.root}).read(partition):
            row = json.loads(line)
            yield tuple(row.get(n) for n in self.names)


class StoreSource(DataSource):
    """JSON lines below ``path`` that belong to committed batches only; a repeated batch adds nothing, an aborted one neither."""

    @classmethod
    def name(cls):
        return STORE

    def schema(self):
        return self.options.get("columns", "value STRING")

    def reader(self, schema):
        return StoreReader(self.options, schema.names)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("the store only takes appends")
        return StoreWriter(self.options, schema.names)

    def streamWriter(self, schema, overwrite):
        return StoreStreamWriter(self.options, schema.names)


def read_store(spark: SparkSession, path: str, columns: str) -> DataFrame:
    spark.dataSource.register(StoreSource)
    return spark.read.format(STORE).option("columns", columns).load(path)


def stream_to_store(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    stream.sparkSession.dataSource.register(StoreSource)
    writer = stream.writeStream.format(STORE).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
