"""Keyed state for streams: the previous row of a key, and running averages.

Column names here do not start with an underscore (Spark renames such columns on the way to Python).
Rows and state travel as JSON text built and parsed by Spark itself, so 64-bit integers, decimals
and nested columns pass the Python boundary unchanged.
"""

from __future__ import annotations

import json
import zlib
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "true"}
# Keys meet in so many shards: a call of Python, its frame and its timer serve all keys of a shard.
SHARDS = 512
# Waiting rows that lie in one value of the state, and rows of a frame that goes back to Spark.
CHUNK = 1000
# Keys whose last rows lie in one value of the state: a value is read and written by one call each, which costs as much
# as parsing some hundred keys.
CELL_KEYS = 500
FRAME_ROWS = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(df: DataFrame) -> None:
    # keyed state larger than memory lives in RocksDB and its checkpoint
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def event_time_column(df: DataFrame) -> str | None:
    """Column that carries the stream's watermark, if any."""
    for field in df._jdf.schema().fields():
        if field.metadata().contains("spark.watermarkDelayMs"):
            return field.name()
    return None


def _group_columns(df: DataFrame, keys, order):
    """Keys as text (NULL-safe) and order columns, next to the JSON row."""
    key_text = F.to_json(F.struct(*[F.col(k) for k in keys]), JSON_OPTIONS)
    # times as numbers, so that a row has one event-time column only
    place = [F.unix_micros(o) if df.schema[o].dataType.typeName() == "timestamp" else F.col(o) for o in order]
    return [key_text.alias("pair_key"), *[p.alias(f"ord{i}") for i, p in enumerate(place)]]


def _comparable(pdf: pd.DataFrame, order) -> list[tuple]:
    """Order columns as tuples of plain values; times as nanoseconds."""
    columns = [pdf[o].map(lambda t: t.value) if str(pdf[o].dtype).startswith("datetime") else pdf[o] for o in order]
    return [tuple(x.item() if hasattr(x, "item") else x for x in row) for row in zip(*columns)]


class _Keyed(StatefulProcessor):
    """Rows of every key in order, whatever micro-batch they come in.

    Spark groups by shards of keys, and a shard holds the last row of each of its keys, in cells of up to ``CELL_KEYS`` keys
    by hash (their number doubles as keys come), so a micro-batch makes a few calls for a cell and none for a key.
    With a watermark, rows wait in the state until it has passed them and are then handled in event-time order:
    later arrivals can no longer come before them, and rows that are too late are dropped and counted by Spark.
    Waiting rows lie in chunks of event time with one timer at the oldest row of the shard.  A micro-batch writes its own
    rows (small chunks are merged as they come), and when the watermark moves only the chunks that it has reached are
    read, so a key with very many waiting rows costs no more per row than any other.
    Without a watermark, rows are handled as they arrive; a row that is older than the last one handled gets no
    predecessor, so no negative duration is ever made.  ``ttl_ms`` after its last row a key is forgotten.
    """

    def __init__(self, order, time_name, ttl_ms, width: int, chunk: int = CHUNK):
        self.order, self.time_name, self.ttl_ms, self.width, self.chunk = order, time_name, ttl_ms, width, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "cell BIGINT", "states STRING")
        self.cells = handle.getValueState("cells", "n BIGINT")
        if self.time_name:
            self.pending = handle.getMapState("pending", "chunk BIGINT", "rows STRING")
            self.open = handle.getValueState("open", "n BIGINT, chunks STRING")
        if self.ttl_ms:
            self.waiting = handle.getMapState("waiting", "pair_key STRING", "n BIGINT")
            self.ends = handle.getMapState("ends", "at BIGINT", "keys STRING")

    def handleInputRows(self, key, rows, timerValues):
        arrived = []            # [time, order, values, key]
        for pdf in rows:        # bounded by the trigger's input limit
            at = [int(t.value // 1000) for t in pdf[self.time_name]] if self.time_name else [0] * len(pdf)
            values = [[_plain(x) for x in rest] for rest in zip(*[pdf[c] for c in self.columns()])]
            keys = pdf["pair_key"] if "pair_key" in pdf else [key[0]] * len(pdf)
            arrived += zip(at, _comparable(pdf, self.order), values, keys)
        if not self.time_name:
            yield from self.emit(arrived)
        elif arrived:
            n, index = self._index()
            self._keep(index, arrived)
            self._save(index, n + len(arrived))
            self._wait(arrived, 1)

    def _index(self) -> tuple[int, dict]:
        """Waiting rows; and chunks ``[id, oldest, rows]``, the timers that are set, and the next free id."""
        known = self.open.get()
        return (known[0], json.loads(known[1])) if known else (0, {"next": 0, "timers": [], "chunks": []})

    def _save(self, index: dict, n: int) -> None:
        oldest = min((c[1] for c in index["chunks"]), default=None)
        if oldest is not None and -(-oldest // 1000) < min(index["timers"], default=float("inf")):
            index["timers"].append(-(-oldest // 1000))
            self.handle.registerTimer(index["timers"][-1])
        self.open.update((n, json.dumps(index)))

    def _take(self, chunk) -> list:
        rows = json.loads(self.pending.getValue((chunk[0],))[0])
        self.pending.removeKey((chunk[0],))
        return rows

    def _keep(self, index: dict, rows: list, merge: bool = True) -> None:
        chunks = index["chunks"]
        # as in a binary counter, so that a row is written again few times
        while merge and chunks and chunks[-1][2] <= len(rows) and chunks[-1][2] + len(rows) <= self.chunk:
            rows = self._take(chunks.pop()) + rows
        rows = sorted(rows, key=lambda r: r[0])
        added = []
        for i in range(0, len(rows), self.chunk):
            some = rows[i:i + self.chunk]
            self.pending.updateValue((index["next"],), (json.dumps(some),))
            added.append([index["next"], some[0][0], len(some)])
            index["next"] += 1
        index["chunks"] = chunks + added if merge else added + chunks

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        n, index = self._index()
        reached = [c for c in index["chunks"] if c[1] <= passed]
        if reached:
            index["chunks"] = [c for c in index["chunks"] if c[1] > passed]
            index["timers"] = [t for t in index["timers"] if t * 1000 > passed]
            rows = [r for c in reached for r in self._take(c)]
            due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
            self._keep(index, rest, merge=False)
            self._save(index, n - len(due))
            self._wait(due, -1)
            yield from self.emit(due)
            self._age(due, passed // 1000)
        self._forget(expiredTimerInfo.getExpiryTimeInMs(), passed // 1000)

    def _wait(self, rows: list, sign: int) -> None:
        """Count the waiting rows of each key, where keys are forgotten."""
        counts: dict[str, int] = {}
        for r in rows if self.ttl_ms else ():
            counts[r[3]] = counts.get(r[3], 0) + sign
        for k, n in counts.items():
            n += self.waiting.getValue((k,))[0] if self.waiting.containsKey((k,)) else 0
            if n:
                self.waiting.updateValue((k,), (n,))
            else:
                self.waiting.removeKey((k,))

    def _age(self, rows: list, passed_ms: int) -> None:
        """Note when the keys of ``rows``, just handled, are to be forgotten, unless a row comes first."""
        newest: dict[str, tuple] = {}
        for r in rows if self.ttl_ms else ():
            newest[r[3]] = max(newest.get(r[3], ((),)), (tuple(r[1]), r[0]))
        ends, gone = {}, []
        for k, (_, at) in sorted(newest.items()):
            end = at // 1000 + self.ttl_ms
            if end > passed_ms:
                ends.setdefault(end, []).append(k)
            elif not self.waiting.containsKey((k,)):
                gone.append(k)
        self._drop(gone, passed_ms)
        for end, some in ends.items():
            known = json.loads(self.ends.getValue((end,))[0]) if self.ends.containsKey((end,)) else None
            self.ends.updateValue((end,), (json.dumps((known or []) + some),))
            if known is None:
                self.handle.registerTimer(end)

    def _forget(self, at_ms: int, passed_ms: int) -> None:
        if not self.ttl_ms or not self.ends.containsKey((at_ms,)):
            return
        keys = set(json.loads(self.ends.getValue((at_ms,))[0]))
        self._drop([k for k in keys if not self.waiting.containsKey((k,))], passed_ms)
        self.ends.removeKey((at_ms,))

    def _drop(self, keys, passed_ms: int) -> None:
        """Forget those of ``keys`` whose last row is ``ttl_ms`` old."""
        cell = self._cell_of() if keys else None
        for c, some in groupby(sorted(keys, key=cell), key=cell):
            states = self._states(c)
            for k in some:
                if k in states and states[k]["at"] // 1000 + self.ttl_ms <= passed_ms:
                    del states[k]
            if states:
                self.last.updateValue((c,), (json.dumps(states),))
            elif self.last.containsKey((c,)):
                self.last.removeKey((c,))

    def _cell_of(self):
        """Function from keys of this shard to the numbers of their cells."""
        known = self.cells.get()
        self.n_cells = known[0] if known else 1
        return lambda k: zlib.crc32(k.encode()) % self.n_cells

    def _states(self, cell: int) -> dict:
        return json.loads(self.last.getValue((cell,))[0]) if self.last.containsKey((cell,)) else {}

    def _split(self, widest: int) -> None:
        """More cells, so that the widest holds ``CELL_KEYS`` keys or fewer: a cell's keys stay in cells congruent to it."""
        n, self.n_cells = self.n_cells, self.n_cells << (-(-widest // CELL_KEYS) - 1).bit_length()
        self.cells.update((self.n_cells,))
        for c in range(n):
            parts: dict[int, dict] = {}
            for k, state in self._states(c).items():
                parts.setdefault(zlib.crc32(k.encode()) % self.n_cells, {})[k] = state
            if parts and c not in parts:
                self.last.removeKey((c,))
            for part, states in parts.items():
                self.last.updateValue((part,), (json.dumps(states),))

    def emit(self, rows):
        """Frames of ``rows``, handled cell by cell and key by key in order."""
        out: dict[str, list] = {}
        cell, widest = self._cell_of(), 0
        for c, some in groupby(sorted(rows, key=lambda r: (cell(r[3]), r[3], tuple(r[1]), r[0])), key=lambda r: cell(r[3])):
            states = self._states(c)
            for k, mine in groupby(some, key=lambda r: r[3]):
                mine = [(at, tuple(order), values) for at, order, values, _ in mine]
                known = states.get(k)
                made, state = self.handle_rows(mine, known)
                newest = list(mine[-1][1]) if not known or mine[-1][1] > tuple(known["ord"]) else known["ord"]
                states[k] = {"ord": newest, "at": mine[-1][0], "state": state}
                if self.time_name:
                    made[self.time_name] = [r[0] for r in mine]
                for name, values in made.items():
                    out.setdefault(name, []).extend(values)
                if len(out["row_text"]) >= FRAME_ROWS:
                    yield self._frame(out)
                    out = {}
            self.last.updateValue((c,), (json.dumps(states),))
            widest = max(widest, len(states))
        if out:
            yield self._frame(out)
        if widest > CELL_KEYS:
            self._split(widest)

    def _frame(self, out: dict) -> pd.DataFrame:
        numbers = {c: pd.Series(v, dtype="float64") for c, v in out.items() if c not in ("row_text", "before_text", self.time_name)}
        at = {self.time_name: pd.to_datetime(out[self.time_name], unit="us")} if self.time_name else {}
        return pd.DataFrame({c: numbers.get(c, at.get(c, v)) for c, v in out.items()})

    def close(self) -> None:
        pass


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x


class _Previous(_Keyed):
    """Emit every row with the payload of the row before it in its key."""

    def columns(self):
        return ["row_text", "payload_text"]

    def handle_rows(self, rows, known):
        before, last = [], (tuple(known["ord"]), known["state"]) if known else None
        for _, order, (_, payload) in rows:
            before.append(last[1] if last and last[0] <= order else None)
            if not last or last[0] <= order:
                last = (order, payload)
        return {"row_text": [r[2][0] for r in rows], "before_text": before}, last[1]


class _Ema(_Keyed):
    """Continue an exponential average per key and column."""

    def __init__(self, order, cols, alpha, time_name, ttl_ms):
        super().__init__(order, time_name, ttl_ms, len(cols))
        self.alpha = alpha

    def columns(self):
        return ["row_text", *[f"x{i}" for i in range(self.width)]]

    def handle_rows(self, rows, known):
        values = list(known["state"]) if known else [None] * self.width
        out = {"row_text": [r[2][0] for r in rows], **{f"y{i}": [] for i in range(self.width)}}
        for _, _, (_, *xs) in rows:
            for i, x in enumerate(map(_plain, xs)):
                if x is not None:
                    values[i] = x if values[i] is None else self.alpha * x + (1 - self.alpha) * values[i]
                out[f"y{i}"].append(values[i])
        return out, values


def _run(df, rows, processor, schema, time_name):
    if processor.ttl_ms and not time_name:
        raise ValueError("expiring state needs a watermark on the stream")
    mode = "EventTime" if time_name else "None"
    kwargs = {"eventTimeColumnName": time_name} if time_name else {}
    _use_rocksdb(df)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("pair_key"), F.lit(SHARDS)).cast("int"))
    return rows.groupBy("shard").transformWithStateInPandas(processor, schema, "Append", mode, **kwargs)


def previous_row(df: DataFrame, keys, order, carry, out: str, ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of ``ordered.with_neighbor``: struct ``out`` with ``carry`` of the previous row.

    With a watermark (its column must rise with ``order``) the answer is that of the batch form for all rows that
    the watermark has passed, whatever order they arrive in; rows wait that long.  Without one, rows are put in
    ``order`` within a micro-batch and an older row of a later one gets no predecessor.
    """
    time_name = event_time_column(df)
    payload = F.struct(*[F.col(c) if isinstance(c, str) else c for c in carry])
    payload_type = df.select(payload.alias("p")).schema["p"].dataType
    row_type = df.schema
    rows = df.select(*_group_columns(df, keys, order), F.to_json(payload, JSON_OPTIONS).alias("payload_text"),
                     F.to_json(F.struct("*"), JSON_OPTIONS).alias("row_text"),
                     *([F.col(time_name)] if time_name else []))
    schema = T.StructType([T.StructField("row_text", T.StringType()), T.StructField("before_text", T.StringType())])
    if time_name:
        schema = schema.add(time_name, T.TimestampType())
    names = [f"ord{i}" for i in range(len(order))]
    result = _run(df, rows, _Previous(names, time_name, ttl_ms, 1), schema, time_name)
    parsed = F.from_json("row_text", row_type, JSON_OPTIONS)
    result = result.select(*([time_name] if time_name else []), parsed.alias("__r"),
                           F.from_json("before_text", payload_type, JSON_OPTIONS).alias(out))
    cols = [F.col(time_name) if c == time_name else F.col(f"__r.{c}").alias(c) for c in df.columns]
    return result.select(*cols, out)


def stream_ema(df: DataFrame, keys, order, cols, alpha: float, ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of ``series.ema``."""
    time_name = event_time_column(df)
    rows = df.select(*_group_columns(df, keys, order), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                     F.to_json(F.struct("*"), JSON_OPTIONS).alias("row_text"), *([F.col(time_name)] if time_name else []))
    schema = T.StructType([T.StructField("row_text", T.StringType())])
    for i in range(len(cols)):
        schema = schema.add(f"y{i}", T.DoubleType())
    if time_name:
        schema = schema.add(time_name, T.TimestampType())
    names = [f"ord{i}" for i in range(len(order))]
    result = _run(df, rows, _Ema(names, list(cols), alpha, time_name, ttl_ms), schema, time_name)
    result = result.withColumn("__r", F.from_json("row_text", df.schema, JSON_OPTIONS))
    own = [F.col(time_name) if c == time_name else F.col(f"__r.{c}").alias(c) for c in df.columns]
    return result.select(*own, *[F.col(f"y{i}").alias(f"{c}_ema") for i, c in enumerate(cols)])


class _Held(StatefulProcessor):
    """The merged partial state of a key and window, flushed when the watermark passes the window's end."""

    def __init__(self, agg, names):
        self.agg, self.names = agg, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("held", "state STRING")

    def handleInputRows(self, key, rows, timerValues):
        total = json.loads(self.value.get()[0]) if self.value.exists() else None
        fresh, end = total is None, None
        for pdf in rows:
            end = int(pdf["end_ms"].iloc[0])
            if end <= timerValues.getCurrentWatermarkInMs():
                return          # the window was flushed
            for text in pdf["state"]:
                state = json.loads(text)
                total = state if total is None else self.agg.merge(total, state)
        if total is not None:
            self.value.update((json.dumps(total),))
            if fresh:
                self.handle.registerTimer(end)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.value.exists():
            rows = self.agg.flush(json.loads(self.value.get()[0]))
            self.value.clear()
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=self.names)

    def close(self) -> None:
        pass


def held_states(parts: DataFrame, agg, schema: T.StructType) -> DataFrame:
    """Merge partial states of ``operators.aggregators`` on a stream; ``schema`` begins with the key."""
    _use_rocksdb(parts)
    rows = parts.groupBy("key_text", "end_ms").transformWithStateInPandas(_Held(agg, schema.names), schema, "Append", "EventTime")
    return rows
