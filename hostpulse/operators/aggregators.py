"""User aggregators: add rows, merge partial states, flush results.

A state is any value that JSON can hold.  Tasks add their own rows first, key by key, and hand on one partial state per
key; partial states are merged in two steps (within a slice of tasks, then over slices), so a key that holds a third of
all rows brings a task no more than a few states.  On a stream the same partial states are merged into keyed state, and
a window is flushed when the watermark passes its end.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from hostpulse.functions import columns as C
from hostpulse.streaming.stateful import JSON_OPTIONS, held_states

# Partial states that a task holds before it hands them on; slices of tasks in the first merge.
HELD, SLICES = 20_000, 32


class Aggregator:
    """Override all four; ``columns`` are read next to the keys, ``schema`` names what ``flush`` gives.

    Adding in any order and merging in any grouping must give the same result.
    """

    columns: tuple[str, ...] = ()
    schema: str = ""

    def zero(self):
        raise NotImplementedError

    def add(self, state, rows: pd.DataFrame):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def flush(self, state) -> list[tuple]:
        raise NotImplementedError


def _partials(df: DataFrame, agg: Aggregator, keys, window, time) -> DataFrame:
    """``key_text``, ``end_ms``, ``part`` and ``state``: of each task, a state per key."""
    named = [F.col(k) for k in keys]
    end = F.lit(None).cast("bigint")
    if window:
        size = C.duration_ns(window)
        start = C.floor_to((F.unix_micros(time) * 1000), size)
        named.append(start.alias("window_ns"))
        end = C.int_div(start + size, 1_000_000)
    rows = df.select(F.to_json(F.struct(*named), JSON_OPTIONS).alias("key_text"), end.alias("end_ms"),
                     F.pmod(F.spark_partition_id(), F.lit(SLICES)).alias("part"), *agg.columns)

    def run(chunks):
        held: dict = {}

        def out():
            if held:
                yield pd.DataFrame([(k, e, p, json.dumps(s)) for (k, e, p), s in held.items()],
                                   columns=["key_text", "end_ms", "part", "state"]).astype({"end_ms": "Int64"})
                held.clear()
        for pdf in chunks:
            for (key, part), group in pdf.groupby(["key_text", "part"], sort=False):
                at = (key, None if pd.isna(group["end_ms"].iloc[0]) else int(group["end_ms"].iloc[0]), int(part))
                held[at] = agg.add(held[at] if at in held else agg.zero(), group[list(agg.columns)])
            if len(held) > HELD:
                yield from out()
        yield from out()
    return rows.mapInPandas(run, "key_text STRING, end_ms BIGINT, part INT, state STRING")


def _merged(agg: Aggregator, states):
    total = None
    for text in states:
        state = json.loads(text)
        total = state if total is None else agg.merge(total, state)
    return total


def aggregate(df: DataFrame, agg: Aggregator, keys, window: str | None = None, time: str = "ts") -> DataFrame:
    """Results of ``agg`` per key (and ``window_ns`` where ``window`` is given); a stream needs a window and a watermark on ``time``."""
    keys = list(keys)
    key_type = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    if window:
        key_type = key_type.add("window_ns", T.LongType())
    elif df.isStreaming:
        raise ValueError("a user aggregator on a stream needs a window, at whose end it is flushed")
    parts = _partials(df, agg, keys, window, time)
    result = T.StructType([T.StructField("key_text", T.StringType()), *T._parse_datatype_string(agg.schema).fields])
    if df.isStreaming:
        out = held_states(parts, agg, result)
    else:
        def first(pdf):
            return pd.DataFrame({"key_text": pdf["key_text"].iloc[:1], "state": [json.dumps(_merged(agg, pdf["state"]))]})

        def last(pdf):
            rows = agg.flush(_merged(agg, pdf["state"]))
            return pd.DataFrame([(pdf["key_text"].iloc[0], *r) for r in rows], columns=result.names)
        sliced = parts.groupBy("key_text", "part").applyInPandas(first, "key_text STRING, state STRING")
        out = sliced.groupBy("key_text").applyInPandas(last, result)
    key = F.from_json("key_text", key_type, JSON_OPTIONS).alias("__k")
    return out.select(key, *result.names[1:]).select("__k.*", *result.names[1:])
