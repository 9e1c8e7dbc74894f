"""Read-only SQL over telemetry tables, with the operators as table functions.

``SELECT * FROM window_stats(TABLE(records), '10 seconds')`` stands for the operator applied to that table: the call is
put in as a view of the operator's own plan, so Catalyst optimises the statement as a whole and nothing runs in Python.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostpulse.operators import filters, pairing, profiles, rank, sched, series, stats

READ_ONLY = ("SELECT", "WITH", "EXPLAIN", "DESCRIBE", "DESC", "PRAGMA", "SHOW")


class NotReadOnly(PermissionError):
    pass


# Operators from tables and constants to a table.
TABLE_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "window_stats": stats.window_stats, "latest": stats.latest, "stage_latest": stats.stage_latest,
    "runqueue_latency": pairing.runqueue_latency, "offcpu_intervals": pairing.offcpu_intervals, "block_io_latency": pairing.block_io_latency,
    "pair_allocations": pairing.pair_allocations, "live_allocations": pairing.live_allocations, "connection_durations": pairing.connection_durations,
    "sched_stats": sched.sched_stats, "sched_history": sched.sched_history, "sched_summary": sched.sched_summary,
    "merge_stacks": profiles.merge_stacks, "window_profile": profiles.window_profile, "profile_counts": profiles.profile_counts,
    "attach_stacks": profiles.attach_stacks, "flame_tree": profiles.flame_tree, "function_totals": profiles.function_totals,
    "profile_diff": profiles.profile_diff, "cpu_utilization": series.cpu_utilization, "system_rates": series.system_rates,
    "process_cpu": series.process_cpu, "ema": series.ema, "filter_comm": filters.filter_comm, "distinct_values": rank.distinct_values,
}


def register_table_function(name: str, fn: Callable[..., DataFrame]) -> None:
    """Make a user operator ``fn(df, ..., **options)`` callable from SQL."""
    TABLE_FUNCTIONS[name.lower()] = fn


# Text that is read over as a whole: strings, quoted names, comments.
OPAQUE = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", re.S)
CALL = re.compile(r"(\w+)\s*\(\s*(?=TABLE\s*\()", re.I)


def _closing(text: str, start: int) -> tuple[int, list[int]]:
    """Where the parenthesis that opened before ``start`` closes, and the commas directly inside it."""
    depth, at, commas = 1, start, []
    while at < len(text):
        opaque = OPAQUE.match(text, at)
        if opaque:
            at = opaque.end()
            continue
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(text[at], 0)
        if not depth:
            return at, commas
        if text[at] == "," and depth == 1:
            commas.append(at)
        at += 1
    raise ValueError("a table function's parenthesis is not closed")


def _argument(spark: SparkSession, text: str, sub: Callable[[str], str]):
    """(name or None, value): a table by name or query, or a constant."""
    named = re.match(r"\s*(\w+)\s*=>\s*", text)
    body = (text[named.end():] if named else text).strip()
    table = re.fullmatch(r"(?is)TABLE\s*\((.*)\)", body)
    if table:
        inner = sub(table.group(1).strip())
        value = spark.table(inner) if re.fullmatch(r"[\w.`]+", inner) else _checked(spark, inner)
    else:
        value = spark.sql(f"SELECT {body} AS v").first()["v"]
    return (named.group(1) if named else None), value


def _checked(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM (\n{text}\n)")


def with_table_functions(spark: SparkSession, text: str) -> str:
    """``text`` with every call of a table function replaced by the name of a view of its result."""
    out, at = [], 0
    while at < len(text):
        opaque = OPAQUE.match(text, at)
        if opaque:
            out.append(opaque.group())
            at = opaque.end()
            continue
        call = CALL.match(text, at) if at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_.`") else None
        fn = TABLE_FUNCTIONS.get(call.group(1).lower()) if call else None
        if fn is None:
            out.append(text[at])
            at += 1
            continue
        end, commas = _closing(text, call.end())
        cuts = [call.end() - 1, *commas, end]
        given = [_argument(spark, text[a + 1:b], lambda t: with_table_functions(spark, t)) for a, b in zip(cuts, cuts[1:])]
        view = f"{call.group(1).lower()}_{uuid.uuid4().hex}"
        fn(*[v for k, v in given if k is None], **{k: v for k, v in given if k}).createOrReplaceTempView(view)
        out.append(view)
        at = end + 1
    return "".join(out)


def run_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Run one read-only statement; all rows unless ``limit`` is given, binary columns shown as ``[blob]``."""
    text = sql.strip().rstrip(";").strip()
    words = text.split(None, 1)
    if not words or words[0].upper() not in READ_ONLY:
        raise NotReadOnly("only SELECT, WITH, EXPLAIN and DESCRIBE statements are allowed")
    pragma = re.fullmatch(r"(?is)pragma\s+table_info\s*\(\s*['\"]?(\w+)['\"]?\s*\)", text)
    if pragma:
        text = f"DESCRIBE {pragma.group(1)}"
    elif words[0].upper() == "PRAGMA":
        raise NotReadOnly("only PRAGMA table_info is supported")
    if words[0].upper() in ("SELECT", "WITH"):
        # as a subquery a statement can only read, whatever follows its first keyword
        df = _checked(spark, with_table_functions(spark, text))
    else:
        df = spark.sql(text)
    # the last of equally named columns wins
    kinds = [t for _, t in df.dtypes]
    last = {name: i for i, name in enumerate(df.columns)}
    plain = df.toDF(*[f"c{i}" for i in range(len(kinds))])
    shown = [(F.when(F.col(f"c{i}").isNotNull(), F.lit("[blob]")) if kinds[i] == "binary" else F.col(f"c{i}")).alias(name)
             for name, i in last.items()]
    shown = plain.select(*shown)
    return shown if limit is None else shown.limit(limit)


def register_views(spark: SparkSession, base: str | None = None, tables: dict[str, DataFrame] | None = None) -> list[str]:
    """Temp views for stored tables under ``base`` and for given DataFrames."""
    names = []
    if base is not None:
        for name in ("records", "stack_samples", "profiles"):
            path = f"{base.rstrip('/')}/{name}"
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
                spark.read.parquet(path).createOrReplaceTempView(name)
                names.append(name)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
        names.append(name)
    return names
