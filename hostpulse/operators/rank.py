"""Rankings and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _limited(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def rank_processes(df: DataFrame, by: str = "cpu", n: int | None = None) -> DataFrame:
    """By total cpu (descending), numeric pid, or comm."""
    ties = [F.col("pid").cast("bigint"), *[F.col(c) for c in ("host", "ts") if c in df.columns]]
    first = {"cpu": [F.col("cpu_total_pct").desc()], "pid": [], "comm": [F.col("comm")]}
    return _limited(df.orderBy(*first[by], *ties), n)


def rank_sched(df: DataFrame, by: str = "switches", n: int | None = None) -> DataFrame:
    """By switches, average latency or migrations, all descending."""
    key = {"switches": "switch_count", "latency": "avg_runqueue_latency_us", "migrations": "migrate_count"}[by]
    ties = [c for c in ("pid", "host", "window_ns") if c in df.columns]
    return _limited(df.orderBy(F.col(key).desc(), *ties), n)


def top_migrations(df: DataFrame, n: int = 30) -> DataFrame:
    return rank_sched(df.where(F.col("migrate_count") > 0), "migrations", n)


def rank_diff(diff: DataFrame, by: str = "diff", text: str | None = None, n: int = 100) -> DataFrame:
    """Largest relative change first (or by name), optionally only names containing ``text``."""
    if text:
        diff = diff.where(F.lower("name").contains(text.lower()))
    change = F.abs((F.col("comp_value") - F.col("base_value")) / F.greatest("base_value", F.lit(1)))
    order = [change.desc(), F.col("name")] if by == "diff" else [F.col("name")]
    return diff.orderBy(*order).limit(n)


def top_wakeups(edges: DataFrame, n: int = 30) -> DataFrame:
    return edges.orderBy(F.col("count").desc(), "waker", "wakee").limit(n)


def distinct_values(dfs, cols) -> DataFrame:
    """Distinct rows of ``cols`` over several tables."""
    return reduce(DataFrame.unionByName, [d.select(*cols) for d in dfs]).distinct()


def union_pipelines(dfs) -> DataFrame:
    """All rows of all tables; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
