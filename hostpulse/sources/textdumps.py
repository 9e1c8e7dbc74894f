"""Parsers for captured kernel text files, one row per line in column ``value``.

Columns other than ``value`` (host, ts, pid, line number ...) pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostpulse.functions import columns as C
from hostpulse.schemas import CPU_STATES

CPU_LINE = r"^cpu[ 0-9]"
MAPS_LINE = (r"^\s*([0-9a-fA-F]+)-([0-9a-fA-F]+)\s+(\S{1,7})\s+([0-9a-fA-F]+)\s+(\S{1,15})\s+(\d+)"
             r"(?:[ \t]+(.*?))?$")
KALLSYMS_LINE = r"^\s*([0-9a-fA-F]+)\s+(\S)\s+(\S{1,511})"


def _others(df: DataFrame, *drop) -> list[str]:
    return [c for c in df.columns if c != "value" and c not in drop]


def parse_proc_stat(lines: DataFrame, keys=("host", "ts")) -> tuple[DataFrame, DataFrame]:
    """Stat dumps to (cpu counters, system counters)."""
    keep = _others(lines)
    words = F.split(F.trim("value"), r"\s+")
    cpu = lines.where(F.col("value").rlike(CPU_LINE)).select(
        *keep, words[0].alias("cpu"),
        *[F.coalesce(F.try_element_at(words, F.lit(i + 2)).try_cast("bigint"), F.lit(0)).alias(s)
          for i, s in enumerate(CPU_STATES)])
    wanted = ("ctxt", "intr", "procs_running", "procs_blocked")
    name = F.split_part("value", F.lit(" "), F.lit(1))
    number = F.split_part("value", F.lit(" "), F.lit(2)).try_cast("bigint")
    system = (lines.where(name.isin(*wanted)).select(*keys, name.alias("__name"), number.alias("__n"))
              .groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == w, F.col("__n"))).alias(w) for w in wanted]))
    return cpu, system


def parse_proc_maps(lines: DataFrame) -> DataFrame:
    """Maps dumps to address ranges; malformed lines and maps without an absolute path are dropped."""
    part = lambda i: F.regexp_extract("value", MAPS_LINE, i)
    path = F.ltrim(part(7))
    return (lines.where(F.col("value").rlike(MAPS_LINE)).select(
        *_others(lines), C.parse_hex(part(1)).alias("start"), C.parse_hex(part(2)).alias("end"),
        C.parse_hex(part(4)).alias("offset"), path.alias("path")).where(F.col("path").startswith("/")))


def parse_kallsyms(lines: DataFrame) -> DataFrame:
    """Kernel symbol dumps; only code symbols are kept."""
    part = lambda i: F.regexp_extract("value", KALLSYMS_LINE, i)
    return (lines.where(F.col("value").rlike(KALLSYMS_LINE)).select(
        *_others(lines), C.parse_hex(part(1)).alias("address"), part(2).alias("type"), part(3).alias("name"))
        .where(F.col("type").isin("t", "T", "w", "W")))
