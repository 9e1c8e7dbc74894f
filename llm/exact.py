"""Exact dedup: tree merge of sorted digest runs. DataFrame functions only.

Each document is reduced to a digest of its normalised text. Documents are dealt to ``fan ** levels`` runs by their
identifier; a run lies in cells, each a stretch of the digests, is sorted by digest and holds one row per distinct
text: the identifier that it keeps and how many rows it stands for. In each round ``fan`` neighbouring runs become one.
Their cells of the same stretch exchange: a stretch is split into ``fan`` shorter ones, and the rows of one of these
meet in one partition, where they are sorted by digest and equal digests, now neighbours, are merged into the row with
the required identifier. So the number of runs falls and that of stretches rises by ``fan`` a round, a partition holds
about as many rows as before, and after ``levels`` rounds one run, spread by digest, has one row per text. On the way
back each run learns the survivor from the run that it was merged into. A text that fills a third of the table has
one row in each run, so it loads no partition of a round more than others.

Verified: a digest is joined by a second hash and the length of the text; rows agree in all three or are not merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import free_name, stored

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGEST = ["_sha", "_check", "_length"]
# Runs merged at once, documents that a run is dealt, stretches of digests that a first run is cut into.
FAN, RUN_ROWS, STRETCHES = 4, 65_536, 256


def normalized(text: Column) -> Column:
    """A-Z in lower case, null as empty. Pure ASCII takes the faster ``lower``, with the same result."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def sorted_runs(rows: DataFrame, run: Column, stretches: int, pick: Callable[[Column], Column], real: Column) -> DataFrame:
    """Runs of rows (digest, ``_at``, ``_keep``, ``_n``) after an exchange by run and stretch: each sorted by digest, equal
    digests merged. ``_keep`` of the required kind wins, a null one only against none. The aggregate is a sorted merge, as
    what it keeps is a struct: it reads the sorted rows and holds one at a time."""
    moved = rows.withColumn("_run", run.cast("long")).withColumn("_stretch", F.call_function("shiftright", F.col("_at") * stretches, F.lit(32)))
    cells = moved.repartition("_run", "_stretch").sortWithinPartitions("_run", "_stretch", *DIGEST)
    merged = cells.groupBy("_run", "_stretch", *DIGEST).agg(F.first("_at").alias("_at"), pick(F.struct(real.alias("real"), "_keep")).alias("_best"), F.sum("_n").alias("_n"))
    return merged.select("_run", *DIGEST, "_at", F.col("_best._keep").alias("_keep"), "_n")


def merge_rounds(base: DataFrame, keep: str, fan: int, levels: int) -> list[DataFrame]:
    """The runs of every level, stored: first those of documents (``base``: digest, ``_at``, ``_id``, ``_run``), last one run."""
    pick, real = (F.max, F.col("_keep").isNotNull()) if keep == "largest" else (F.min, F.col("_keep").isNull())
    # Each task drops its own repeats before the first runs are sorted.
    own = (F.max if keep == "largest" else F.min)("_id")
    rows = base.groupBy("_run", *DIGEST).agg(F.first("_at").alias("_at"), own.alias("_keep"), F.count("*").alias("_n"))
    tree = [stored(sorted_runs(rows, F.col("_run"), STRETCHES, pick, real), "exact-runs")]
    for level in range(1, levels + 1):
        tree.append(stored(sorted_runs(tree[-1], F.floor(F.col("_run") / fan), STRETCHES * fan ** level, pick, real), "exact-runs"))
    return tree


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                 fan: int = FAN, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep``: "largest" or "smallest" identifier of equal texts stays. Null text counts as empty. Texts of any length
    are digested whole. Rows that repeat an identifier and a text count each in ``group_size`` and all carry the flag of
    their identifier; a null identifier is kept only where its group has no other. An empty table gives an empty
    result; other columns are not looked at, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("_id"), normalized(F.col(text_col)).alias("_text"))
    base = base.select("_id", F.unhex(F.sha2(F.col("_text"), 256)).alias("_sha"), F.xxhash64("_text").alias("_check"), F.octet_length("_text").alias("_length"))
    base = stored(base, "exact-digests")  # texts are read and digested once, though runs and joins use the digests
    rows, levels = base.count(), 1
    while fan ** levels * run_rows < rows:
        levels += 1
    base = base.withColumn("_at", F.conv(F.hex(F.substring("_sha", 1, 4)), 16, 10).cast("long")).withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(fan ** levels)))
    tree = merge_rounds(base, keep, fan, levels)
    known = tree[-1]
    for below in reversed([base, *tree[:-1]]):
        up = known.select(*[F.col(c).alias(f"u{c}") for c in (*DIGEST, "_run", "_keep", "_n")])
        parent = F.col("_run") if below is base else F.floor(F.col("_run") / fan).cast("long")
        same = [F.col(c) == F.col(f"u{c}") for c in DIGEST]
        ids = ["_id"] if below is base else []
        known = (below.select(*DIGEST, "_run", *ids).withColumn("_parent", parent)
                 .join(up, [*same, F.col("_parent") == F.col("u_run")])
                 .select(*DIGEST, "_run", *ids, F.col("u_keep").alias("_keep"), F.col("u_n").alias("_n")))
    return known.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
                        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Null and empty texts are one group. A row stays if its identifier is kept for some text of its own, so rows that repeat
    an identifier and a text all stay; null identifiers stay where no other has the text. Empty tables stay empty.
    """
    stay = free_name(docs, "stay")
    kept = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias(stay)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[stay]), "left_semi")
