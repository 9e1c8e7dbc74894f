"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Each source has an expected number of copies per document, target / size. The expected copies are summed
along the source (a prefix sum); one offset per source shifts the sum, and a document is emitted once per
integer boundary that its step crosses. Documents are ordered by size class, so every stretch of the sum holds
its share of each size and the words taken come near the target.

The prefix sum is built from three bounded levels: rank within (source, size class, slice), slices of a size
class, size classes of a source. A source with a third of all rows is thus spread over classes and slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import WORD, free_name, stored

WEIGHTS = (3, 1, 2)
TIMES, CAP, SLICES = 1.5, 2, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point with null last, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def size_class(size: Column) -> Column:
    """Eight classes per doubling, in whole numbers: bit length and the three bits after the first."""
    bits = F.length(F.bin(size + 1))
    return (bits * 8 + F.call_function("shiftright", (size + 1) * 8, bits - 1)).cast("int")


def id_slice(key: Column, slices: int) -> Column:
    """A slice by a hash of the id, so that ids of any pattern spread."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % slices, F.lit(0)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: float = TIMES, cap: int = CAP) -> DataFrame:
    """Per ``_src``: ``source_size`` and ``target``, from rows (``_src``, ``size``).

    Targets are ``weight * level`` up to ``cap`` times the size. The level is found in closed form: in order of
    size per weight, sources are full until the rest shares what is left below its own cap. The windows run over
    one row per source.
    """
    per = sizes.groupBy("_src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("_src")
    pattern = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", pattern.cast("long"))
    by_fill = Window.orderBy((F.col("source_size") / F.col("_w")), "_src")
    everything = Window.partitionBy(F.lit(1))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_all", F.sum("_w").over(everything))
           .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
           .withColumn("_used", F.coalesce(F.sum("_w").over(before), F.lit(0))))
    per = per.withColumn("_level", (F.col("_total") * F.lit(float(times)) - F.col("_full") * cap) / (F.col("_all") - F.col("_used")))
    # The first source that its cap does not bind gives the level of all after it.
    free = F.when(F.col("_level") * F.col("_w") <= F.col("source_size") * cap, F.struct(F.col("_full"), F.col("_used"), F.col("_level")))
    per = per.withColumn("_level", F.min(free).over(everything)["_level"])
    return per.select("_src", "source_size", F.least(F.coalesce(F.col("_level") * F.col("_w"), (F.col("source_size") * cap).cast("double")),
                                                     (F.col("source_size") * cap).cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: float = TIMES, cap: int = CAP, seed: str = "mix",
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slices: int = SLICES) -> DataFrame:
    """Per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``, ``copies`` and the columns of ``docs`` named id.

    Null text has size 0; null source is a source of its own, last in order. A document of size 0 takes
    part with 0 words. Rows that repeat an identifier are sampled each. Empty tables give empty results.
    The offset of a source is derived from ``seed`` and its name, so reruns agree.
    """
    base = docs.select(F.col(id_col).alias("_id"), source_key(F.col(source_col)).alias("_src"), n_words(F.col(text_col)).alias("size"))
    base = stored(base, "mixing-sizes")  # texts are read once, though targets, cells and ranks use the sizes
    targets = source_targets(base.select("_src", "size"), weights, times, cap)
    base = base.withColumn("_class", size_class(F.col("size"))).withColumn("_slice", id_slice(F.col("_id"), slices))
    cells = base.groupBy("_src", "_class", "_slice").agg(F.count("*").alias("_n"))
    classes = cells.groupBy("_src", "_class").agg(F.sum("_n").alias("_n"))
    classes = classes.select(F.col("_src").alias("c_src"), F.col("_class").alias("c_class"),
                             F.coalesce(F.sum("_n").over(Window.partitionBy("_src").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)),
                                        F.lit(0)).alias("c_before"))
    cells = cells.withColumn("_in", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_src", "_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = (cells.join(classes, (F.col("_src") == F.col("c_src")) & (F.col("_class") == F.col("c_class")))
             .select(F.col("_src").alias("c_src"), F.col("_class").alias("c_class"), F.col("_slice").alias("c_slice"),
                     (F.col("_in") + F.col("c_before")).alias("_before")))
    targets = targets.select(F.col("_src").alias("t_src"), "source_size", "target")
    cells = cells.join(targets, F.col("c_src") == F.col("t_src")).drop("t_src")
    ranked = base.withColumn("_rank", F.row_number().over(Window.partitionBy("_src", "_class", "_slice").orderBy("size", "_id")))
    out = ranked.join(cells, (F.col("_src") == F.col("c_src")) & (F.col("_class") == F.col("c_class")) & (F.col("_slice") == F.col("c_slice")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_src")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    upto = F.col("_before") + F.col("_rank")
    copies = F.least(F.floor(upto * step + offset) - F.floor((upto - 1) * step + offset), F.lit(cap))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
                      copies.cast("int").alias("copies"))


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies, with all its columns, whatever their names.

    Null and empty texts are taken as the mix takes documents without words, and add none; a null source is a source of
    its own. Rows that repeat an identifier share the copies that all of them together get, the first rows by source and
    size one more each where these don't divide; an empty table stays empty.
    """
    key, src, size, copies, place, share = (free_name(docs, n) for n in ("mixed", "mixed_source", "mixed_size", "copies", "place", "share"))
    taken = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    per = taken.groupBy(F.col(id_col).alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(share))
    several = per.where(F.col(share) > 1)
    once = docs.join(per.where((F.col(share) == 1) & (F.col(copies) > 0)), docs[id_col].eqNullSafe(F.col(key)))
    once = once.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
    if several.isEmpty():
        return once
    # Rows of repeated ids, few or none in sound data, are numbered within their id.
    again = docs.join(several, docs[id_col].eqNullSafe(F.col(key)))
    again = again.withColumn(src, source_key(F.col(f"`{source_col}`"))).withColumn(size, n_words(F.col(f"`{text_col}`")))
    again = again.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(src, size, F.xxhash64(f"`{text_col}`"))))
    own = F.floor(F.col(copies) / F.col(share)) + (F.col(place) <= F.col(copies) % F.col(share)).cast("int")
    again = again.withColumn(share, own).where(F.col(share) > 0).withColumn(place, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(share))))
    return once.unionByName(again.select(*[F.col(f"`{c}`") for c in docs.columns]))
