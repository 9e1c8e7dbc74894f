"""Ordered-sequence primitives that keep working when one key holds most of the rows.

A plain ``lag`` over ``partitionBy(key)`` puts a whole key into one task.  Here every key is cut
into *slices* along its order (time buckets, address ranges), rows are windowed per (key, slice),
and what must cross a slice border travels as one *seed row* per (key, slice):

1. one pre-aggregated edge row per (key, slice);
2. a window over those edges only (their number is the number of slices, not of rows);
3. the seeds are unioned to the rows, and a window per (key, slice) does the rest.

So the data is shuffled once, on (key, slice), and no task sees more than one slice of a key.
The shuffle after each union is explicit: windows must not rely on the partitioning of a union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostpulse.functions import columns as C

_SLICE, _SEED, _PAYLOAD, _EDGE = "__slice", "__seed", "__payload", "__edge"

# Spark limits rows before the shuffle for row_number() <= n up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT = 1000


def with_neighbor(df: DataFrame, keys, order, carry, out: str, slice_by: Column | None = None,
                  forward: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """Add struct column ``out``: columns ``carry`` of the previous (or next) row of the key.

    ``order`` must be a total order within a key; ``slice_by`` must be monotone in it.  On a stream the
    previous row is kept as keyed state (for ``ttl_ms`` if given), so every operator built on this runs on
    streams unchanged.
    """
    keys, order = list(keys), list(order)
    if df.isStreaming:
        if forward:
            raise ValueError("a stream has no next row; use the batch form")
        from hostpulse.streaming.stateful import previous_row
        return previous_row(df, keys, order, carry, out, ttl_ms)
    shift = F.lead if forward else F.lag
    payload = F.struct(*carry)
    if slice_by is None:
        return df.withColumn(out, shift(payload).over(Window.partitionBy(*keys).orderBy(*order)))

    rows = df.withColumn(_SLICE, slice_by)
    pick = F.min_by if forward else F.max_by
    edges = rows.groupBy(*keys, _SLICE).agg(pick(payload, F.struct(*order)).alias(_EDGE))
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    seeds = (edges.withColumn(_PAYLOAD, shift(_EDGE).over(across)).where(F.col(_PAYLOAD).isNotNull())
             .select(*keys, _SLICE, _PAYLOAD, F.lit(True).alias(_SEED)))
    both = (rows.withColumn(_PAYLOAD, payload).withColumn(_SEED, F.lit(False))
            .unionByName(seeds, allowMissingColumns=True).repartition(*keys, _SLICE))
    # False sorts before True: the seed stands first for lag, last for lead.
    seed_rank = F.col(_SEED).asc() if forward else F.col(_SEED).desc()
    within = Window.partitionBy(*keys, _SLICE).orderBy(seed_rank, *order)
    return (both.withColumn(out, shift(_PAYLOAD).over(within)).where(~F.col(_SEED))
            .drop(_SLICE, _PAYLOAD, _SEED))


def with_neighbors(df: DataFrame, keys, order, carry, before: str, after: str, slice_by: Column) -> DataFrame:
    """Structs ``before`` and ``after`` (previous and next row of the key) from a single shuffle."""
    keys, order = list(keys), list(order)
    payload, at = F.struct(*carry), F.struct(*order)
    rows = df.withColumn(_SLICE, slice_by)
    edges = rows.groupBy(*keys, _SLICE).agg(F.min_by(payload, at).alias("__first"), F.max_by(payload, at).alias("__last"))
    across = Window.partitionBy(*keys).orderBy(_SLICE)
    # seed position -1 stands before the rows of a slice, 1 after them
    borders = edges.withColumn("__b", F.lag("__last").over(across)).withColumn("__a", F.lead("__first").over(across))
    seeds = borders.select(*keys, _SLICE, F.inline(F.array(
        F.struct(F.lit(-1).alias(_SEED), F.col("__b").alias(_PAYLOAD)),
        F.struct(F.lit(1).alias(_SEED), F.col("__a").alias(_PAYLOAD))))).where(F.col(_PAYLOAD).isNotNull())
    both = (rows.withColumn(_PAYLOAD, payload).withColumn(_SEED, F.lit(0))
            .unionByName(seeds, allowMissingColumns=True).repartition(*keys, _SLICE))
    within = Window.partitionBy(*keys, _SLICE).orderBy(_SEED, *order)
    return (both.withColumn(before, F.lag(_PAYLOAD).over(within)).withColumn(after, F.lead(_PAYLOAD).over(within))
            .where(F.col(_SEED) == 0).drop(_SLICE, _PAYLOAD, _SEED))


def asof(points: DataFrame, marks: DataFrame, by, point: str, mark: str, carry, out: str,
         slice_width: int | None = None, direction: str = "backward") -> DataFrame:
    """Add struct ``out``: ``carry`` of the mark nearest at or before (``forward``: at or after) ``point``.

    ``by`` columns exist on both sides.  Ties between marks at one position: the greatest (forward:
    least) payload wins, so results do not depend on row order.
    """
    by = list(by)
    left = points.withColumn("__x", ordinal(points, point)).withColumn("__mark", F.lit(False))
    right = marks.select(*by, ordinal(marks, mark).alias("__x"), F.struct(*carry).alias(_PAYLOAD),
                         F.lit(True).alias("__mark"))
    both = left.unionByName(right, allowMissingColumns=True)
    back = direction == "backward"

    def ordering(*first):
        # at equal position marks come before points in either direction
        x = F.col("__x").asc() if back else F.col("__x").desc()
        p = F.col(_PAYLOAD).asc() if back else F.col(_PAYLOAD).desc()
        return [*first, x, F.col("__mark").desc(), p]

    latest = F.last(_PAYLOAD, ignorenulls=True)
    if slice_width is None:
        both = both.repartition(*by)
        w = Window.partitionBy(*by).orderBy(*ordering()).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(out, latest.over(w)).where(~F.col("__mark")).drop("__x", "__mark", _PAYLOAD)

    cell = F.call_function("div", F.col("__x"), F.lit(slice_width).cast("bigint"))
    # the last mark of every slice that has some, chained over slices to those that hold points: a row per slice
    pick = F.max_by if back else F.min_by
    edges = right.withColumn(_SLICE, cell).groupBy(*by, _SLICE).agg(pick(_PAYLOAD, F.struct("__x", _PAYLOAD)).alias(_EDGE))
    needed = left.select(*by, cell.alias(_SLICE)).distinct().withColumn("__need", F.lit(True))
    step = F.col(_SLICE).asc() if back else F.col(_SLICE).desc()
    across = Window.partitionBy(*by).orderBy(step).rangeBetween(Window.unboundedPreceding, -1)
    seeds = (needed.unionByName(edges, allowMissingColumns=True).repartition(*by)
             .withColumn(_PAYLOAD, F.last(_EDGE, ignorenulls=True).over(across)).where(F.col("__need") & F.col(_PAYLOAD).isNotNull())
             .select(*by, _SLICE, _PAYLOAD, F.lit(True).alias("__mark"), F.lit(True).alias(_SEED)))
    both = (both.withColumn(_SLICE, cell).withColumn(_SEED, F.lit(False))
            .unionByName(seeds, allowMissingColumns=True).repartition(*by, _SLICE))
    # the slice first: rows are sorted by number before they are compared by key
    within = Window.partitionBy(_SLICE, *by).orderBy(*ordering(F.col(_SEED).desc())).rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn(out, latest.over(within)).where(~F.col("__mark"))
            .drop("__x", "__mark", _PAYLOAD, _SLICE, _SEED))


def asof_both(points: DataFrame, marks: DataFrame, by, point: str, mark: str, carry, before: str, after: str,
              slice_width: int) -> DataFrame:
    """Structs ``before`` and ``after``: marks nearest at or below and at or above ``point``, from one shuffle."""
    by = list(by)
    left = points.withColumn("__x", ordinal(points, point)).withColumn("__mark", F.lit(False))
    right = marks.select(*by, ordinal(marks, mark).alias("__x"), F.struct(*carry).alias(_PAYLOAD),
                         F.lit(True).alias("__mark"))
    cell = F.call_function("div", F.col("__x"), F.lit(slice_width).cast("bigint"))
    at = F.struct("__x", _PAYLOAD)
    edges = (right.withColumn(_SLICE, cell).groupBy(*by, _SLICE)
             .agg(F.max_by(_PAYLOAD, at).alias("__last"), F.min_by(_PAYLOAD, at).alias("__first")))
    needed = left.select(*by, cell.alias(_SLICE)).distinct().withColumn("__need", F.lit(True))
    borders = needed.unionByName(edges, allowMissingColumns=True).repartition(*by)
    earlier = Window.partitionBy(*by).orderBy(F.col(_SLICE).asc()).rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.col(_SLICE).desc()).rangeBetween(Window.unboundedPreceding, -1)
    borders = (borders.withColumn("__b", F.last("__last", ignorenulls=True).over(earlier))
               .withColumn("__a", F.last("__first", ignorenulls=True).over(later)).where(F.col("__need")))
    # seed position -1 stands before the rows of a slice, 1 after them
    seeds = borders.select(*by, _SLICE, F.lit(True).alias("__mark"), F.inline(F.array(
        F.struct(F.lit(-1).alias(_SEED), F.col("__b").alias(_PAYLOAD)),
        F.struct(F.lit(1).alias(_SEED), F.col("__a").alias(_PAYLOAD))))).where(F.col(_PAYLOAD).isNotNull())
    both = (left.unionByName(right, allowMissingColumns=True).withColumn(_SLICE, cell).withColumn(_SEED, F.lit(0))
            .unionByName(seeds, allowMissingColumns=True).repartition(*by, _SLICE))
    marks_first = F.col("__mark").desc()
    up = Window.partitionBy(*by, _SLICE).orderBy(F.col(_SEED).asc(), F.col("__x").asc(), marks_first, F.col(_PAYLOAD).asc())
    down = Window.partitionBy(*by, _SLICE).orderBy(F.col(_SEED).desc(), F.col("__x").desc(), marks_first,
                                                   F.col(_PAYLOAD).desc())
    latest = F.last(_PAYLOAD, ignorenulls=True)
    return (both.withColumn(before, latest.over(up.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn(after, latest.over(down.rowsBetween(Window.unboundedPreceding, 0)))
            .where(~F.col("__mark")).drop("__x", "__mark", _PAYLOAD, _SLICE, _SEED))


def ordinal(df: DataFrame, name: str, more: int = 0) -> Column:
    """Sort position of a column (plus ``more``): unsigned addresses become BIGINT in the same order (cheap to sort)."""
    if not df.schema[name].dataType.typeName().startswith("decimal"):
        return F.col(name) + more if more else F.col(name)
    return (F.col(name).cast("decimal(21,0)") - F.lit(str(2**63 - more)).cast("decimal(21,0)")).cast("bigint")


def rank_in_order(df: DataFrame, keys, order, slice_by: Column, out: str) -> DataFrame:
    """Dense 0-based position of each row within its key (or globally for no keys), slice by slice.

    Only per-slice row counts meet in one place; the rows themselves stay in their slices.
    """
    keys = list(keys)
    rows = df.withColumn(_SLICE, slice_by)
    sizes = rows.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("__n"))
    across = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, _SLICE, F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    ranked = rows.withColumn("__rn", F.row_number().over(within).cast("bigint") - 1)
    joined = ranked.join(offsets, [*keys, _SLICE])
    return joined.withColumn(out, F.col("__rn") + F.col("__offset")).drop(_SLICE, "__rn", "__offset")


def top_per_key(df: DataFrame, keys, order, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key in ``order`` (a total order).

    Up to 1000 rows Spark drops surplus rows before the shuffle (WindowGroupLimit).  Beyond that the
    key is first thinned in salted parts, which is exact: the top n of a key are in the top n of
    their part.
    """
    keys = list(keys)
    if n > _GROUP_LIMIT:
        hashable = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        salt = F.pmod(F.xxhash64(*hashable), F.lit(64))
        parts = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (df.withColumn("__salt", salt).withColumn("__rn", F.row_number().over(parts))
              .where(F.col("__rn") <= n).drop("__salt", "__rn"))
    rn = rank or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rn) <= n)
    return out if rank else out.drop(rn)

