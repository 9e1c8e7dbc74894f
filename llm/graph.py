"""Connected components of a link table by alternating large and small stars, for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex hands its larger (or smaller) neighbours to the least vertex it knows. Edges (u, v) with u > v."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
    joined = around.join(least, F.col("u") == F.col("_u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(joined.select("u", F.col("_m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(``doc_id``, ``component_id``) of every document that is linked to a smaller one; ``links`` has (a, b).

    Ends when a round changes nothing; raises if ``rounds`` don't suffice, so no result is ever partial.
    Every round is written to the shared folder, and a vertex with very many links is only ever a key of
    aggregates and of joins that Spark may split.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = stored(edges, "components")
    before = None
    for _ in range(rounds):
        edges = stored(_star(_star(edges, True), False), "components")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
        before = tuple(state)
    raise RuntimeError(f"components are not settled after {rounds} rounds")
