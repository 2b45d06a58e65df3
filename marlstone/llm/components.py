"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round only groups to a minimum and joins it back, so no task gathers a node's neighbours;
a star of any size is left to adaptive execution's skew handling.  Each round is written to the
shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import materialize


def _star(edges: DataFrame) -> DataFrame:
    """One large-star then the rows a small-star needs, as (u, v) with u > v."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # large star: neighbours above u hang on u's minimum
    large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.where(F.col("u") != F.col("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Small-star: neighbours below u, and u itself, hang on the lowest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return out.select("e.*").where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; component is the smallest node.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, last = materialize(edges, "edges"), None
    for _ in range(max_rounds):
        edges = materialize(_small(_star(edges)), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionAll(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
