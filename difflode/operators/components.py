"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflode.plans.lineage import cut


def _stars(pairs: DataFrame, keep: str) -> DataFrame:
    """Link the neighbours of each node to the smallest of them (and the node itself)."""
    low = pairs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    joined = pairs.join(low, "u")
    if keep == "large":
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("w").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("w").alias("v")).union(
            low.select("u", F.col("w").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = smallest node of it.

    Alternates the large-star and small-star steps until no edge changes. Both steps are
    a ``groupBy`` with a map-side minimum and a join, so a node with very many neighbours
    is never gathered into one row; adaptive execution splits its join partition. Null
    ends and loops are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    )
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "large")
        e = cut(_stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "small"))
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
