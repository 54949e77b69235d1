"""Joins that pick, exclude, compare and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each key in the given order, with ``keep`` and the number of rows; ties are equal in ``keep``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    one = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).select(*keys, *keep)
    n = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("deliveries"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return one.join(n, on).select(*keys, *keep, "deliveries")


def ladder(df: DataFrame, steps: list[tuple[str, Column]], ok: str = "accepted") -> DataFrame:
    """``df`` with the first reason whose condition holds; an unknown condition does not hold."""
    reason = None
    for name, bad in steps:
        bad = F.coalesce(bad, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return df.withColumn("reason", reason.otherwise(ok))


def exclusion_counts(df: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows that each exclusion source removes, in order, and the rest; sources are keyed ``k`` and may repeat or hold nulls."""
    x = df
    for i, (col, src) in enumerate(sources):
        k = src.select(F.col("k").alias(f"__k{i}")).where(F.col(f"__k{i}").isNotNull()).distinct()
        x = x.join(k, F.col(col) == F.col(f"__k{i}"), "left")
    reason = None
    for i, (col, _) in enumerate(sources):
        hit = F.col(f"__k{i}").isNotNull()
        reason = F.when(hit, f"known_{col}") if reason is None else reason.when(hit, f"known_{col}")
    return x.groupBy(reason.otherwise("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def overlap_matrix(df: DataFrame, group: str, key: str) -> DataFrame:
    """``a, b, shared, jaccard`` of the key sets of every two groups that share a key.

    The groups of one key become an array (there are few groups), so keys never pair up
    by rows; pairs are made of groups, not of keys.
    """
    d = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k")).distinct()
    size = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sets = d.groupBy("k").agg(F.array_sort(F.collect_set("g")).alias("gs"))
    pairs = sets.select(F.explode(F.flatten(F.transform("gs", lambda a: F.transform(F.filter("gs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    na, nb = size.select(F.col("g").alias("a"), F.col("n").alias("na")), size.select(F.col("g").alias("b"), F.col("n").alias("nb"))
    return pairs.join(na, "a").join(nb, "b").select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def interval_overlaps(df: DataFrame, by: list[str], key: str, start: str, length: str, slack: int) -> DataFrame:
    """Pairs of intervals of one group that meet within ``slack``, by equality on blocks of the number line.

    Each interval is entered in the blocks it reaches (padded), and a pair counts in the
    block of its later start only, so no group is crossed with itself as a whole.
    """
    block = 64
    a0, a1 = F.col(start), F.col(start) + F.greatest(F.col(length), F.lit(1)) - 1 + slack
    d = df.where(F.col(start).isNotNull()).select(*by, key, a0.alias("__s"), a1.alias("__e")).withColumn("__blk", F.explode(F.sequence(F.floor(F.col("__s") / block), F.floor(F.col("__e") / block))))
    x, y = d.alias("x"), d.alias("y")
    on = (F.col("x.__blk") == F.col("y.__blk")) & (F.col(f"x.{key}") < F.col(f"y.{key}"))
    for c in by:
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    meet = (F.col("x.__s") <= F.col("y.__e")) & (F.col("y.__s") <= F.col("x.__e")) & (F.col("x.__blk") == F.floor(F.greatest("x.__s", "y.__s") / block))
    return x.join(y, on).where(meet).select(*[F.col(f"x.{c}").alias(c) for c in by], F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"))
