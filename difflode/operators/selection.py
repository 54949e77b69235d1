"""Deterministic samples, quotas, bands, splits and pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from difflode.functions.scores import stable_key, stable_unit
from difflode.operators.ranking import rank_within
from difflode.plans.lineage import cut


def quota_sample(df: DataFrame, stratum: str, key: str, quota: int, seed: str) -> DataFrame:
    """The first ``quota`` rows of each stratum in the seed's hash order, with their rank.

    The limit is applied within map tasks before the shuffle, so a hot stratum costs no
    more than others. Null strata form one of their own.
    """
    w = Window.partitionBy(stratum).orderBy("__k", key)
    return df.withColumn("__k", stable_key(seed, F.col(key))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota).drop("__k")


def proportional_sample(df: DataFrame, stratum: str, key: str, share: float, seed: str) -> DataFrame:
    """From each stratum the floor of its share of rows, at least one, in hash order; strata of any size."""
    ranked = rank_within(df.withColumn("__k", stable_key(seed, F.col(key))), [stratum], [F.col("__k").asc(), F.col(key).asc()])
    n = df.groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    take = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(share)))
    return ranked.join(n, F.col(stratum).eqNullSafe(F.col("__s"))).where(F.col("rank") <= take).drop("__k", "__s", "__n")


def round_robin(df: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows taken in turn from the strata, each in hash order; the order of the turns is in ``position``."""
    few = quota_sample(df, stratum, key, size, seed)
    w = Window.orderBy("rank", F.col(stratum).asc_nulls_first(), key)
    return few.orderBy("rank", F.col(stratum).asc_nulls_first(), key).limit(size).withColumn("position", F.row_number().over(w))


def score_bands(df: DataFrame, group: str, key: str, score: str, bands: int) -> DataFrame:
    """Band ``min(bands - 1, i * bands div n)`` of each row by ascending score within its group; groups of any size."""
    ranked = rank_within(df.where(F.col(score).isNotNull() & ~F.isnan(score)), [group], [F.col(score).asc(), F.col(key).asc()])
    n = ranked.groupBy(F.col(group).alias("__g")).agg(F.max("rank").alias("__n"))
    i = F.col("rank") - 1
    return ranked.join(n, F.col(group).eqNullSafe(F.col("__g"))).withColumn("band", F.least(F.lit(bands - 1), F.floor(i * bands / F.col("__n"))).cast("int")).drop("__g", "__n", "rank")


def hash_split(unit: Column, ratios: list[tuple[str, float]], seed: str) -> Column:
    """The split of a key by its hash against cumulative ratios; no state, so re-runs agree."""
    u, low, out = stable_unit(seed, unit), 0.0, None
    for name, share in ratios:
        low += share
        out = F.when(u < low, name) if out is None else out.when(u < low, name)
    return out.otherwise(ratios[-1][0])


def neighbour_pairs(df: DataFrame, group: str, key: str, reach: int, seed: str, carry: list[str]) -> DataFrame:
    """Each row of a group with the next ``reach`` rows in hash order: at most ``reach`` pairs a row, never all pairs.

    Gives ``group, key_a, key_b`` and each carried column of both sides. Places in the
    order come from ranks over range partitions and pairs from an equality join on the
    place, so a group of any size spreads over the tasks.
    """
    d = df.where(F.col(group).isNotNull()).select(group, key, *carry).withColumn("__k", stable_key(seed, F.col(key)))
    ranked = cut(rank_within(d, [group], [F.col("__k").asc(), F.col(key).asc()], "__r").drop("__k"))
    a = ranked.select(group, F.col(key).alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in carry], F.explode(F.sequence(F.col("__r") + 1, F.col("__r") + reach)).alias("__r"))
    b = ranked.select(group, F.col(key).alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in carry], "__r")
    return a.join(b, [group, "__r"]).select(group, "key_a", "key_b", *[f"{c}_{x}" for c in carry for x in "ab"])


def bounded_pairs(df: DataFrame, group: str, key: str, attempts: int, seed: str, carry: list[str]) -> DataFrame:
    """The first ``attempts`` pairs of each group: pairs of rows in hash order, the first row with all later ones, then the second, and so on.

    Gives ``group, attempt, key_a, key_b`` and each carried column of both sides. A row's
    pairs follow from its rank and the size of its group, so only pairs within the bound are
    ever formed, by an equality join on ranks; a group of any size spreads over the tasks.
    """
    d = df.where(F.col(group).isNotNull()).select(group, key, *carry).withColumn("__k", stable_key(seed, F.col(key)))
    ranked = rank_within(d, [group], [F.col("__k").asc(), F.col(key).asc()], "__r").drop("__k")
    n = d.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    # no row beyond the bound can be in a pair
    near = cut(ranked.where(F.col("__r") <= attempts + 1).join(n, group))
    i = F.col("__r") - 1
    before = i * (F.col("__n") - 1) - (i * (i - 1) / 2).cast("long")
    many = F.least(F.col("__n") - F.col("__r"), F.lit(attempts) - before)
    a = near.withColumn("__before", before).withColumn("__many", many).where("__many > 0").withColumn("__o", F.explode(F.sequence(F.col("__r") + 1, F.col("__r") + F.col("__many"))))
    a = a.select(group, (F.col("__before") + F.col("__o") - F.col("__r") - 1).alias("attempt"), F.col(key).alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in carry], F.col("__o").alias("__r"))
    b = near.select(group, F.col(key).alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in carry], "__r")
    return a.join(b, [group, "__r"]).drop("__r")


def cascade_top_k(queries: DataFrame, pool: DataFrame, levels: list[str], k: int) -> DataFrame:
    """Top ``k`` pool rows for each query, filled level by level, never from the query's own repository.

    ``queries`` has ``query_id, repo`` and the level columns, ``pool`` has ``example_id,
    repo, score`` and the same columns. For each value of a level only the best ``2 k``
    rows with at most ``k`` of one repository are joined, which is enough for any query,
    so that a popular value never meets all its queries with all its examples.
    """
    out = None
    for n, level in enumerate(levels):
        best = Window.partitionBy(level, "repo").orderBy(F.col("score").desc_nulls_last(), "example_id")
        top = Window.partitionBy(level).orderBy(F.col("score").desc_nulls_last(), "example_id")
        own = pool.where(F.col(level).isNotNull()).withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k)
        own = own.withColumn("__t", F.row_number().over(top)).where(F.col("__t") <= 2 * k).select(F.col(level).alias("__v"), F.col("repo").alias("__repo"), "example_id", "score")
        hit = queries.where(F.col(level).isNotNull()).join(own, F.col(level) == F.col("__v")).where(~F.col("repo").eqNullSafe(F.col("__repo")))
        hit = hit.select("query_id", "example_id", "score", F.lit(n).alias("level"))
        out = hit if out is None else out.union(hit)
    first = out.groupBy("query_id", "example_id").agg(F.min("level").alias("level"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("level", F.col("score").desc_nulls_last(), "example_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "example_id", "level", "rank")
