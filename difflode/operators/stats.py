"""Distributions, references, clusters of scores and intervals by resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from difflode.operators.ranking import rank_within, running_sums
from difflode.plans.lineage import cut


def prevalence_z(df: DataFrame, col: str) -> DataFrame:
    """Share of each value and its z-score over the distinct values (population deviation, floor 1e-9)."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    a = g.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    return g.join(a, F.lit(True)).select(col, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round((F.col("n") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(1e-9)), 6).alias("z"))


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and population deviation of each group, and the z-score of its mean against all rows."""
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    a = d.agg(F.avg(value).alias("gm"), F.stddev_pop(value).alias("gs"))
    return g.join(a, F.lit(True)).select(group, "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round((F.col("m") - F.col("gm")) / (F.col("gs") + 1e-9), 6).alias("z"))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, n, median``: the exact median of each group, of any size, from ranks; groups of null form one of their own."""
    own = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias(value)).withColumn("__id", F.monotonically_increasing_id())
    ranked = rank_within(own, [group], [F.col(value).asc(), F.col("__id").asc()])
    n = ranked.groupBy(F.col(group).alias("__g")).agg(F.max("rank").alias("n"))
    mid = (F.col("rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("rank") == F.ceil((F.col("n") + 1) / 2))
    return ranked.join(n, F.col(group).eqNullSafe(F.col("__g"))).where(mid).groupBy(group).agg(F.max("n").alias("n"), F.avg(value).alias("median"))


def median_mad(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median and median absolute deviation of each group, both exact; null and NaN values are left out."""
    d = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(group, value)
    m = medians(d, group, value)
    x = d.join(m.select(F.col(group).alias("__m"), "median"), F.col(group).eqNullSafe(F.col("__m"))).select(group, F.abs(F.col(value) - F.col("median")).alias("__d"))
    mad = medians(x, group, "__d").select(F.col(group).alias("__m"), F.col("median").alias("mad"))
    return m.join(mad, F.col(group).eqNullSafe(F.col("__m"))).select(F.col(group).alias("grp"), "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def tvd(df: DataFrame, group: str, value: str) -> DataFrame:
    """``a, b, distance``: half the absolute difference of the value distributions of every two groups."""
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    c = d.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(group))).select(F.col(group).alias("g"), F.col(value).alias("v"), "p")
    gs, vs = p.select("g").distinct(), p.select("v").distinct()
    full = gs.join(vs, F.lit(True)).join(p, ["g", "v"], "left").select("g", "v", F.coalesce("p", F.lit(0.0)).alias("p"))
    a, b = full.alias("a"), full.alias("b")
    x = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.g") < F.col("b.g")))
    return x.groupBy(F.col("a.g").alias("a"), F.col("b.g").alias("b")).agg(F.round(F.sum(F.abs(F.col("a.p") - F.col("b.p"))) / 2, 6).alias("distance"))


def coverage_curve(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows of each group at each value, and the share at or below it."""
    c = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    run = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select(group, F.col(value).alias("k"), "n", F.round(F.sum("n").over(run) / F.sum("n").over(w), 6).alias("coverage"))


def kmeans_bounds(df: DataFrame, value: str, k: int, rounds: int = 60) -> DataFrame:
    """Centres of one-dimensional k-means and the bounds half way between them.

    Lloyd's rule from nearest-rank starts until nothing moves; a round is one aggregate,
    whose ``k`` counts and sums only come to the driver. Null and NaN are left out; an
    empty table gives no row, and a cluster that loses all values keeps its centre.
    """
    spark = df.sparkSession
    d = cut(df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = d.agg(F.sum("n")).first()[0]
    schema = "centre_no int, centre double, upper_bound double"
    if not total:
        return spark.createDataFrame([], schema)
    at = [-(-(2 * i + 1) * total // (2 * k)) for i in range(k)]
    cum = running_sums(d, [F.col("v").asc()], {"upto": "n"})
    start = cum.agg(*[F.min(F.when(F.col("upto") >= a, F.col("v"))).alias(f"c{i}") for i, a in enumerate(at)]).first()
    c = [float(x) for x in start]
    for _ in range(rounds):
        nearest = F.array_min(F.array(*[F.struct(F.abs(F.col("v") - x).alias("d"), F.lit(i).alias("i")) for i, x in enumerate(c)]))["i"]
        means = {r["i"]: r["m"] for r in d.groupBy(nearest.alias("i")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).collect()}
        new = [float(means.get(i, x)) for i, x in enumerate(c)]
        moved = max(abs(a - b) for a, b in zip(new, c))
        c = new
        if moved < 1e-9:
            break
    rows = [(i, round(c[i], 6), round((c[i] + c[i + 1]) / 2, 6) if i + 1 < k else None) for i in range(k)]
    return spark.createDataFrame(rows, schema)


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """Mean with a 95 % interval from Poisson resampling of whole clusters.

    Rows fold to one sum and count for each cluster; each draw weighs a cluster by a
    Poisson(1) number from a hash of seed, draw and cluster, so draws run in parallel and
    agree between runs.
    """
    c = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", cluster), F.lit(1_000_003)) + 0.5) / 1_000_003
    cdf, p, w = [], 2.718281828459045**-1, F.lit(0)
    acc = 0.0
    for i in range(8):
        acc += p
        cdf.append(acc)
        p /= i + 1
    for t in cdf:
        w = w + (u > t).cast("int")
    d = c.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", w)
    m = d.groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    e = c.agg((F.sum("s") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("clusters"))
    q = m.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return e.join(q, F.lit(True)).select("clusters", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
