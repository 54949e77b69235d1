"""Agreement, ranking, calibration and clustering metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflode.functions.scores import clip_prob, wilson
from difflode.operators.ranking import rank_within, running_sums


def r6(x: Column) -> Column:
    """Rounded to six places."""
    return F.round(x, 6)


def precision_report(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """Rows, hits, precision and its Wilson interval for each group; null outcomes are not counted."""
    g = df.where(hit.isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("bigint")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select(group, "n", "k", r6(F.col("k") / F.col("n")).alias("precision"), r6(low).alias("low"), r6(high).alias("high"))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Raw agreement and Cohen's kappa of two binary columns; kappa is null where chance agreement is 1."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select(*by, "n", r6(F.col("po")).alias("agreement"), r6(F.when(pe < 1, (F.col("po") - pe) / (1 - pe))).alias("kappa"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Quadratic-weighted kappa over integers, from moments alone (no category matrix is needed)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = df.where(x.isNotNull() & y.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg((x - y) * (x - y)).alias("obs"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy")
    )
    expected = F.col("xx") + F.col("yy") - 2 * F.col("mx") * F.col("my")
    return m.select("n", r6(F.when(expected > 0, 1 - F.col("obs") / expected)).alias("weighted_kappa"))


def count_metrics(df: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    """Accuracy, mean absolute error, and shares of under- and over-counted rows."""
    g, p = F.col(gold), F.col(pred)
    return df.where(g.isNotNull() & p.isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((g == p).cast("double"))).alias("accuracy"), r6(F.avg(F.abs(g - p).cast("double"))).alias("mae"),
        r6(F.avg((p < g).cast("double"))).alias("under"), r6(F.avg((p > g).cast("double"))).alias("over"),
    )


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and rows for each distinct score, with running sums from the highest; one row a score."""
    d = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(truth).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("all")
    )
    return running_sums(d, [F.col("s").desc()], {"tp": "pos", "seen": "all"})


def ranking_metrics(df: DataFrame, truth: str, score: str) -> DataFrame:
    """AUROC (ties count half), average precision over distinct scores, Brier score, log-loss and accuracy at 0.5.

    Rows fold to one for each distinct score before the running sums. AUROC and average
    precision are null where one of the classes is absent.
    """
    d = _by_score(df, truth, score)
    fp = F.col("seen") - F.col("tp")
    neg = F.col("all") - F.col("pos")
    area = d.agg(
        F.sum("pos").alias("p"), F.sum(neg).alias("n"), F.sum(F.col("pos") * (fp - neg + 0.5 * neg)).alias("behind"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("ap")
    )
    q = clip_prob(F.col(score).cast("double"))
    t = F.col(truth).cast("double")
    own = df.where(t.isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).agg(
        F.count(F.lit(1)).alias("rows"), r6(F.avg((F.col(score) - t) * (F.col(score) - t))).alias("brier"), r6(F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q)))).alias("log_loss"),
        r6(F.avg(((F.col(score) >= 0.5).cast("double") == t).cast("double"))).alias("accuracy"),
    )
    return own.join(area, F.lit(True)).select(
        "rows", r6(F.when((F.col("p") > 0) & (F.col("n") > 0), 1 - F.col("behind") / (F.col("p") * F.col("n")))).alias("auroc"),
        r6(F.when(F.col("p") > 0, F.col("ap") / F.col("p"))).alias("auprc"), "brier", "log_loss", "accuracy",
    )


def reliability(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and rate of truth in equal-width bins, half open, the last one closed."""
    s = F.col(score)
    b = F.least(F.lit(bins - 1), F.floor(s * bins)).cast("int")
    return df.where(F.col(truth).isNotNull() & s.isNotNull() & ~F.isnan(score)).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(s)).alias("mean_score"), r6(F.avg(F.col(truth).cast("double"))).alias("rate"), r6(F.abs(F.avg(s) - F.avg(F.col(truth).cast("double")))).alias("gap")
    )


def threshold_by_precision(df: DataFrame, truth: str, score: str, target: float, fallback: float = 0.5) -> DataFrame:
    """The first threshold, from the highest score (to six places) down, whose strictly higher scores reach the target precision.

    Columns ``threshold, hits, selected, used_fallback``; where no threshold does, the
    fallback, with the rows that any threshold selects at most.
    """
    d = _by_score(df.withColumn("__s", F.round(score, 6)), truth, "__s").withColumn("hits", F.col("tp") - F.col("pos")).withColumn("above", F.col("seen") - F.col("all")).where("above > 0")
    ok = F.when(F.col("hits") >= target * F.col("above"), F.col("s"))
    best = d.agg(F.max(ok).alias("t"), F.max_by("hits", ok).alias("h"), F.max_by("above", ok).alias("n"), F.max("above").alias("most"))
    return best.select(
        F.coalesce("t", F.lit(float(fallback))).alias("threshold"), F.when(F.col("t").isNotNull(), F.col("h")).cast("bigint").alias("hits"),
        F.when(F.col("t").isNotNull(), F.col("n")).otherwise(F.col("most")).cast("bigint").alias("selected"), F.col("t").isNull().alias("used_fallback"),
    )


def risk_coverage(df: DataFrame, wrong: str, score: str, steps: int = 10) -> DataFrame:
    """Risk among the surest tenth, two tenths, ... of the rows; ties of a score go in together."""
    d = _by_score(df, wrong, score)
    total = d.agg(F.sum("all").alias("total"))
    x = d.join(total, F.lit(True)).withColumn("step", F.ceil(F.col("seen") * steps / F.col("total")).cast("int"))
    return x.groupBy("step").agg(F.max_by("tp", "seen").alias("tp"), F.max("seen").alias("seen")).select("step", F.col("seen").cast("bigint").alias("rows"), r6(F.col("tp") / F.col("seen")).alias("risk"))


def cluster_metrics(units: DataFrame, by: str, gold: str, pred: str) -> DataFrame:
    """Pairwise F1, adjusted Rand index, normalised mutual information (log 2) and B-cubed F1 of each group.

    Everything comes from the contingency counts of gold and predicted clusters, so no
    pair of units is ever formed. Degenerate cases: F1 is 0 without a predicted or gold
    pair, ARI is 1 where both partitions are trivial alike, NMI is 1 if both have one cluster.
    """
    u = units.where(F.col(gold).isNotNull() & F.col(pred).isNotNull())
    cell = u.groupBy(by, gold, pred).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cell.groupBy(by, gold).agg(F.sum("n").alias("a"))
    cols = cell.groupBy(by, pred).agg(F.sum("n").alias("b"))
    two = lambda c: c * (c - 1) / 2
    full = cell.join(rows, [by, gold]).join(cols, [by, pred])
    c = full.groupBy(by).agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("tp"), F.sum(F.col("n") * F.col("n") / F.col("b")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("a")).alias("br"),
                             F.sum(F.col("n") * F.log2(F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    r = rows.groupBy(by).agg(F.sum(two(F.col("a"))).alias("ga"), F.sum(F.col("a") * F.log2("a")).alias("ha"))
    k = cols.groupBy(by).agg(F.sum(two(F.col("b"))).alias("gb"), F.sum(F.col("b") * F.log2("b")).alias("hb"))
    x = c.join(r, by).join(k, by)
    n = F.col("n")
    pr, rc = F.try_divide(F.col("tp"), F.col("gb")), F.try_divide(F.col("tp"), F.col("ga"))
    mi, ha, hb = F.col("mi") / n + F.log2(n), F.log2(n) - F.col("ha") / n, F.log2(n) - F.col("hb") / n
    exp = F.try_divide(F.col("ga") * F.col("gb"), two(n))
    most = (F.col("ga") + F.col("gb")) / 2
    p3, r3 = F.col("bp") / n, F.col("br") / n
    return x.select(
        by, n.cast("bigint").alias("units"), r6(F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))).alias("pair_f1"),
        r6(F.when(F.abs(most - F.coalesce(exp, F.lit(0.0))) < 1e-12, 1.0).otherwise((F.col("tp") - exp) / (most - exp))).alias("ari"),
        r6(F.when((ha < 1e-12) & (hb < 1e-12), 1.0).otherwise(F.try_divide(2 * mi, ha + hb))).alias("nmi"), r6(2 * p3 * r3 / (p3 + r3)).alias("bcubed_f1"),
    )


def index_quantiles(df: DataFrame, group: str, value: str, qs: list[float]) -> DataFrame:
    """Quantiles by half-even index: the value at position round((n - 1) q) of the sorted group; groups of any size."""
    own = df.where(F.col(value).isNotNull()).select(group, value).withColumn("__id", F.monotonically_increasing_id())
    ranked = rank_within(own, [group], [F.col(value).asc(), F.col("__id").asc()])
    n = ranked.groupBy(group).agg(F.max("rank").alias("n"))
    at = ranked.join(n, group).where(F.array_contains(F.array(*[F.bround((F.col("n") - 1) * F.lit(q), 0).cast("bigint") for q in qs]), F.col("rank") - 1))
    pick = [F.max(F.when(F.col("rank") - 1 == F.bround((F.col("n") - 1) * F.lit(q), 0).cast("bigint"), F.col(value))).alias(f"q{round(q * 100)}") for q in qs]
    return at.groupBy(group).agg(F.max("n").alias("n"), *pick)
