"""Signals of single intent, with bounds, weights and thresholds that follow from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflode.functions import signals as sg
from difflode.functions.scores import clip_prob, sigmoid
from difflode.operators.metrics import index_quantiles
from difflode.operators.ranking import rank_within, running_sums
from difflode.operators.stats import medians
from difflode.plans.lineage import cut

SIGNALS = ("prefix_valid", "subject_compact", "body_compact", "single_focus", "clean_message", "not_release", "type_signal", "file_scope", "patch_scope", "hunk_scope", "role_focus", "module_focus")


def quantiles(df: DataFrame, columns: dict[str, list[float]]) -> DataFrame:
    """``name, n`` and ``q..`` for several columns at once, by half-even index; each column becomes rows of its name."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    qs = sorted({q for v in columns.values() for q in v})
    return index_quantiles(long, "name", "v", qs)


def message_bounds(profile: DataFrame) -> DataFrame:
    """One row of bounds: subject lengths at 10 and 90 % (of non-empty subjects), body lines and paragraphs at 50 and 85 %."""
    q = quantiles(profile.select(F.when(F.col("subject_len") > 0, F.col("subject_len")).alias("subject_len"), "body_lines", "paragraphs"), {"subject_len": [0.1, 0.9], "body_lines": [0.5, 0.85], "paragraphs": [0.5, 0.85]})
    pick = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    return q.agg(
        F.greatest(F.lit(1.0), pick("subject_len", "q10")).alias("subject_min"), F.greatest(F.lit(1.0), pick("subject_len", "q90")).alias("subject_max"),
        pick("body_lines", "q50").alias("body_compact"), pick("body_lines", "q85").alias("body_fragmented"), pick("paragraphs", "q50").alias("paragraph_compact"), pick("paragraphs", "q85").alias("paragraph_fragmented"),
    )


def scope_bounds(profile: DataFrame) -> DataFrame:
    """``name, small_max, medium_max, large_min`` of file, line, hunk and module counts at a third, two thirds and nine tenths."""
    cols = ["file_count", "changed", "hunk_count", "module_count"]
    q = quantiles(profile.select(*cols), {c: [1 / 3, 2 / 3, 0.9] for c in cols})
    return q.select("name", F.col("q33").alias("small_max"), F.col("q67").alias("medium_max"), F.col("q90").alias("large_min"))


def type_values(df: DataFrame, col: str) -> DataFrame:
    """``type, z, default_z``: the z-score of each type's share, and the median of these."""
    g = df.where(F.col(col).isNotNull() & (F.col(col) != "")).groupBy(F.col(col).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    a = g.agg(F.sum("n").alias("total"), F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    z = cut(g.join(a, F.lit(True)).select("type", ((F.col("n") - F.col("m")) / F.col("total") / F.greatest(F.col("s") / F.col("total"), F.lit(1e-9))).alias("z")))
    mid = medians(z.select(F.lit(0).alias("g"), "z"), "g", "z").select(F.col("median").alias("default_z"))
    return z.join(mid, F.lit(True))


def signal_table(profile: DataFrame, key: str) -> DataFrame:
    """``key`` and the twelve signals of a table with the columns of both profiles and ``type``; bounds come from the same table."""
    p = cut(profile)
    mb, scope = message_bounds(p), scope_bounds(p)
    names = {"file_count": "file", "changed": "patch", "hunk_count": "hunk", "module_count": "module"}
    wide = scope.agg(*[F.max(F.when(F.col("name") == c, F.col(b))).alias(f"{n}_{b}") for c, n in names.items() for b in ("small_max", "large_min")])
    kinds = type_values(p, "type")
    default = kinds.agg(F.max("default_z").alias("default_z"))
    x = p.join(mb.join(wide, F.lit(True)).join(default, F.lit(True)), F.lit(True)).join(kinds.select("type", "z"), "type", "left")
    yes = lambda c: F.when(c, 1.0).otherwise(-1.0)
    even = lambda c: F.bround(F.col(c), 0)
    body = F.when((F.col("body_lines") <= even("body_compact")) & (F.col("paragraphs") <= even("paragraph_compact")), 1.0).when((F.col("body_lines") >= even("body_fragmented")) | (F.col("paragraphs") >= even("paragraph_fragmented")), -1.0).otherwise(0.0)
    scoped = lambda c, n: sg.ramp(F.col(c), F.col(f"{n}_small_max"), F.col(f"{n}_large_min"))
    return x.select(
        key, yes(F.col("prefix_match")).alias("prefix_valid"), yes(F.col("subject_len").between(even("subject_min"), even("subject_max"))).alias("subject_compact"), body.alias("body_compact"),
        yes(~F.col("multi")).alias("single_focus"), yes(~F.col("noisy")).alias("clean_message"), yes(~F.col("release_like")).alias("not_release"), F.coalesce("z", "default_z", F.lit(0.0)).alias("type_signal"),
        scoped("file_count", "file").alias("file_scope"), scoped("changed", "patch").alias("patch_scope"), scoped("hunk_count", "hunk").alias("hunk_scope"), sg.role_focus(F.col("role_list")).alias("role_focus"),
        F.when(F.col("module_count") == 0, 1.0).otherwise(scoped("module_count", "module")).alias("module_focus"),
    )


def signal_weights(signals: DataFrame) -> DataFrame:
    """One row ``w_..`` for each signal: its deviation over the sum of all deviations."""
    a = signals.agg(*[F.greatest(F.stddev_pop(s), F.lit(1e-6)).alias(s) for s in SIGNALS])
    total = reduce(lambda x, y: x + y, [F.col(s) for s in SIGNALS])
    return a.select(*[(F.col(s) / total).alias(f"w_{s}") for s in SIGNALS])


def scored(signals: DataFrame, key: str) -> DataFrame:
    """``key, pooled, logit, prob`` and the signals: the weighted sum, less its median and over its deviation, through the logistic function."""
    w = signal_weights(signals)
    pooled = reduce(lambda x, y: x + y, [F.col(f"w_{s}") * F.col(s) for s in SIGNALS])
    x = cut(signals.join(w, F.lit(True)).select(key, *SIGNALS, pooled.alias("pooled")))
    mid = medians(x.select(F.lit(0).alias("g"), "pooled"), "g", "pooled").select(F.col("median").alias("centre"))
    sd = x.agg(F.greatest(F.stddev_pop("pooled"), F.lit(1e-6)).alias("sd"))
    y = x.join(mid, F.lit(True)).join(sd, F.lit(True)).withColumn("logit", (F.col("pooled") - F.col("centre")) / F.col("sd"))
    return y.select(key, *SIGNALS, "pooled", "logit", clip_prob(sigmoid(F.col("logit"))).alias("prob"))


def reasons(signals: dict[str, Column], top: int = 6) -> Column:
    """The strongest signals that are not zero as ``pos:name`` or ``neg:name``, strongest first; ties keep the order given."""
    rows = F.array(*[F.struct(-F.abs(v), F.lit(i).alias("i"), F.concat(F.when(v > 0, "pos:").otherwise("neg:"), F.lit(n)).alias("name"), v.alias("v")) for i, (n, v) in enumerate(signals.items())])
    return F.transform(F.slice(F.array_sort(F.filter(rows, lambda r: r["v"] != 0)), 1, top), lambda r: r["name"])


def gate_by_entropy(df: DataFrame, score: str) -> DataFrame:
    """``gate, selected``: the lowest score from which on the mean entropy (base 2) is at most the median entropy of all."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))
    q = clip_prob(p)
    h = -(q * F.log(q) + (1 - q) * F.log(1 - q)) / 0.6931471805599453
    x = cut(df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(p.alias("p"), h.alias("h")))
    budget = medians(x.select(F.lit(0).alias("g"), "h"), "g", "h").select("median")
    d = x.groupBy("p").agg(F.sum("h").alias("hs"), F.count(F.lit(1)).alias("n"))
    s = running_sums(d, [F.col("p").desc()], {"above": "hs", "rows": "n"}).join(budget, F.lit(True))
    ok = F.when(F.col("above") / F.col("rows") <= F.col("median") + 1e-12, F.col("p"))
    return s.agg(F.coalesce(F.min(ok), F.min("p")).alias("gate"), F.coalesce(F.min_by("rows", ok), F.max("rows")).alias("selected"))


def quantile_bins(df: DataFrame, score: str, bins: int = 4) -> DataFrame:
    """``bin, lower, upper, n``: bins between quantiles (half-even index) of a score, from the highest down; a row is in the first whose lower bound it reaches."""
    x = cut(df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(clip_prob(F.col(score).cast("double")).alias("p")))
    own = x.select(F.lit(0).alias("g"), "p").withColumn("__id", F.monotonically_increasing_id())
    ranked = rank_within(own, ["g"], [F.col("p").asc(), F.col("__id").asc()])
    n = ranked.agg(F.max("rank").alias("n"))
    at = [F.max(F.when(F.col("rank") - 1 == F.bround((F.col("n") - 1) * F.lit(i / bins), 0).cast("bigint"), F.col("p"))).alias(f"b{i}") for i in range(bins + 1)]
    b = ranked.join(n, F.lit(True)).agg(*at)
    bounds = b.select(F.explode(F.array(*[F.struct(F.lit(bins - 1 - i).alias("bin"), F.col(f"b{i}").alias("lower"), F.col(f"b{i + 1}").alias("upper")) for i in range(bins)])).alias("r")).select("r.*")
    first = F.coalesce(*[F.when(F.col("p") >= F.col(f"b{i}"), bins - 1 - i) for i in reversed(range(bins))], F.lit(bins - 1))
    c = x.join(b, F.lit(True)).groupBy(first.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bounds.join(c, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def fit_platt(df: DataFrame, raw: str, label: str, l2: float = 1e-3, rounds: int = 25) -> DataFrame:
    """``n, slope, intercept``: the line in log odds of a raw probability that fits 0/1 labels best, with a small penalty on the slope.

    Rows fold to one for each distinct probability and label; every Newton step is one
    aggregate, of which five sums come to the driver. Null and NaN are left out; without
    both labels the line is the identity.
    """
    import math

    q = clip_prob(F.col(raw).cast("double"))
    d = cut(df.where(F.col(raw).isNotNull() & ~F.isnan(raw) & F.col(label).isin(0, 1)).groupBy(F.log(q / (1 - q)).alias("x"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    total = d.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("pos")).first()
    n, pos = float(total["n"] or 0), float(total["pos"] or 0)
    a, b = 1.0, 0.0
    for _ in range(rounds if 0 < pos < n else 0):
        p = sigmoid(F.lit(a) * F.col("x") + F.lit(b))
        w, e = F.col("n") * p * (1 - p), F.col("n") * (p - F.col("y"))
        s = d.agg(F.sum(e * F.col("x")).alias("ga"), F.sum(e).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("aa"), F.sum(w * F.col("x")).alias("ab"), F.sum(w).alias("bb")).first()
        ga, gb, aa, ab, bb = s["ga"] / n + l2 * a, s["gb"] / n, s["aa"] / n + l2, s["ab"] / n, s["bb"] / n
        det = aa * bb - ab * ab
        if det <= 1e-15:
            break
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        a, b = a - da, b - db
        if math.hypot(da, db) < 1e-9:
            break
    return df.sparkSession.createDataFrame([(int(n), round(a, 6), round(b, 6))], "n long, slope double, intercept double")
