"""Scalar functions on probabilities, counts and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function, stable for either sign; null for null."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clip_prob(p: Column, eps: float = 1e-8) -> Column:
    """A probability kept inside (eps, 1 - eps)."""
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def logit(p: Column) -> Column:
    """Log odds of a clipped probability."""
    q = clip_prob(p)
    return F.log(q / (1 - q))


def platt(raw: Column, a: float, b: float) -> Column:
    """Calibrated probability of a raw one: a line in log odds."""
    return sigmoid(F.lit(a) * logit(raw) + F.lit(b))


def isotonic_predict(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear interpolation on sorted knots, constant beyond the ends."""
    k = sorted(knots)
    out = F.when(x <= k[0][0], F.lit(float(k[0][1])))
    for (x0, y0), (x1, y1) in zip(k, k[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    return out.otherwise(F.when(x.isNotNull(), F.lit(float(k[-1][1]))))


def bernoulli_entropy(p: Column) -> Column:
    """Natural-log entropy of a clipped probability."""
    q = clip_prob(p)
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def entropy_of(counts: Column) -> Column:
    """Natural-log entropy of an array of counts, with 1e-9 inside the logarithm; 0 for no counts."""
    c = F.transform(counts, lambda x: x.cast("double"))
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, -F.aggregate(c, F.lit(0.0), lambda a, x: a + (x / total) * F.log(x / total + 1e-9))).otherwise(0.0)


def gini_of(counts: Column) -> Column:
    """Gini impurity of an array of counts; 0 for no counts."""
    c = F.transform(counts, lambda x: x.cast("double"))
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, 1 - F.aggregate(c, F.lit(0.0), lambda a, x: a + (x / total) * (x / total))).otherwise(0.0)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k out of n, inside [0, 1]; (0, 0) for n = 0."""
    p, z2 = k / n, z * z
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    mid, den = p + z2 / (2 * n), 1 + z2 / n
    low = F.greatest(F.lit(0.0), (mid - half) / den)
    high = F.least(F.lit(1.0), (mid + half) / den)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def stable_key(seed: str, *parts: Column) -> Column:
    """Order key that depends on seed and parts only: SHA-256 of them joined by ``|``."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def stable_unit(seed: str, *parts: Column) -> Column:
    """A number in [0, 1] from the first eight hexadecimal digits of ``stable_key``."""
    return F.conv(F.substring(stable_key(seed, *parts), 1, 8), 16, 10).cast("bigint") / F.lit(float(0xFFFFFFFF))


def half_even_index(n: Column, q: float) -> Column:
    """Index ``round((n - 1) q)`` with ties to even, from 0."""
    return F.bround((n - 1) * F.lit(q), 0).cast("bigint")
