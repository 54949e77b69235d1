"""Scores and conflicts of paired records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from difflode.functions.words import jaccard


def geometric_mean(*parts: Column) -> Column:
    """Geometric mean of positive numbers; 0 if one is zero, null if one is null."""
    product = parts[0]
    for p in parts[1:]:
        product = product * p
    return F.when(product <= 0, 0.0).otherwise(F.pow(product, F.lit(1.0 / len(parts))))


def pair_precheck(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``first_conflict`` and ``weight``.

    Needs ``type_a, type_b, files_a, files_b, modules_a, modules_b, words_a, words_b``. The
    first conflict is a shared file, an equal type or nearly the same words; the weight is
    the geometric mean of how far words differ, how few modules are shared and how alike
    the sizes are, and 0 for a pair in conflict. A null array counts as empty.
    """
    e = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    words = F.coalesce(jaccard(e("words_a"), e("words_b")), F.lit(1.0))
    modules = F.coalesce(jaccard(e("modules_a"), e("modules_b")), F.lit(1.0))
    na, nb = F.size(e("files_a")), F.size(e("files_b"))
    balance = F.coalesce(F.try_divide(F.least(na, nb).cast("double"), F.greatest(na, nb)), F.lit(0.0))
    conflict = F.when(F.arrays_overlap(e("files_a"), e("files_b")), "shared_file").when(F.col("type_a").eqNullSafe(F.col("type_b")), "same_type").when(words >= 0.8, "same_words").otherwise("none")
    weight = F.when(conflict == "none", geometric_mean(1 - words, 1 - 0.5 * modules, balance)).otherwise(0.0)
    return pairs.withColumn("first_conflict", conflict).withColumn("weight", F.round(weight, 6))
