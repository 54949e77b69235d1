"""Nearest texts by TF-IDF cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from difflode.functions.words import words


def tfidf_top_k(queries: DataFrame, pool: DataFrame, k: int, guard: str | None = None, parts: int = 16) -> DataFrame:
    """``query_id, example_id, rank, cosine``: for each query text its ``k`` nearest pool texts.

    ``queries`` has ``id, text``, ``pool`` too, and both the ``guard`` column if given: a
    pair with equal guards never counts (leakage). The query counts as a document of the
    pool: with n pool texts, d of which hold a word, a word weighs ``tf * ln((2 + n) / (1 +
    d)) + 1``, where d counts one more for the query's own words. What the query adds to
    the weights of a pool text is corrected over the shared words, so the cosine comes from
    one equality join on words whose products are added up with partial aggregation: no
    pair of texts is compared as a whole and texts without a shared word never meet. A
    frequent word is dealt over ``parts`` salts of the pool side. Null and empty texts
    match nothing; ties go to the smaller id.
    """
    own = [guard] if guard else []
    n = pool.where(F.col("id").isNotNull()).select("id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))

    def bag(df: DataFrame) -> DataFrame:
        t = df.where(F.col("id").isNotNull()).select("id", *own, F.explode(words(F.col("text"))).alias("w"))
        return t.groupBy("id", *own, "w").agg(F.count(F.lit(1)).alias("tf"))

    pb, qb = bag(pool), bag(queries)
    df = pb.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    weight = lambda d: F.col("tf") * F.log((2 + F.col("n_docs")) / (1 + d)) + 1
    pw = pb.join(df, "w").join(n, F.lit(True)).select("id", *own, "w", weight(F.col("df")).alias("alone"), weight(F.col("df") + 1).alias("x"))
    qw = qb.join(df, "w", "left").join(n, F.lit(True)).select("id", *own, "w", weight(F.coalesce("df", F.lit(0)) + 1).alias("x"))
    nq, np_ = [b.groupBy("id").agg(F.sum(F.col(c) * F.col(c)).alias("norm")) for b, c in ((qw, "x"), (pw, "alone"))]
    a = qw.select(F.col("id").alias("query_id"), *[F.col(g).alias("__gq") for g in own], "w", F.col("x").alias("xq"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"))
    b = pw.select(F.col("id").alias("example_id"), *[F.col(g).alias("__gp") for g in own], "w", F.col("x").alias("xp"), (F.col("x") * F.col("x") - F.col("alone") * F.col("alone")).alias("more"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("salt"))
    hit = a.join(b, ["w", "salt"]).where(F.col("query_id") != F.col("example_id"))
    if guard:
        hit = hit.where(~F.col("__gq").eqNullSafe(F.col("__gp")))
    dot = hit.groupBy("query_id", "example_id").agg(F.sum(F.col("xq") * F.col("xp")).alias("dot"), F.sum("more").alias("more"))
    s = dot.join(nq.select(F.col("id").alias("query_id"), F.col("norm").alias("nq")), "query_id").join(np_.select(F.col("id").alias("example_id"), F.col("norm").alias("np")), "example_id")
    s = s.select("query_id", "example_id", F.round(F.col("dot") / F.sqrt(F.col("nq") * (F.col("np") + F.col("more"))), 6).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "example_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
