"""Capping the records of dominant contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflode.operators.ranking import rank_within


def water_level(histogram: list[tuple[int, int]], max_share: float, free: int = 0) -> int:
    """The largest limit T such that no contributor's share of the output exceeds ``max_share``.

    ``histogram`` has (records, number of contributors with that many); ``free`` records
    belong to nobody and always stay. With every contributor cut to T the output has
    ``free + sum(min(c, T))`` records; the level rises through the sorted counts until
    T / output would exceed the share. 0 where no level from 1 on meets the share, as with
    fewer than ``1 / max_share`` contributors and no free records.
    """
    hist = sorted((int(c), int(n)) for c, n in histogram if c > 0)
    above, below, level, last = sum(n for _, n in hist), free, 0, 0
    for c, n in hist:
        # for T from the count before up to c the output is below + above * T
        if c <= max_share * (below + above * c) + 1e-9:
            level = c
        else:
            slope = 1 - max_share * above
            t = min(c, int(max_share * below / slope + 1e-9)) if slope > 0 else 0
            if t >= max(last, 1):
                level = max(level, t)
        below, above, last = below + c * n, above - n, c
    return level


def share_limit(records: DataFrame, contributor: str, max_share: float) -> int:
    """``water_level`` of a table; only the histogram of counts, at most sqrt(2 rows) long, is gathered."""
    counts = records.groupBy(contributor).agg(F.count(F.lit(1)).alias("c"))
    hist = counts.where(F.col(contributor).isNotNull()).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    free = counts.where(F.col(contributor).isNull()).agg(F.sum("c")).first()[0] or 0
    return water_level([(r["c"], r["n"]) for r in hist], max_share, free)


def cap_records(records: DataFrame, limits: DataFrame, max_share: float | None = None) -> DataFrame:
    """``records`` with ``rank`` and ``dropped``.

    ``records`` has ``pool, record_id, contributor, score``; ``limits`` has ``pool,
    max_rows``. A record is a distinct id of its pool (of repeated deliveries the best
    score and the smallest contributor name). Within pool and contributor the higher
    score ranks first, null and NaN last, then the smaller id; records ranked beyond
    ``max_rows`` are dropped, and with ``max_share`` also those beyond the water level of
    the whole table. A share that no level meets is an error, as every contributor would
    lose all records. Records without a contributor are never dropped, nor are those of a
    pool without a limit; null ids are left out. Other columns are not read.
    """
    one = records.where(F.col("record_id").isNotNull()).select(
        "pool", "record_id", "contributor", F.when(~F.isnan("score"), F.col("score").cast("double")).alias("score")
    ).groupBy("pool", "record_id").agg(F.min("contributor").alias("contributor"), F.max("score").alias("score"))
    level = share_limit(one, "contributor", max_share) if max_share is not None else None
    if level == 0 and not one.where(F.col("contributor").isNotNull()).isEmpty():
        raise ValueError(f"no limit keeps every contributor within a share of {max_share}; there are too few of them")
    ranked = rank_within(one, ["pool", "contributor"], [F.col("score").desc_nulls_last(), F.col("record_id").asc()])
    lim = limits.where(F.col("max_rows").isNotNull()).groupBy("pool").agg(F.min("max_rows").alias("max_rows"))
    cap = F.least(F.col("max_rows"), F.lit(level)) if level is not None else F.col("max_rows")
    return ranked.join(lim, "pool", "left").select(
        "pool", "record_id", "contributor", "score", "rank",
        (F.col("contributor").isNotNull() & F.coalesce(F.col("rank") > cap, F.lit(False))).alias("dropped"),
    )
