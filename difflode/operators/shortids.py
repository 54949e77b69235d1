"""Full commit ids for shortened ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_short_ids(ids: DataFrame, col: str, full_length: int = 40) -> DataFrame:
    """``(id, full_id)`` for each distinct id of ``ids[col]``.

    An id shorter than ``full_length`` names every longer id that it begins; one that
    begins none names itself. Only the distinct lengths (fewer than ``full_length``)
    come to the driver; the match is an equality join on prefixes of these lengths.
    Null and empty ids give no row.
    """
    d = ids.select(F.col(col).alias("id")).where(F.col("id").isNotNull() & (F.col("id") != "")).distinct()
    lengths = sorted(r[0] for r in d.where(F.length("id") < full_length).select(F.length("id")).distinct().collect())
    if not lengths:
        return d.select("id", F.col("id").alias("full_id"))
    longer = d.where(F.length("id") > lengths[0]).select(
        F.col("id").alias("full_id"),
        F.explode(F.array_distinct(F.array(*[F.when(F.length("id") > n, F.substring("id", 1, n)) for n in lengths]))).alias("id"),
    ).where(F.col("id").isNotNull())
    short = d.where(F.length("id") < full_length)
    named = short.join(longer, "id", "left").select("id", F.coalesce("full_id", "id").alias("full_id"))
    return d.where(F.length("id") >= full_length).select("id", F.col("id").alias("full_id")).union(named)
