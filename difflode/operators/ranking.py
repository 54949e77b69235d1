"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from difflode.plans.lineage import cut


def rank_within(df: DataFrame, group: list[str], order: list[Column], rank_col: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in its group; no group is sorted in one task.

    Rows are range-partitioned by group *and* order, so a group that holds a third of all
    rows spreads over a third of the partitions. The rank is the row number within the
    partition's slice of the group plus the rows of the group in earlier partitions; only
    the counts by partition and group are added up. ``order`` must be total (end it with a
    key) for a defined result. Null group values form a group of their own.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = [F.col(g) for g in group]
    laid = cut(df.repartitionByRange(n, *[k.asc_nulls_first() for k in key], *order).withColumn("__pid", F.spark_partition_id()))
    counts = laid.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    for g in group:
        offsets = offsets.withColumnRenamed(g, f"__g_{g}")
    inside = Window.partitionBy("__pid", *group).orderBy(*order)
    numbered = laid.withColumn("__rn", F.row_number().over(inside))
    on = numbered["__pid"] == offsets["__pid"]
    for g in group:
        on = on & numbered[g].eqNullSafe(offsets[f"__g_{g}"])
    joined = numbered.join(offsets, on)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__rn") + F.col("__before")).cast("long").alias(rank_col))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sum of some columns over all rows up to this one in the given order; no task sorts all rows.

    ``sums`` maps new names to columns. Rows are range-partitioned by the order; the sums of
    the partitions (a row each) are added up and every partition goes on from there.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = cut(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    before = Window.partitionBy("__one").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = laid.groupBy("__pid").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()]).withColumn("__one", F.lit(0))
    offsets = whole.select("__pid", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = laid.select("*", *[F.sum(c).over(inside).alias(f"__in_{k}") for k, c in sums.items()])
    return own.join(offsets, "__pid").select(*df.columns, *[(F.col(f"__in_{k}") + F.col(f"__{k}")).alias(k) for k in sums])
