"""Resumable ingestion of records that are delivered more than once."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from difflode.plans.lineage import ensure_checkpoint_dir


def first_deliveries(spark: SparkSession, source: str, key: str, columns: list[str], target: str | None = None, state: str | None = None, order: str | None = None) -> DataFrame:
    """``key`` and ``columns`` of each record's first delivery, by a file stream that adds to a table what the table lacks.

    ``target`` and ``state`` name the table and the checkpoint; a later call with the same
    two goes on where the last one stopped and reads new files only. By default both lie
    beside the checkpoints and are new. Of several deliveries in one batch the earliest by
    ``order`` counts (missing ones last, then by the columns). The table itself is the
    memory of the keys seen, so no state grows in the executors, and a batch that is run
    again adds nothing twice. Records without a key are left out.
    """
    base = os.path.join(ensure_checkpoint_dir(spark), f"ingest-{uuid.uuid4().hex}")
    target, state = target or f"{base}/data", state or f"{base}/state"
    schema = spark.read.parquet(source).schema
    out = StructType([schema[key], *[schema[c] for c in columns]])
    # an empty table to begin with, so that every batch finds one
    spark.createDataFrame([], out).write.mode("append").parquet(target)
    plain = source.rstrip("/")
    stream = spark.readStream.schema(schema)
    if not plain.startswith("hdfs:") and os.path.isfile(plain):
        stream = stream.option("pathGlobFilter", os.path.basename(plain))
        plain = os.path.dirname(plain)
    rows = stream.parquet(plain).where(f"`{key}` is not null").select(key, *columns, *([order] if order and order not in columns else []))

    def add(batch: DataFrame, batch_id: int) -> None:
        place = [F.col(order).isNull(), F.col(order)] if order else []
        first = batch.groupBy(key).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(place)], *columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])
        seen = batch.sparkSession.read.schema(out).parquet(target).select(key)
        first.join(seen, key, "left_anti").write.mode("append").parquet(target)

    rows.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(target)
