"""Windowed counts over a stream of events."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflode.plans.lineage import ensure_checkpoint_dir


def windowed_counts(spark: SparkSession, sf_dir: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``hour, event_type, n, total``: a file stream with a watermark, run to the end of what is there.

    ``hour`` is text in the session's time zone. Finished windows are appended to a table beside the checkpoints, which the result reads; a last batch
    without data closes the windows before the watermark, later ones stay open.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = (
        events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")
    )
    query = counted.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("hour string, event_type string, n long, total double").parquet(f"{out}/data")
