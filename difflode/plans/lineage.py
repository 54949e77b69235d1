"""Cutting lineage in a place that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves local masters, as in tests; on a
    cluster, whose executors could not read it, the absence is an error.
    """
    ctx = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
    have = ctx.getCheckpointDir()
    if have:
        return have
    if not named and not ctx.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can read")
    ctx.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return ctx.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    For wide rows with several readers: the table is columnar and compressed, and each
    reader scans only the columns that it needs.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
