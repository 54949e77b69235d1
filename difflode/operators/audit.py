"""Chains and references that must hold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows of each group in order with ``link``; a chain is sequential by nature, so a group is one task's pass, which holds one link at a time."""
    names = [f.name for f in df.schema.fields]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], "link string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, link = None, ""
        for batch in batches:
            links = []
            for g, v in zip(batch.column(group).to_pylist(), batch.column(value).to_pylist()):
                if g != at:
                    at, link = g, ""
                link = hashlib.sha256(f"{link}|{v}".encode()).hexdigest()
                links.append(link)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(links, pa.string())], names=[*names, "link"])

    return df.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, out)


def hash_chain(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``df`` with ``link``: SHA-256 of the previous link of its group, a bar and its own value; the first has an empty previous link.

    Rows without a group or a value are left out; ties of the order are chained in no set order.
    """
    return _fold(df.where(F.col(group).isNotNull() & F.col(value).isNotNull()), group, order, value)


def verify_chain(df: DataFrame, group: str, order: str, value: str, link: str) -> DataFrame:
    """The rows whose stored link is not that of their place; a changed record fails itself and all later ones of its group."""
    again = hash_chain(df.withColumnRenamed(link, "__stored"), group, order, value)
    return again.where(~F.col("link").eqNullSafe(F.col("__stored"))).drop("link").withColumnRenamed("__stored", link)


def reference_counters(units: DataFrame, samples: DataFrame) -> DataFrame:
    """``counter, n``: units without sample, samples without unit, gold keys without unit, units outside the gold map, units without intent."""
    u = units.select("sample_id", "unit_id", F.col("gold_intent_id").isNull().alias("no_intent")).distinct()
    s = samples.select("sample_id").distinct()
    gold = samples.select("sample_id", F.explode("units").alias("unit_id")).distinct()
    parts = [
        ("units_without_sample", u.join(s, "sample_id", "left_anti")),
        ("samples_without_unit", s.join(u, "sample_id", "left_anti")),
        ("gold_without_unit", gold.join(u.select("sample_id", "unit_id"), ["sample_id", "unit_id"], "left_anti")),
        ("units_outside_gold", u.join(gold, ["sample_id", "unit_id"], "left_anti")),
        ("units_without_intent", u.where("no_intent")),
    ]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
        out = c if out is None else out.union(c)
    return out
